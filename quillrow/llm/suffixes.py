"""Suffix-array dedup of repeated byte strings.

A byte is removed if a string of `span` bytes that covers it starts elsewhere too. Suffixes are
compared by their first `span` bytes, as a sequence of tokens (64-bit hashes of equal stretches). They
are range-partitioned by leading tokens with sampled splitters, sorted in each bucket by multikey
quicksort, and equal neighbours are repeats; the first and last run of each bucket are compared
across boundaries, so one repeated string may fill many buckets.

Most suffixes can't repeat, and a sieve finds that without sorting them. The least hash of the `gram`
byte windows within a suffix's first `span` bytes depends on these bytes alone; consecutive suffixes
with the same least hash make a stretch. A suffix can only repeat in a stretch of the same least hash:
  - a stretch whose hash no other has, and that holds its least window once, has no repeats;
  - a stretch with a twin (same hash, same bytes from its first suffix to the end of its last) repeats
    as a whole;
  - the suffixes of all other stretches are sorted, with one twin of each sort to meet them.
Groups of copies end in the second case, counted before they are shuffled, so they cost little.

The same finds passages, strings of so many words that start elsewhere too: the sequence is then the
text's words, not its bytes.

Equality is that of hashes: of 128 bits in the sort, and of two of 64 bits for twins. A sum of powers
alone has texts of regular patterns with equal sums, so its terms are mixed from eight bytes, each with
the seven after it, and not from single ones. Texts are told by MD5.

Shapes of input with a defined result: a null text is an empty one; texts shorter than `span` keep all
their bytes; repeated rows are copies of each other; a text may repeat itself and overlap itself;
texts are read whole, in pieces where they are very long; a null doc_id gets its row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common

#: Bytes of the windows of the sieve, tokens of a suffix, bytes worked on at once.
GRAM, TOKENS, PIECE = 256, 2, 1 << 20
#: Bytes of short texts that are sieved at once: few enough for a processor's own memory.
AT_ONCE = 1 << 16
#: Stretches of an Arrow batch, about.
BATCH = 20_000
#: Rows that are sorted at once.
SHORT = 1 << 16
#: Suffixes of a bucket, about, and suffixes of a task that are dealt to buckets at once.
BUCKET, DEALT = 1_000_000, 500_000
#: Sampled suffixes of a bucket, and texts that they are taken from at least, if there are as many; about.
SAMPLED, SAMPLED_TEXTS = 100, 5_000

_SPACE = re.compile(rb"\s")
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_BYTES = np.random.default_rng(400).integers(1, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_power[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 2 * len(_power[0])), b, np.uint64)
            p[0] = 1
            _power[k] = np.cumprod(p, dtype=np.uint64)
    return _power[0][:n], _power[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    out = h >> np.uint64(32)
    out ^= h
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


class Hashes:
    """Hashes of all substrings of some bytes or words, from running sums; of bytes, eight at least."""

    def __init__(self, part: bytes | np.ndarray) -> None:
        if isinstance(part, bytes):
            x = np.frombuffer(part + bytes(7), np.uint8).astype(np.uint64)
            for k in (1, 2, 4):
                x = x[:-k] | x[k:] << np.uint64(8 * k)
            self.tail = 7
        else:
            x, self.tail = part, 0
        power, self.inverse = _powers(len(x) + 1)
        x = x * _BASE
        x += np.uint64(1)
        x = _mixed(x)
        x *= power[:-1]
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end)."""
        return _mixed((self.sums[end - self.tail] - self.sums[start]) * self.inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of so many bytes or words."""
        n, far = len(self.sums) - width, width - self.tail
        out = self.sums[far : far + n] - self.sums[:n]
        out *= self.inverse[:n]
        return _mixed(out)


def words_of(text: str) -> np.ndarray:
    """A hash of each word of a text."""
    return words_in(text.encode("utf-8", "surrogatepass"))[0]


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some bytes, and where each starts."""
    at, out, starts = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        solid = np.zeros(len(x) + 2, np.int8)
        solid[1:-1] = ~_BLANK[x]
        edge = np.flatnonzero(np.diff(solid))  # starts and ends in turn
        power, inverse = _powers(len(x) + 1)
        sums, each = np.zeros(len(x) + 1, np.uint64), _BYTES[x]
        each *= power[: len(x)]
        np.cumsum(each, out=sums[1:])
        out.append(_mixed((sums[edge[1::2]] - sums[edge[::2]]) * inverse[edge[::2]]))
        starts.append(edge[::2] + at)
        at = end
    return np.concatenate(out), np.concatenate(starts)


def least_in_windows(x: np.ndarray, width: int, least: np.ufunc = np.minimum) -> np.ndarray:
    """The minimum (or maximum) of each window of so many numbers, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max if least is np.minimum else 0, np.uint64)]).reshape(-1, width)
    left = least.accumulate(padded, axis=1).reshape(-1)
    right = least.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return least(right[:n], left[width - 1 : width - 1 + n])


def pieces(data: bytes | np.ndarray, span: int) -> Iterator[tuple[int, bytes | np.ndarray]]:
    """The bytes or words in pieces that together hold each string of `span` of them once."""
    for at in range(0, max(1, len(data) - span + 1), PIECE):
        yield at, data[at : at + PIECE + span - 1]


def stretches(data: bytes | np.ndarray, span: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(least hash, hash of the bytes, first suffix, number of suffixes, whether the least window is there twice)."""
    width = span - gram + 1
    for base, part in pieces(data, span):
        if len(part) < span:
            continue
        h = Hashes(part)
        at = np.arange(len(part) - gram + 1)
        grams = h.of(at, at + gram)
        least = least_in_windows(grams, width)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        # Places of each stretch's least window, within all windows of its suffixes.
        size = last - first + width
        owner = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
        twice = np.bincount(owner[grams[place] == least[first][owner]], minlength=len(first)) > 1
        yield least[first], _mixed(h.of(first, last + span) + (last - first).astype(np.uint64)), first + base, last - first + 1, twice


def stretches_of(seq: bytes | np.ndarray, owner: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """The stretches of some texts that stand after each other, at once; owner is the text of each byte or word.

    Returns what stretches() gives for each text, first counted from the text's start, and the texts.
    """
    width = span - gram + 1
    if len(seq) < span:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, bool, np.int64))
    h = Hashes(seq)
    grams = h.windows(gram)
    least = least_in_windows(grams, width)
    # Suffixes whose first `span` bytes lie in one text.
    own = owner[: len(least)] == owner[span - 1 :]
    cut = (least[1:] != least[:-1]) | ~own[1:] | ~own[:-1]
    first = np.flatnonzero(own & np.concatenate([[True], cut]))
    last = np.flatnonzero(own & np.concatenate([cut, [True]]))
    # A window is the least of some suffix if its hash is the greatest of the suffixes' that hold it, as none is greater.
    none = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(least_in_windows(np.concatenate([none, least, none]), width, np.maximum) == grams)
    times, stretch = np.zeros(len(first), np.int64), np.searchsorted(first, place, "right") - 1
    # It is counted in the one stretch of its hash that it lies in; those that hold it follow each other.
    while len(place):
        held = np.flatnonzero((stretch >= 0) & (last[stretch] + width > place)) if len(first) else place[:0]
        place, stretch = place[held], stretch[held]
        same = least[first[stretch]] == grams[place]
        times += np.bincount(stretch[same], minlength=len(first))
        place, stretch = place[~same], stretch[~same] - 1
    text = owner[first].astype(np.int64)
    begin = np.searchsorted(owner, text.astype(owner.dtype))
    return least[first], _mixed(h.of(first, last + span) + (last - first).astype(np.uint64)), first - begin, last - first + 1, times > 1, text


def sequences(texts: list[str], words: bool, most: int) -> Iterator[tuple[list[int], bytes | np.ndarray, np.ndarray]]:
    """Texts of up to `most` bytes each, some after each other: (their places, their bytes or words, the text of each of these)."""
    held: list[int] = []
    data: list[bytes] = []
    size = 0

    def joined() -> tuple[list[int], bytes | np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in data])
        if not words:
            return held, b"".join(data), np.repeat(np.arange(len(data), dtype=np.int32), size)
        own, start = words_in(b"\n".join(data))
        return held, own, (np.searchsorted(np.cumsum(size + 1), start, "right")).astype(np.int32)

    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        if len(b) > most:
            continue
        if size + len(b) > AT_ONCE and held:
            yield joined()
            held, data, size = [], [], 0
        held.append(i)
        data.append(b)
        size += len(b) + 1
    if held:
        yield joined()


def tokens(data: bytes | np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """TOKENS hashes of each suffix's first `span` bytes."""
    out = np.empty((len(starts), TOKENS), np.uint64)
    cuts = [span * k // TOKENS for k in range(TOKENS + 1)]
    for base, part in pieces(data, span):
        own = np.flatnonzero((starts >= base) & (starts < base + PIECE))
        if len(own):
            h, s = Hashes(part), starts[own] - base
            for k in range(TOKENS):
                out[own, k] = h.of(s + cuts[k], s + cuts[k + 1])
    return out


def multikey_sort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of tokens by three-way partitioning: on a token, then the equal part on the next.

    A part is split by the token of a pivot into less, equal and greater; a short part is sorted by
    all its tokens at once.
    """
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == keys.shape[1]:
            continue
        own = order[a:b]
        if b - a <= SHORT:
            order[a:b] = own[np.lexsort(keys[own, depth:].T[::-1])]
            continue
        k = keys[own, depth]
        pivot = np.sort(k[:: max(1, len(k) // 63)])[len(k[:: max(1, len(k) // 63)]) // 2]
        less, same = np.flatnonzero(k < pivot), np.flatnonzero(k == pivot)
        order[a:b] = own[np.concatenate([less, same, np.flatnonzero(k > pivot)])]
        m, n = a + len(less), a + len(less) + len(same)
        todo += [(a, m, depth), (m, n, depth + 1), (n, b, depth)]
    return order


def tokens_of(texts: list[str], numbers: list[int], parts: pa.ListArray, span: int, words: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, number of the text, start) of all suffixes in the parts (first, n) of some texts, short texts at once."""
    count, flat = parts.value_lengths().to_numpy(), parts.flatten()
    first, n, number = flat.field("first").to_numpy(), flat.field("n").to_numpy(), np.array(numbers, np.int64)
    at = np.cumsum(count) - count
    cuts = [span * k // TOKENS for k in range(TOKENS + 1)]
    long = set(range(len(texts)))
    for places, seq, owner in sequences(texts, words, PIECE):
        long.difference_update(places)
        own = np.array(places)
        begin = np.searchsorted(owner, np.arange(len(own), dtype=owner.dtype))
        part = np.concatenate([np.arange(at[i], at[i] + count[i]) for i in places])
        text = np.repeat(np.arange(len(own)), count[own])
        size = n[part]
        start = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = np.repeat(text, size)
        if len(start):
            h, s = Hashes(seq), start + begin[text]
            yield np.stack([h.of(s + a, s + b) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1), number[own[text]], start.astype(np.int32)
    for i in sorted(long):
        start = np.concatenate([np.arange(a, a + m) for a, m in zip(first[at[i] : at[i] + count[i]].tolist(), n[at[i] : at[i] + count[i]].tolist(), strict=True)])
        data = words_of(texts[i]) if words else texts[i].encode("utf-8", "surrogatepass")
        yield tokens(data, start, span), np.full(len(start), number[i]), start.astype(np.int32)


#: What packets hold of a suffix: its tokens, the number of its text and its start; of a start the last two.
_KEY = [np.int64] * (TOKENS + 1) + [np.int32]
_START = _KEY[TOKENS:]


def packets(dest: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """Rows of numbers as (dest, data), the columns of a destination one after the other: no row of the engine for each."""
    o = np.argsort(dest.astype(np.int16) if dest.max(initial=0) < 1 << 15 else dest, kind="stable")
    dest = dest[o]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(dest)), bool), dest[1:] != dest[:-1]]))
    columns, ends = [c[o] for c in columns], [*first[1:].tolist(), len(dest)]
    data = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(first.tolist(), ends, strict=False)]
    return [pa.array(dest[first].astype(np.int32)), pa.array(data, pa.binary())]


def unpacked(data: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of some packets."""
    width, out = sum(np.dtype(k).itemsize for k in kinds), [[np.zeros(0, k)] for k in kinds]
    for b in data:
        at, n = 0, len(b) // width
        for own, k in zip(out, kinds, strict=True):
            own.append(np.frombuffer(b, k, n, at))
            at += own[-1].nbytes
    return [np.concatenate(x) for x in out]


def buckets_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted splitters stand before or at each key; both are columns, compared one after the other."""
    low = np.searchsorted(splitters[0], keys[0], "left")
    high = np.searchsorted(splitters[0], keys[0], "right")
    todo = np.flatnonzero(low < high)  # equal in the first column
    while len(todo):
        mid = (low[todo] + high[todo]) // 2
        less, same = np.zeros(len(todo), bool), np.ones(len(todo), bool)
        for k, s in zip(keys[1:], splitters[1:], strict=True):
            x, y = s[mid], k[todo]
            less |= same & (x < y)
            same &= x == y
        less |= same
        low[todo], high[todo] = np.where(less, mid + 1, low[todo]), np.where(less, high[todo], mid)
        todo = todo[low[todo] < high[todo]]
    return low


def home(number: np.ndarray, parts: int) -> np.ndarray:
    """The task that the starts of each text come to. Numbers count within a task of the table that they come from."""
    return ((number + (number >> 33) * 7919) % parts).astype(np.int32)


def packed_runs(number: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """(number, runs) of the texts of some suffixes, in any order and maybe repeated: runs are (first suffix, number of suffixes)."""
    o = np.lexsort((start, number))
    number, start = number[o], start[o].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (np.diff(start) > 1)]))
    n = start[np.append(first[1:] - 1, len(start) - 1)] - start[first] + 1
    own = number[first]
    text = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    runs = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(n)], ["first", "n"])
    return pa.RecordBatch.from_arrays([pa.array(own[text]), pa.ListArray.from_arrays(pa.array(np.append(text, len(first)).astype(np.int32)), runs)], names=["number", "runs"])


def _text(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*[c for c in docs.columns if c != "text"], text.alias("text"), F.unhex(F.md5(text)).alias("uid"))


def repeats(docs: DataFrame, span: int = 400, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(uid, runs) of the texts with repeats: runs are (first suffix, number of suffixes) that repeat.

    span and gram are bytes (8 in each token and 8 in a gram at least), or words.
    """
    spark = docs.sparkSession
    texts = _text(docs.select("text"))
    found = pa.schema([("least", pa.int64()), ("whole", pa.int64()), ("uid", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("twice", pa.bool_())])

    def sieved(column: pa.Array) -> Iterator[list[tuple[np.ndarray, ...]]]:
        held, rows, own = [], 0, column.to_pylist()
        for places, seq, owner in sequences(own, words, PIECE):
            *made, text = stretches_of(seq, owner, span, gram)
            held.append((*made, np.array(places)[text]))
            rows += len(text)
            if rows >= BATCH:
                yield held
                held, rows = [], 0
        if held:
            yield held
        for i, t in enumerate(own):
            if len(t) > PIECE // 4 and len(data := t.encode("utf-8", "surrogatepass")) > PIECE:
                for made in stretches(words_of(t) if words else data, span, gram):
                    yield [(*made, np.full(len(made[0]), i))]

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in sieved(batch.column("text")):
                least, whole, first, n, twice, text = (np.concatenate(c) for c in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("uid").take(pa.array(text)), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(twice)], schema=found)

    # Stored, as the sieve takes longer than its table; a text's key is a word of the column's dictionary.
    each = common.written(texts.mapInArrow(sieve, "least long, whole long, uid binary, first long, n long, twice boolean"), "stretches")
    live = common.written(each.groupBy("least").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("least"), "live")
    some = common.written(each.join(live, "least"), "some")
    common.dropped(each, live)
    twins = common.written(some.groupBy("least", "whole").agg(F.count("*").alias("c"), F.max("twice").alias("t"), F.min(F.struct("uid", "first", "n")).alias("s")), "twins")
    whole = some.join(twins.where("c > 1").select("least", "whole"), ["least", "whole"], "left_semi").groupBy("uid", "first").agg(F.max("n").alias("n"))
    single = twins.where("c = 1 or t").select("least").distinct()
    # Stretches whose suffixes are sorted: those without a twin, and one of each sort of twins that share their hash.
    sorted_ = common.written(common.keyed(twins.join(single, "least", "left_semi").select("s.uid", "s.first", "s.n").groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("parts"), F.sum("n").alias("n")), "number"), "sorted")
    size, count = sorted_.agg(F.sum("n"), F.count("*")).first()
    size = size or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seen: set[int] = set()
        for batch in batches:
            new = [i for i, n in enumerate(batch.column("number").to_pylist()) if n not in seen and not seen.add(n)]
            if new:
                own = batch.take(pa.array(new, pa.int64()))
                yield from tokens_of(own.column("text").to_pylist(), own.column("number").to_pylist(), own.column("parts"), span, words)

    # Copies of a text come to one task, or to a few where their group is split; each task reads one of them.
    def wanted(own: DataFrame, those: DataFrame) -> DataFrame:
        return own.join(those.select("uid", "number", "parts"), "uid").select("text", "number", "parts")

    # Splitters come from suffixes of some texts: to sample all would make all of them a second time.
    share = int(65536 * min(1.0, max(SAMPLED_TEXTS / max(1, count), SAMPLED * parts / max(1, size)))) + 1
    rate = min(1.0, SAMPLED * parts * 65536 / max(1, size * min(share, 65536)))
    few = f"pmod(xxhash64(uid), 65536) < {share}"

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number, start in suffixes(batches):
            own = np.flatnonzero((_mixed(t[:, 0] ^ _mixed(number.view(np.uint64) * _BASE + start.astype(np.uint64))) >> np.uint64(11)).astype(np.float64) < rate * (1 << 53))
            yield pa.RecordBatch.from_arrays(packets(np.zeros(len(own), np.int32), [*t[own].view(np.int64).T, number[own], start[own]]), names=["dest", "data"])

    sample = [bytes(r["data"]) for r in wanted(texts.where(few), sorted_.where(few)).mapInArrow(sampled, "dest int, data binary").collect()] if parts > 1 and size else []
    splitters = unpacked(sample, _KEY)
    order = np.lexsort(splitters[::-1])
    splitters = [c[order[np.arange(1, parts) * len(order) // parts] if len(order) else order] for c in splitters]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            t, *own = (np.concatenate(c) for c in zip(*held, strict=True))
            keys = [*np.ascontiguousarray(t.T).view(np.int64), *own]
            return pa.RecordBatch.from_arrays(packets(buckets_of(keys, splitters), keys), names=["dest", "data"])

        held, rows = [], 0
        for one in suffixes(batches):
            held.append(one)
            rows += len(one[1])
            if rows >= DEALT:
                yield made()
                held, rows = [], 0
        if held:
            yield made()

    key = [f"t{k}" for k in range(TOKENS)]
    edge_ddl = ", ".join(f"{k} long" for k in key) + ", number long, start int, repeated boolean, bucket int"
    made = wanted(texts, sorted_).mapInArrow(dealt, "dest int, data binary").repartitionById(parts, "dest").select("data")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        *t, number, start = unpacked([x for b in batches for x in b.column("data").to_pylist()], _KEY)
        if not len(number):
            return
        t = np.stack(t, axis=1)
        o = multikey_sort(t)
        t = t[o]
        new = np.concatenate([[True], (t[1:] != t[:-1]).any(axis=1)])
        run = np.cumsum(new) - 1
        n = np.bincount(run)
        many = n[run] > 1
        edge = (run == 0) | (run == run[-1])
        # Of a run at an edge one row stands for its key.
        at, hit = np.flatnonzero(edge & new), o[many]
        dest, data = packets(home(number[hit], parts), [number[hit], start[hit]])
        none, names = len(dest), [*key, "number", "start", "repeated", "bucket"]
        bucket = np.full(len(at), TaskContext.get().partitionId(), np.int32)
        columns = [pa.array(x) for x in (*np.ascontiguousarray(t[at].T), number[o[at]], start[o[at]], many[at], bucket)]
        columns = [pa.concat_arrays([c, pa.nulls(none, c.type)]) for c in columns]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.concat_arrays([pa.nulls(len(at), c.type), c]) for c in (dest, data)]], names=[*names, "dest", "data"])

    out = common.written(made.mapInArrow(compared, f"{edge_ddl}, dest int, data binary"), "compared")
    edges = out.where("bucket is not null")  # two rows of a bucket at most
    across = edges.groupBy(*key).agg(F.count_distinct("bucket").alias("buckets")).where("buckets > 1").select(*key)

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(c).to_numpy() for c in ("number", "start")]
            yield pa.RecordBatch.from_arrays(packets(home(own[0], parts), own), names=["dest", "data"])

    more = edges.where("not repeated").join(across, key, "left_semi").select("number", "start").mapInArrow(lone, "dest int, data binary")
    starts = out.where("dest is not null").select("dest", "data").unionByName(more)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, start = unpacked([x for b in batches for x in b.column("data").to_pylist()], _START)
        if len(number):
            yield packed_runs(number, start)

    # The starts of one text are at most its bytes and come to one task as they are; runs of them are few.
    each = starts.repartitionById(parts, "dest").select("data").mapInArrow(packed, "number long, runs array<struct<first:long,n:long>>").join(sorted_.select("number", "uid"), "number").select("uid", "runs")
    twinned = whole.groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    with common.longer_batches(spark):
        runs = common.written(each.unionByName(twinned).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    common.dropped(some, twins, sorted_, out)
    return runs


def covered(runs: list[dict], span: int) -> list[tuple[int, int]]:
    """The bytes that runs of suffixes cover, as maximal stretches [start, end)."""
    a = np.array([(r["first"], r["first"] + r["n"] - 1 + span) for r in runs], np.int64)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    far = np.maximum.accumulate(a[:, 1])
    new = np.concatenate([[True], a[1:, 0] > far[:-1]])
    at = np.flatnonzero(new)
    return list(zip(a[at, 0].tolist(), far[np.append(at[1:] - 1, len(a) - 1)].tolist(), strict=True))


def removed(docs: DataFrame, span: int = 400, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """Every row with the bytes that repeat.

    Returns the columns of `docs` but its text, with data (the bytes), spans (start, end of the
    removed runs) and kept (the remaining bytes), which take the place of columns of these names. With
    `passage`, n_passage_words counts the words covered by strings of so many words that repeat.
    """
    common.prepare(docs.sparkSession)
    runs = repeats(docs, span, gram)
    if passage:
        said = repeats(docs, passage, passage // 3, words=True)
        both = common.written(runs.join(said.withColumnRenamed("runs", "passages"), "uid", "full"), "both")
        common.dropped(runs, said)
        runs = both
    else:
        runs = runs.withColumn("passages", F.lit(None).cast(runs.schema["runs"].dataType))
    own = docs.drop("data", "spans", "kept", *(["n_passage_words"] if passage else []))
    all_ = _text(common.boxed(own, ("text",))).join(runs, "uid", "left")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, spans, kept, said = [], [], [], []
            for own in batch.column("passages").to_pylist():
                said.append(sum(b - a for a, b in covered(own, passage)) if own else 0)
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                b = text.encode("utf-8", "surrogatepass")
                gone = covered(own, span) if own else []
                ends = [0, *[x for s in gone for x in s], len(b)]
                data.append(b)
                spans.append([{"start": a, "end": z} for a, z in gone])
                kept.append(b"".join(b[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(data, pa.binary()), pa.array(spans, span_type), pa.array(kept, pa.binary()), pa.array(said, pa.int64())], names=["row", "data", "spans", "kept", "n_passage_words"])

    ddl = f"row {all_.schema['row'].dataType.simpleString()}, data binary, spans array<struct<start:long,end:long>>, kept binary, n_passage_words long"
    out = all_.select("row", "text", "runs", "passages").mapInArrow(cut, ddl)
    return out.select(*(["row.*"] if len(own.columns) > 1 else []), "data", "spans", "kept", *(["n_passage_words"] if passage else []))


def brute_force(texts: list[str | None], span: int = 400) -> list[tuple[int, int, int, str]]:
    """(bytes, removed bytes, runs, SHA-256 of the rest) of some texts, by comparing all their strings."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] = seen.get(b[i : i + span], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])).hexdigest()))
    return out
