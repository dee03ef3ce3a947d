"""SentencePiece encoding and decoding, and sampled segmentations without replacement.

The lattice of a text has a node for each character and an edge for each piece of the model's
vocabulary. An edge weighs the logarithm of a Zipf law over the pieces' ranks, sharpened by `alpha`;
backward sums over the lattice turn the weights into exact conditional probabilities, so a text's
segmentations have a normalised distribution.

Samples are drawn by a best-first (A*) search on Gumbel-perturbed log-probabilities. The root's value
is a Gumbel; a node's children get Gumbels of their own log-probabilities, conditioned on their
maximum being the node's value. The value of a node is thus the greatest of all segmentations below
it, and the search, which always opens the node of greatest value, emits the k segmentations of
greatest perturbed log-probability: a sample of k without replacement. The (k + 1)-th value kappa
gives each its inclusion score, 1 - exp(-exp(logp - kappa)).

Pieces never run across the start of a word, nor between marks and other characters where the
vocabulary has no such piece, so a text's lattice is a chain of its words' lattices.
Each distinct word is built once in a worker, and the descent to the end of a text opens many words
at a time. It works on exponential clocks, exp(-Gumbel): at a node the least clock wins, and the lead of
the winner over the second says how great a value the node's best branch keeps. Of the branches left
aside only the k of greatest value can still be emitted, so only the k nodes of least lead are opened
again, and no more branches are kept; that is exact.

Random numbers are hashes of the row's key, the round, the place and the edge: a row's samples depend
on its key and text alone, not on its batch or task.

Shapes of input with a defined result: a null text is an empty one, without ids, decoded to the empty
text, and its one segmentation (no pieces) has score 1; fewer segmentations than asked for are all
emitted; a null key counts as zero; equal keys and texts give equal samples; texts are read whole,
with or without white space; an empty table gives an empty result; other columns are ignored or, by
name, carried.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillrow.llm import common

#: Characters of a chunk of whole texts, and words of a chunk that are walked at once.
CHARS_AT_ONCE, WALKED_AT_ONCE = 500_000, 16_000
#: Ids of an Arrow batch of results, about.
BATCH_IDS = 500_000
#: Bytes of the lattices that a worker keeps between chunks.
MOST_BYTES = 300 << 20
#: Words that are copied at once where the most used are kept.
KEPT_AT_ONCE = 4_000


@dataclass(frozen=True)
class Room:
    """What a worker holds at once: characters of a chunk of whole texts, bytes of the lattices kept between chunks, ids of a batch of results, about."""

    chars: int
    lattices: int
    ids: int


#: Less memory at the price of time, for a stage whose executors other stages have filled before.
LITTLE = Room(100_000, 24 << 20, 100_000)
_WORD = re.compile("▁*[^▁]+|▁+")
#: Marks that make words of their own in a text where no piece can run from one of them into another character.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~\n"
_SORT = np.zeros(256, np.uint8)
_SORT[list(_MARKS.encode())] = 1
_P = np.uint64(0x100000001B3)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: What the n-th edge of a node adds to its bits; a node has an edge for each length of a piece at most, and one for its bytes.
_NTH = np.arange(1 << 10, dtype=np.uint64) * _GOLD


def mixed(x: np.ndarray) -> np.ndarray:
    """64 hashed bits of each number."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def clock(bits: np.ndarray) -> np.ndarray:
    """Exponential numbers of hashed bits."""
    u = (bits >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 1.0 / (1 << 53)
    return np.negative(np.log(u, out=u), out=u)


def ragged(off: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places off[i] .. off[i] + count[i] in order, the i of each, and where each i starts."""
    start = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) + (off - start).take(owner), owner, start


class Vocabulary:
    """A SentencePiece model with its pieces as a table of prefix hashes."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        rank = {i: r + 1 for r, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i)))}
        z = np.log(sum(1 / (r + 10) for r in rank.values()))
        self.logw = np.full(n, -np.log(n + 10) - z)
        for i, r in rank.items():
            self.logw[i] = -np.log(r + 10) - z
        self.logw *= alpha
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.rare = float(alpha * (-np.log(n + 10) - z))
        table: dict[int, int] = {}
        mask = (1 << 64) - 1
        for i in plain:
            h = 0
            for c in m.id_to_piece(i):
                h = ((h * int(_P)) + ord(c) + 1) & mask
                table.setdefault(h, -1)
            table[h] = i
        # Prefix hashes stand by slot, the leading bits of a product; head has each slot's first, several whether it has more.
        hashes = np.array(list(table), np.uint64)
        bits = max(4, len(table).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        slot = self.slot(hashes)
        o = np.argsort(slot, kind="stable")
        self.hash, self.piece = hashes[o], np.array(list(table.values()), np.int64)[o]
        filled = np.bincount(slot, minlength=1 << bits)
        self.head = np.where(filled > 0, np.cumsum(filled) - filled, 0).astype(np.int32)
        self.several, self.deepest = filled > 1, int(filled.max())
        # Words can be encoded on their own if no piece runs into a word and spaces are all kept.
        self.by_word = m.normalize("a") == "▁a" and m.normalize(" a") == "▁▁a" and not any("▁" in m.id_to_piece(i).lstrip("▁") for i in plain)
        pairs = {p[i : i + 2] for p in map(m.id_to_piece, plain) for i in range(len(p) - 1)}
        crossing = {c for p in pairs if (p[0] in _MARKS) != (p[1] in _MARKS) for c in p if c not in _MARKS and p[0] != "▁"}
        self.crosses = re.compile("[" + re.escape("".join(sorted(crossing))) + "]") if crossing else None
        # Ids that a letter, and a mark, before a word adds to its own.
        self.lead = {c: len(m.encode(c)) for c in "a!"}
        self.known = Known()
        self.longest = max((len(m.id_to_piece(i)) for i in plain), default=1)
        self.lone = m.piece_to_id("▁")
        # Characters of each piece within a word, and what each says.
        byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.chars = np.array([1 if i in byte else len(m.id_to_piece(i)) for i in range(n)], np.int64)
        self.says = [byte.get(i) or (b" \xe2\x81\x87 " if i == self.unknown else b"" if m.is_control(i) else m.id_to_piece(i).encode()) for i in range(n)]
        self.said = pa.array(self.says, pa.large_binary())
        # The pieces of characters alone, as find() has them.
        self.single = self.find(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
        # Of the texts of the present chunk, their normalised bytes.
        self.plain: dict[str, bytes] = {}

    def slot(self, h: np.ndarray) -> np.ndarray:
        """The slots of hashes."""
        return ((h * _GOLD) >> self.shift).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each prefix hash; -1 where it is a prefix only, -2 where it is none.

        A hash is compared with others of its slot alone: what stands at another slot's place never equals it.
        """
        slot = self.slot(h)
        at = self.head.take(slot)
        hit = self.hash.take(at) == h
        out = np.where(hit, self.piece.take(at), -2)
        left = np.flatnonzero(self.several.take(slot) & ~hit)
        for k in range(1, self.deepest):
            more = np.minimum(at[left] + k, len(self.hash) - 1)
            hit = self.hash[more] == h[left]
            out[left[hit]] = self.piece[more[hit]]
            left = left[~hit]
        return out

    def alone(self, code: np.ndarray) -> np.ndarray:
        """The piece of each character alone, as find() has it."""
        out, far = self.single.take(np.minimum(code, len(self.single) - 1).view(np.int64)), np.flatnonzero(code >= len(self.single))
        out[far] = self.find(code[far] + np.uint64(1))
        return out

    def normal(self, text: str) -> bytes:
        """A text as the model normalises it."""
        got = self.plain.get(text)
        return self.model.normalize(text).encode("utf-8", "surrogatepass") if got is None else got

    def spell(self, each: list[np.ndarray], said: bytes) -> bool:
        """Whether each of some ids decodes to a normalised text: what they say, one after the other, is the text as often."""
        count = [len(x) for x in each]
        _, at, data = self.said.take(pa.array(np.concatenate(each).astype(np.int64))).buffers()
        at = np.frombuffer(at, np.int64, sum(count) + 1)
        if (at[np.cumsum(count)] != np.arange(1, len(each) + 1) * len(said)).any():
            return False
        return not said or data.slice(0, len(said) * len(each)).equals(pa.py_buffer(said * len(each)))

    def words(self, plain: list[str], each: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of normalised texts and their bytes, the words as places in these, and where each text's start.

        No piece runs from one word into the next. A word is a run of spaces and what follows them up
        to the next; in texts where no piece can cross from a mark into another character or back,
        runs of marks are words of their own.
        """
        data = b"".join(each)
        ends = np.cumsum([len(x) for x in each])
        x = np.frombuffer(data, np.uint8)
        sort = _SORT[x]
        for t, e, end in zip(plain, each, ends.tolist(), strict=True):
            if not self.crosses or self.crosses.search(t):
                sort[end - len(e) : end] = 0
        lead = np.flatnonzero((x[:-2] == 0xE2) & (x[1:-1] == 0x96) & (x[2:] == 0x81))
        for k in range(3):
            sort[lead + k] = 2
        new = np.ones(len(x) + 1, bool)
        new[1:-1] = (sort[1:] != sort[:-1]) & (sort[:-1] != 2)
        new[ends] = True
        at = np.flatnonzero(new).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(at, np.concatenate([[0], ends]))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The model's own ids of words; one without a space before it is encoded behind a character of the other sort."""
        lead = ["" if w[0] == "▁" else "a" if w[0] in _MARKS else "!" for w in words]
        each = self.model.encode([c + w.replace("▁", " ") if c else w[1:].replace("▁", " ") for c, w in zip(lead, words, strict=True)], num_threads=1)
        one = [self.lone]  # no text makes a lone mark
        return [one if w == "▁" else x[self.lead[c] :] if c else x for c, w, x in zip(lead, words, each, strict=True)]

    def bytes_of(self, char: int) -> list[int]:
        """Byte pieces of a character, or the unknown piece."""
        ids = [self.byte.get(b) for b in chr(char).encode("utf-8", "replace")]
        return [self.unknown] if None in ids else ids


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    """The model of this worker process."""
    return Vocabulary(path, alpha)


common.remembers("pieces", vocabulary.cache_clear)


class Lattices:
    """Lattices of some words, one after the other.

    A node is a place in the joined words; first has each word's first node. Edges of a node are off
    and count in piece (or -1 - character for its bytes), to (next node, -1 at a word's end) and cond
    (log of the conditional probability).
    """

    def __init__(self, words: list[str], v: Vocabulary) -> None:
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.first = np.cumsum(size) - size
        end = np.repeat(self.first + size, size)
        left = end - np.arange(len(code))
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        src, length, piece = [], [], []
        single = np.zeros(len(code), bool)
        for n in range(1, v.longest + 1):
            h *= _P
            h += code.take(at + (n - 1))
            h += np.uint64(1)
            found = v.find(h) if n > 1 else v.alone(code)
            whole = np.flatnonzero(found >= 0)
            src.append(at.take(whole))
            length.append(np.full(len(whole), n))
            piece.append(found.take(whole))
            if n == 1:
                single[src[0]] = True
            go = np.flatnonzero((found > -2) & (left.take(at) > n))
            at, h = at.take(go), h.take(go)
            if not len(at):
                break
        rare = np.flatnonzero(~single)
        src.append(rare)
        length.append(np.ones(len(rare), np.int64))
        piece.append(-1 - code[rare].astype(np.int64))
        src, length, piece = np.concatenate(src), np.concatenate(length), np.concatenate(piece)
        o = np.argsort(src, kind="stable")
        src, length, self.piece = src[o], length[o], piece[o]
        # A character of one byte has one piece, if the model has bytes.
        small = np.flatnonzero((self.piece < 0) & (self.piece >= -128))
        self.piece[small] = [v.byte.get(-1 - p, p) for p in self.piece[small].tolist()]
        one = np.zeros(len(self.piece), bool)
        one[small] = True
        self.count = np.bincount(src, minlength=len(code))
        self.off = np.cumsum(self.count) - self.count
        self.to = np.where(src + length == end[src], -1, src + length)
        many = self.piece < 0
        w = np.where(one, v.rare, v.logw[np.where(many, 0, self.piece)])
        if many.any():
            w[many] = [v.rare * len(v.bytes_of(-1 - int(p))) for p in self.piece[many]]
        # Backward sums, nodes nearest to their word's end first, each distance's edges as a run.
        beta = np.zeros(len(code) + 1)
        short = left.astype(np.int16) if size.max(initial=0) < 1 << 15 else left
        nodes = np.argsort(short, kind="stable")
        o = np.argsort(short.take(src), kind="stable")
        some, to, each = w.take(o), self.to.take(o), self.count.take(nodes)
        begin = np.cumsum(each) - each
        cut = np.append(np.flatnonzero(np.diff(left.take(nodes), prepend=-1)), len(nodes)).tolist()
        for a, b in zip(cut, cut[1:], strict=False):
            at, end = begin[a], begin[b - 1] + each[b - 1]
            x = some[at:end] + beta.take(to[at:end])  # the last of beta, at -1, stays zero
            top = np.maximum.reduceat(x, begin[a:b] - at)
            x -= np.repeat(top, each[a:b])
            beta[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(x, out=x), begin[a:b] - at))
        self.cond = w + beta.take(self.to) - beta.take(src)


class Growing:
    """An array that grows at its end, with room to spare; what isn't filled yet takes no memory."""

    def __init__(self, kind: type, room: int = 1024) -> None:
        self.data, self.size = np.empty(room, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            room = np.empty(max(need, len(self.data) * 5 // 4), self.data.dtype)
            room[: self.size] = self.data[: self.size]
            self.data = room
        self.data[self.size : need] = more
        self.size = need

    @property
    def used(self) -> np.ndarray:
        return self.data[: self.size]


class Known:
    """The lattices of words seen before, and the model's own ids of each, as if all were built at once.

    By word: first node, size in nodes, ids_off, ids_count and uses; by node: off and count of its
    edges; by edge: piece and mean, the reciprocal of its conditional probability.
    """

    KINDS = {"first": np.int32, "size": np.int32, "ids_off": np.int32, "ids_count": np.int32, "uses": np.int32, "off": np.int32, "count": np.int32, "piece": np.int32, "mean": np.float64, "ids": np.uint32}

    def __init__(self, like: Known | None = None) -> None:
        """None yet, with room for as many as `like` has."""
        self.words: dict[str, int] = {}
        self.parts = {k: Growing(t, *([len(like.parts[k].data)] if like else [])) for k, t in self.KINDS.items()}

    def __getattr__(self, name: str) -> np.ndarray:
        return self.parts[name].used

    def bytes(self) -> int:
        """Bytes held, with about 200 for the text and the number of each word."""
        return sum(p.used.nbytes for p in self.parts.values()) + 200 * len(self.words)

    def numbers(self, words: list[str], v: Vocabulary) -> np.ndarray:
        """Numbers of distinct words; new ones are built together."""
        got = list(map(self.words.get, words))
        new = [w for w, g in zip(words, got, strict=True) if g is None]
        if new:
            lat, p, start = Lattices(new, v), self.parts, len(self.words)
            node, edge = p["off"].size, p["piece"].size
            p["first"].extend(lat.first + node)
            p["size"].extend(np.diff(np.append(lat.first, len(lat.count))))
            p["off"].extend(lat.off + edge)
            p["count"].extend(lat.count)
            p["piece"].extend(lat.piece)
            p["mean"].extend(np.exp(np.minimum(-lat.cond, 700.0)))
            p["uses"].extend(np.zeros(len(new), np.int32))
            if v.by_word:
                each = v.encode_words(new)
                count = np.fromiter(map(len, each), np.int64, len(each))
                p["ids_off"].extend(np.cumsum(count) - count + p["ids"].size)
                p["ids_count"].extend(count)
                p["ids"].extend(np.fromiter(chain.from_iterable(each), np.uint32, int(count.sum())))
            self.words.update(zip(new, range(start, start + len(new)), strict=True))
            more = iter(range(start, start + len(new)))
            got = [next(more) if g is None else g for g in got]
        return np.array(got, np.int64)

    def often_used(self, share: float) -> Known:
        """The words used most, as many as fill the share of this one's edges; all count as unused."""
        edges = np.add.reduceat(self.count, self.first) if len(self.words) else np.zeros(0, np.int64)
        most = np.argsort(-self.uses, kind="stable")
        kept = most[np.cumsum(edges[most]) <= share * self.parts["piece"].size]
        out, p = Known(self), self.parts
        texts = list(self.words)
        out.words = {texts[i]: n for n, i in enumerate(kept.tolist())}
        # A part at a time, as the places of all edges would take more room than the edges.
        for own in np.split(kept, range(KEPT_AT_ONCE, len(kept), KEPT_AT_ONCE)):
            node, _, first = ragged(self.first[own].astype(np.int64), self.size[own].astype(np.int64))
            edge, _, off = ragged(self.off[node].astype(np.int64), self.count[node].astype(np.int64))
            made = {"first": first + out.parts["off"].size, "size": self.size[own], "uses": np.zeros(len(own), np.int32), "off": off + out.parts["piece"].size, "count": self.count[node], "piece": self.piece[edge], "mean": self.mean[edge]}
            if p["ids_off"].size:
                ids, _, at = ragged(self.ids_off[own].astype(np.int64), self.ids_count[own].astype(np.int64))
                made |= {"ids": self.ids[ids], "ids_off": at + out.parts["ids"].size, "ids_count": self.ids_count[own]}
            for k, x in made.items():
                out.parts[k].extend(x)
        return out


@dataclass
class Leaf:
    """A segmentation: the edges of its path, its log-probability and its perturbed value."""

    edges: np.ndarray
    logp: float
    value: float


class Sampler:
    """Search over some texts at a time; words are places in the lattices."""

    def __init__(self, lat: Known, words: np.ndarray, start: np.ndarray, keys: np.ndarray, k: int, chars: np.ndarray) -> None:
        self.lat, self.start, self.k, self.keys = lat, start, k, keys
        self.root = lat.first[words].astype(np.int64)
        self.last = self.root + lat.size[words]
        self.doc_of = np.repeat(np.arange(len(start) - 1), np.diff(start))
        self.chars = np.append(chars, 1)  # the last is that of a character's bytes, piece -1 or less

    def times(self, w: np.ndarray, cur: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges of nodes cur of words w, how many each node has, where each node's start, and their clocks."""
        count = self.lat.count[cur]
        first = np.cumsum(count, dtype=np.int64) - count
        nth = np.arange(count.sum(dtype=np.int64)) - np.repeat(first, count)
        e = np.repeat(self.lat.off[cur], count) + nth
        doc = self.doc_of[w]
        own = mixed(salt[doc] + (w - self.start[doc]).astype(np.uint64) * _GOLD + (cur - self.root[w]).astype(np.uint64))
        bits = mixed(np.repeat(own, count) + nth.astype(np.uint64) * _GOLD)
        return e, count, first, clock(bits) * self.lat.mean[e]

    def after(self, cur: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The nodes that edges of nodes lead to."""
        return cur + self.chars.take(np.maximum(self.lat.piece.take(edge), -1))

    def won(self, node: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edge of least clock of each node, from its bits, the logarithm of its lead over the second, and the nodes' order in both.

        Nodes with more edges come first, so that the k-th edges of all that have one are a run; clocks are those of `times`.
        """
        count = self.lat.count.take(node)
        o = np.argsort((-count).astype(np.int16), kind="stable")  # short numbers are sorted by their digits
        has = len(node) - np.cumsum(np.bincount(count))[:-1]
        off, own = self.lat.off.take(node.take(o)), own.take(o)
        ends = np.cumsum(has).tolist()
        e, bits = np.empty(ends[-1], off.dtype), np.empty(ends[-1], np.uint64)
        for k, (n, end) in enumerate(zip(has.tolist(), ends, strict=True)):
            np.add(off[:n], k, out=e[end - n : end])
            np.add(own[:n], _NTH[k], out=bits[end - n : end])
        t = clock(mixed(bits))
        t *= self.lat.mean.take(e)
        low, second, nth = t[: len(node)].copy(), np.full(len(node), np.inf), np.zeros(len(node), off.dtype)
        for k, (n, end) in enumerate(zip(has.tolist(), ends, strict=True)):
            if k:
                x, least = t[end - n : end], low[:n]
                np.putmask(nth[:n], x < least, k)
                np.minimum(second[:n], np.maximum(x, least), out=second[:n])
                np.minimum(least, x, out=least)
        with np.errstate(divide="ignore"):
            return off + nth, np.log(second - low), o

    def walk(self, w: np.ndarray, cur: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Visits of each word, and for each visit, in order, the edge taken and the logarithm of its lead.

        A word that ends makes room for the next one, so that each step is taken by as many words.
        """
        steps, seen, given = np.zeros(len(w), np.int32), [], 0
        doc, last = self.doc_of[w], self.last[w]
        base = salt[doc] + (w - self.start[doc]).astype(np.uint64) * _GOLD - self.root[w].view(np.uint64)
        place = node = np.zeros(0, np.int64)
        nth = np.zeros(0, np.int32)
        while len(place) or given < len(w):
            more = min(len(w) - given, WALKED_AT_ONCE - len(place))
            if more > WALKED_AT_ONCE // 8 or not len(place):
                place, node, nth = np.append(place, np.arange(given, given + more)), np.append(node, cur[given : given + more]), np.append(nth, np.zeros(more, np.int32))
                given += more
            taken, lead, o = self.won(node, mixed(base.take(place) + node.view(np.uint64)))
            place, node, nth = place.take(o), node.take(o), nth.take(o)
            seen.append((place.astype(np.int32), nth, taken.astype(np.int32, copy=False), lead))
            node, nth = self.after(node, taken), nth + np.int32(1)
            on = node < last.take(place)
            go, done = np.flatnonzero(on), np.flatnonzero(~on)
            steps[place.take(done)] = nth.take(done)
            place, node, nth = place.take(go), node.take(go), nth.take(go)
        begin = np.cumsum(steps, dtype=np.int64) - steps
        out = [np.empty(int(steps.sum()), k) for k in (np.int64, np.float64)]
        for place, nth, *found in seen:
            at = begin.take(place) + nth
            for o, x in zip(out, found, strict=True):
                o[at] = x
        return steps, *out

    def descend(self, jobs: list[tuple[int, int, int, float, float]], turn: int) -> Iterator[tuple[np.ndarray, float, list[tuple[float, int, int, int, int, float]]]]:
        """Best paths to the end, each from (text, word, node, logp, value); node -1 is the word's first.

        Returns for each the chosen edges, the whole logp, and its k best branches: (value, edges
        chosen before it, word, node after it or -1 at the word's end, edge, logp after it).
        """
        doc, word, node, logp, value = (np.array(x) for x in zip(*jobs, strict=True))
        word = word.astype(np.int64)
        w, job, at = ragged(word, self.start[doc + 1] - word)
        cur = self.root[w]
        inside = (node >= 0) & (self.start[doc + 1] > word)
        cur[at[inside]] = node[inside]
        salt = mixed(self.keys + np.array([turn + 1], np.uint64) * _GOLD)
        steps, taken, lead = self.walk(w, cur, salt)
        own = np.repeat(job, steps)
        n = np.bincount(own, minlength=len(jobs))
        ends = np.cumsum(n)
        step = -np.log(self.lat.mean.take(taken))
        run = np.append(0.0, np.cumsum(step))
        base = run[ends - n]
        total = run[ends] - base + logp
        before = run[:-1] - np.repeat(base, n) + np.repeat(logp, n)
        late = lead - before
        some = [a + (np.arange(b - a) if b - a <= self.k else np.argpartition(late[a:b], self.k)[: self.k]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        branches = self.branches(np.concatenate(some), w, steps, taken, before, own, value, salt) if len(own) else {}
        for j, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
            yield taken[a:b], float(total[j]), [(x, visit - a, *more) for x, visit, *more in branches.get(j, [])]

    def branches(self, at: np.ndarray, words: np.ndarray, steps: np.ndarray, taken: np.ndarray, before: np.ndarray, job: np.ndarray, value: np.ndarray, salt: np.ndarray) -> dict[int, list[tuple]]:
        """By job the k best branches off its visits `at`: (value, visit, word, node after it or -1, edge, logp after it)."""
        # The word of each visit, and the node that its edge leaves: edges stand in order of their nodes.
        w, nodes = words[np.searchsorted(np.cumsum(steps), at, "right")], np.searchsorted(self.lat.off, taken[at], "right") - 1
        e, count, first, t = self.times(w, nodes, salt)
        owner = np.repeat(np.arange(len(at)), count)
        low = t[first + taken[at] - e[first]]
        side = np.flatnonzero(e != taken[at][owner])
        e, owner, t = e[side], owner[side], t[side]
        visit = at[owner]
        with np.errstate(divide="ignore"):
            x = -np.logaddexp(-value[job[visit]], np.log(t - low[owner]) - before[visit])
        o = np.lexsort((e, visit, -x, job[visit]))
        e, visit, owner, x = e[o], visit[o], owner[o], x[o]
        own = job[visit]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        e, visit, owner, x, own = (c[rank < self.k] for c in (e, visit, owner, x, own))
        to = self.after(nodes[owner], e)
        to = np.where(to >= self.last[w[owner]], -1, to)
        lp = before[visit] - np.log(self.lat.mean[e])
        out: dict[int, list[tuple]] = {}
        for j, *row in zip(*(c.tolist() for c in (own, x, visit, w[owner], to, e, lp)), strict=True):
            out.setdefault(j, []).append(tuple(row))
        return out

    def sample(self) -> list[tuple[list[Leaf], float]]:
        """Of each text the k segmentations, greatest value first, and kappa (minus infinity if there are no more)."""
        docs = len(self.start) - 1
        root = -np.log(clock(mixed(self.keys ^ np.uint64(0xD1B54A32D192ED03))))
        leaves: list[list[Leaf]] = [[] for _ in range(docs)]
        heaps: list[list] = [[] for _ in range(docs)]
        jobs = [(d, int(self.start[d]), -1, 0.0, float(root[d])) for d in range(docs)]
        prefix = [np.zeros(0, np.int64)] * docs
        kappa = np.full(docs, -np.inf)
        for turn in range(self.k):
            for (d, _, _, _, value), pre, (path, logp, branches) in zip(jobs, prefix, self.descend(jobs, turn) if jobs else [], strict=True):
                whole = np.concatenate([pre, path])
                leaves[d].append(Leaf(whole, logp, value))
                for v, rank, word, to, edge, lp in branches:
                    heapq.heappush(heaps[d], (-v, turn, len(pre) + rank, edge, word, to, lp))
            jobs, prefix = [], []
            for d in range(docs):
                if len(leaves[d]) != turn + 1 or not heaps[d]:
                    continue
                v, of, rank, edge, word, to, lp = heapq.heappop(heaps[d])
                if turn + 1 == self.k:
                    kappa[d] = -v
                    continue
                jobs.append((d, word if to >= 0 else word + 1, to, lp, -v))
                prefix.append(np.append(leaves[d][of].edges[:rank], edge))
        return list(zip(leaves, kappa.tolist(), strict=True))


def ids_of(edges: np.ndarray, lat: Lattices | Known, v: Vocabulary) -> np.ndarray:
    """Piece ids of a path."""
    p = lat.piece[edges]
    if (p >= 0).all():
        return p.astype("<u4")
    return np.array([i for x in p.tolist() for i in ([x] if x >= 0 else v.bytes_of(-1 - x))], "<u4")


#: A sample: ids, log-probability, perturbed value and inclusion score.
Sample = tuple[np.ndarray, float, float, float]


def segmentations(texts: list[str], keys: list[int | None], v: Vocabulary, k: int, seed: int, room: Room | None = None) -> Iterator[tuple[np.ndarray, list[Sample]]]:
    """For each text the model's own ids, and its samples."""
    room = room or Room(CHARS_AT_ONCE, MOST_BYTES, BATCH_IDS)
    at = 0
    while at < len(texts):
        plain, size, begun = [], 0, at
        while at < len(texts) and (not plain or size < room.chars):
            plain.append(v.model.normalize(texts[at]))
            size += len(plain[-1])
            at += 1
        if v.known.bytes() > room.lattices:
            v.known = v.known.often_used(0.4)
        lat = v.known
        said = [t.encode("utf-8", "surrogatepass") for t in plain]
        v.plain = dict(zip(texts[begun:at], said, strict=True))
        words, which, start = v.words(plain, said)
        own = lat.numbers(words, v)[which]
        lat.uses[:] += np.bincount(own, minlength=len(lat.words)).astype(np.int32)
        if v.by_word:
            place, owner, _ = ragged(lat.ids_off[own].astype(np.int64), lat.ids_count[own].astype(np.int64))
            best = np.split(lat.ids[place].astype("<u4"), np.searchsorted(owner, start[1:-1]))
        else:
            best = [np.array(x, "<u4") for x in v.model.encode(texts[begun:at], num_threads=1)]
        hashed = mixed(np.array([x or 0 for x in keys[begun:at]], np.int64).view(np.uint64) + np.array([seed], np.uint64) * _GOLD)
        found = Sampler(lat, own, start, hashed, k, v.chars).sample()
        for ids, (leaves, kappa) in zip(best, found, strict=True):
            yield ids, [(ids_of(x.edges, lat, v), x.logp, x.value, 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(x.logp - kappa, 700.0))))) for x in leaves]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


_SAMPLE = [("rank", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("logp", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]
_SAMPLE_DDL = "rank:int,n_pieces:long,ids_crc32:long,logp:double,perturbed:double,inclusion:double"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """A list column of id arrays, without a Python object for each id."""
    values = np.concatenate([np.zeros(0, "<u4"), *rows]).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(values))


def _columns(found: list[tuple[np.ndarray, bool, list[Sample]]], with_ids: bool) -> list[pa.Array]:
    """n_pieces, ids_crc32, decodes, samples and, `with_ids`, ids of some texts."""
    each = [(n + 1, *m) for _, _, samples in found for n, m in enumerate(samples)]
    fields = [[m[0] for m in each], [len(m[1]) for m in each], [_crc(m[1]) for m in each], [m[2] for m in each], [m[3] for m in each], [m[4] for m in each]]
    columns = [pa.array(x, t) for x, (_, t) in zip(fields, _SAMPLE, strict=True)]
    names = [n for n, _ in _SAMPLE]
    if with_ids:
        columns, names = [*columns, _lists([m[1] for m in each])], [*names, "ids"]
    samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for *_, s in found)]).astype(np.int32)), pa.StructArray.from_arrays(columns, names))
    own = [ids for ids, *_ in found]
    out = [pa.array([len(x) for x in own], pa.int64()), pa.array([_crc(x) for x in own], pa.int64()), pa.array([d for _, d, _ in found], pa.bool_()), samples]
    return [*out, _lists(own)] if with_ids else out


def encode(docs: DataFrame, model: str, key: str = "doc_id", k: int = 2, alpha: float = 1.0, seed: int = 23, with_ids: bool = True, room: Room | None = None) -> DataFrame:
    """Ids of every whole text, whether they decode to it, and k sampled segmentations.

    Returns `key`, n_pieces, ids_crc32, decodes, samples (rank from 1, n_pieces, ids_crc32, logp,
    perturbed, inclusion and, `with_ids`, ids), and `with_ids` also ids. decodes is true if the ids
    and each sample decode to the normalised text. `room` bounds the memory of a worker process;
    ids, samples and values don't depend on it, but for the last digits of sums.
    """
    common.prepare(docs.sparkSession)
    ids_at_once, own = (room.ids, [room]) if room else (BATCH_IDS, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        names = [key, "n_pieces", "ids_crc32", "decodes", "samples", *(["ids"] if with_ids else [])]
        for batch in batches:
            texts, keys = [t.as_py() or "" for t in batch.column("text")], batch.column("key")
            held, at, size = [], 0, 0
            with common.uncollected():
                for text, (ids, samples) in zip(texts, segmentations(texts, keys.to_pylist(), v, k, seed, *own), strict=True):
                    held.append((ids, v.spell([ids, *(m[0] for m in samples)], v.normal(text)), samples))
                    size += len(ids) * (k + 1)
                    if size >= ids_at_once or at + len(held) == len(texts):
                        yield pa.RecordBatch.from_arrays([keys.slice(at, len(held)), *_columns(held, with_ids)], names=names)
                        held, at, size = [], at + len(held), 0

    picked = docs.selectExpr(f"cast(`{key}` as long) as key", "text")
    ids = ",ids:array<int>" if with_ids else ""
    ddl = f"`{key}` long, n_pieces long, ids_crc32 long, decodes boolean, samples array<struct<{_SAMPLE_DDL}{ids}>>" + (", ids array<int>" if with_ids else "")
    return picked.mapInArrow(common.served(run, "pieces"), ddl)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """`encoded` with text, what its ids say; null ids say the empty text."""
    from pyspark.sql import functions as F

    common.prepare(encoded.sparkSession)

    @F.pandas_udf("string")
    def said(column):  # noqa: ANN001, ANN202
        import pandas as pd

        m = vocabulary(model, 1.0).model
        return pd.Series([m.decode([] if x is None else [int(i) for i in x]) for x in column], dtype=object)

    return encoded.withColumn("text", said(ids))
