"""SimHash near-dedup with pivot distance tables.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints get a table of their
Hamming distances to many reference fingerprints, kept by segment of the word: the distance to a
reference is the sum over the segments, and by the triangle inequality no coordinate of two
fingerprints within distance t differs by more than t.

Candidates come from the table's segments: of `s` segments, two fingerprints within `t` bits agree
in at least `s - t`, and so have equal distances there to every reference. Fingerprints therefore
meet under the distances of each choice of `s - t` segments; pairs whose largest coordinate
difference exceeds `t` are discarded; survivors are verified bit by bit. `s` grows with the number of
distinct fingerprints, so that the groups that meet stay short. A group that is still long is split
in blocks, and each pair of blocks is a group of its own: no pair is dropped.

Shapes of input with a defined result: a null text is an empty one; a text without words has
fingerprint zero and links like any other; fewer words than a shingle make one shingle of all words;
equal texts, and equal fingerprints, are one node however many they are; a null doc_id takes no part
in choosing a component but gets its own row; repeated rows are all returned; an empty table gives an
empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common
from quillrow.llm.components import components, local_stars

#: Number of reference fingerprints, and the seed that they are drawn with.
REFERENCES, SEED = 16, 64
#: Fingerprints of a block of a long group, and the group length aimed at.
BLOCK, AIM = 512, 64
#: Rows compared at once.
CHUNK = 1 << 15
#: Shingles hashed at once, to bound memory on long texts.
PIECE = 1 << 16
#: Segments at most; 8 of 64 bits meet under 32 equal bits.
MOST_SEGMENTS = 8
#: Least similarity of the shingle sets that deduplicated() links, as a fraction.
LEAST = (4, 5)
#: Bands of the shingle sets' least hashes, and hashes of a band: sets of similarity 0.8 share a band with a chance of 0.998.
BANDS, ROWS = 16, 5
#: Words of the sketches of sets in crowded groups, and bits that differ at most: 4.5 deviations above the mean of a similarity of 0.8.
SKETCH, SKETCH_BITS = 64, 723
#: Bits that differ in sketches at a similarity of about 0.8, on average.
NEAR_BITS = 600
#: Pairs of a group that are checked one by one at once; a group of more gives stars first.
FEW = 64


def references() -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, REFERENCES, np.uint64, endpoint=False)


def mixed(h: np.ndarray) -> np.ndarray:
    """Further 64 bits from each 64-bit hash, by multiplication and shifts."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles, repeats included, some at a time; none of a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([hashed(line, 42)], "<u8")
        return
    space = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    start = np.concatenate([[0], space + 1])[: len(words) - size + 1].tolist()
    end = np.concatenate([space, [len(line)]])[size - 1 :].tolist()
    for at in range(0, len(start), PIECE):
        yield np.array([hashed(line[i:j], 42) for i, j in zip(start[at : at + PIECE], end[at : at + PIECE], strict=True)], "<u8")


def majority(parts: Iterator[np.ndarray]) -> tuple[int, int]:
    """Bit is 1 if set in over half of the hashes; the second number is made likewise of further bits of each."""
    ones, n = np.zeros(128, np.int64), 0
    for h in parts:
        n += len(h)
        for k, x in enumerate((h, mixed(h))):
            ones[64 * k : 64 * k + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    first, second = np.packbits(2 * ones > n, bitorder="little").view("<u8").tolist()
    return first, second


def fingerprint(text: str | None, size: int) -> tuple[int, int]:
    """Both words of bits of a text's shingles, repeats included; zero of a text without words."""
    return majority(hashes(text, size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *hashes(text, size)]))


def sketch(x: np.ndarray) -> bytes:
    """SKETCH words of bits of a set, each made like a fingerprint from further bits of its hashes."""
    ones = np.zeros(64 * SKETCH, np.int64)
    for at in range(0, len(x), PIECE // 16):
        h = x[at : at + PIECE // 16]
        for k in range(SKETCH):
            h = mixed(h + np.uint64(0x9E3779B97F4A7C15))
            ones[64 * k : 64 * k + 64] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(x), bitorder="little").tobytes()


def band_keys(x: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes of a set, under BANDS * ROWS odd multipliers; zeros of an empty set."""
    if not len(x):
        return np.zeros(BANDS, np.uint64)
    by = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.min([(x[at : at + PIECE // 16, None] * by).min(axis=0) for at in range(0, len(x), PIECE // 16)], axis=0)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def segment_masks(segments: int) -> np.ndarray:
    """Masks that cut 64 bits into so many segments."""
    return np.array([sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), segments)], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Distances by fingerprint, segment and reference."""
    diff = fps[:, None] ^ refs[None, :]
    return np.stack([np.bitwise_count(diff & m) for m in masks], axis=1)


def segments_for(n: int, within: int) -> int:
    """Segments with which n spread fingerprints meet in groups of about AIM or fewer."""
    for s in range(within + 1, MOST_SEGMENTS + 1):
        if log2(max(n, 2)) - 64 * (s - within) / s <= log2(AIM):
            return s
    return MOST_SEGMENTS


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some pairs those that join labels, no more than needed; `label`, by place, is brought up to date."""
    u, v = [x[:0]], [y[:0]]
    while True:
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        far = np.flatnonzero(high != low)
        if not len(far):
            return np.concatenate(u), np.concatenate(v)
        x, y, high, low = x[far], y[far], high[far], low[far]
        # Each label goes to one smaller one, so no pair closes a circle.
        tops, at = np.unique(high, return_index=True)
        u.append(x[at])
        v.append(y[at])
        parent = np.arange(len(label))
        parent[tops] = low[at]
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]
        label[:] = parent[label]


def linked(fps: np.ndarray, more: np.ndarray, group: np.ndarray, side: np.ndarray, within: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of one group (rows sorted by group) within so many bits.

    wide is the most bits that may differ in both words together. side is 0 or 1 in the groups that compare two blocks, where pairs of one side are left out, and 2
    elsewhere.
    """
    table = np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)
    for lag in range(1, len(fps)):
        at = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(at):
            return
        at = at[(side[at] == 2) | (side[at] != side[at + lag])]
        # Pivot table first: pairs with too large a coordinate difference are discarded, a few references at a time.
        for some in np.array_split(np.arange(REFERENCES), 4):
            if len(at):
                at = at[np.abs(table[at][:, some] - table[at + lag][:, some]).max(axis=1) <= within]
        bits = np.bitwise_count(fps[at] ^ fps[at + lag])
        at = at[(bits <= within) & (bits + np.bitwise_count(more[at] ^ more[at + lag]) <= wide)]
        if len(at):
            yield at, at + lag


def fingerprints(docs: DataFrame, size: int = 4, wide: bool = False) -> DataFrame:
    """`docs` with fp and more, the two words as signed longs, in place of its text; more is 0 unless `wide`."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1, 2)
            if not wide:
                both[:, 1] = 0
            words = [pa.array(both[:, k].copy().view(np.int64), pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *words], names=[*others, "fp", "more"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select(*others, "text").mapInArrow(common.served(run, "simhash"), f"{ddl}, fp long, more long")


def links(nodes: DataFrame, within: int, wide: int = 128, segments: int | None = None, agree: int | None = None) -> DataFrame:
    """Links (a, b) between the reps of fingerprints (fp, more, rep): a star of each group's components.

    Nodes may have bands, keys of which each makes its nodes meet; without them they meet by segments.
    They may also have n, the size of their set of shingles: then pairs whose sizes alone keep them
    below LEAST are left out, and all others returned, but in groups of more than FEW pairs, which give
    a link of each of their nodes with itself. If they have sketch, the pairs of a forest that spans
    what near sketches join are returned; if they have label too, every pair of different labels whose
    sketches aren't far.

    By segments, every pair within so many bits meets; where `segments` and `agree` are given, pairs
    that differ in `segments - agree` bits or fewer always meet, and others mostly while bits fall
    together.
    """
    spark = nodes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    banded = "bands" in nodes.columns
    segments = 0 if banded else segments or segments_for(nodes.count(), within)
    choices = list(combinations(range(segments), agree or segments - within)) if segments else []
    own_columns = ["fp", "more", "rep", *[c for c in ("n", "label", "sketch") if c in nodes.columns]]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, masks = references(), segment_masks(max(1, segments))
        schema = pa.schema([(c, pa.binary() if c == "sketch" else pa.int64()) for c in ("meet", *own_columns)])
        for batch in batches:
            if banded:
                keys = batch.column("bands").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
                for c in range(keys.shape[1]):
                    yield pa.RecordBatch.from_pydict({"meet": mixed(keys[:, c] + np.uint64(c + 1)).view(np.int64), **{c: batch.column(c) for c in own_columns}}, schema=schema)
                continue
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            table = distance_table(fp.view(np.uint64), refs, masks)
            # One word for the distances of each segment; a choice's key mixes the words of its segments.
            words = np.array([[xxhash.xxh64_intdigest(t.tobytes(), s) for s, t in enumerate(row)] for row in table], np.uint64).reshape(-1, segments)
            for c, chosen in enumerate(choices):
                meet = mixed(np.bitwise_xor.reduce([mixed(words[:, s] + np.uint64(s)) for s in chosen]) + np.uint64(c + 1))
                yield pa.RecordBatch.from_pydict({"meet": meet.view(np.int64), **{c: batch.column(c) for c in own_columns}}, schema=schema)

    # Computed twice, for the counts and for the pairs, rather than stored.
    rows = nodes.select(*own_columns, *(["bands"] if banded else [])).mapInArrow(common.served(meeting, "simhash"), ", ".join(f"{c} {'binary' if c == 'sketch' else 'long'}" for c in ("meet", *own_columns)))
    long = common.written(rows.groupBy("meet").count().where(F.col("count") > BLOCK).select("meet", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "long")
    own = F.pmod(F.xxhash64("fp", "more", "rep"), F.col("blocks")).cast("int")
    # Block i of b meets itself and every other block once: pairs (i, j), i <= j.
    paired = rows.join(_small(long, long.count()), "meet", "left").withColumn("own", own)
    short = paired.where(F.col("blocks").isNull()).select("meet", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), *own_columns)
    split = paired.where(F.col("blocks").isNotNull()).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    split = split.select("meet", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.cast("int").alias("side"), *own_columns)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: rows.column(c).to_numpy() for c in ("meet", "i", "j", "side", *own_columns) if c != "sketch"}
            more = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH) if "sketch" in own_columns else None
            new = np.any([np.diff(col[c]) != 0 for c in ("meet", "i", "j")], axis=0)
            group = np.concatenate([[0], np.cumsum(new)])
            u, v, label = [], [], np.arange(len(group))
            for x, y in linked(col["fp"].view(np.uint64), col["more"].view(np.uint64), group, col["side"], within, wide):
                if "n" in col:
                    ok = LEAST[1] * np.minimum(col["n"][x], col["n"][y]) >= LEAST[0] * np.maximum(col["n"][x], col["n"][y])
                    x, y = x[ok], y[ok]
                if more is not None:
                    ok = (col["label"] if "label" in col else label)[x] != (col["label"] if "label" in col else label)[y]
                    x, y = x[ok], y[ok]
                    for at in range(0, len(x), CHUNK):
                        a, b = x[at : at + CHUNK], y[at : at + CHUNK]
                        ok = np.bitwise_count(more[a] ^ more[b]).sum(axis=1, dtype=np.int64) <= (SKETCH_BITS if "label" in col else NEAR_BITS)
                        a, b = a[ok], b[ok]
                        if "label" not in col:
                            a, b = joined(label, a, b)
                        if len(a):
                            a, b = col["rep"][a], col["rep"][b]
                            yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)}, schema=schema)
                elif len(x):
                    u.append(x)
                    v.append(y)
            if u:
                x, y = np.concatenate(u), np.concatenate(v)
                many = np.bincount(group[x])[group[x]] > FEW if "n" in col else np.ones(len(x), bool)
                u, v = col["rep"][x], col["rep"][y]
                if "n" in col:
                    own = np.unique(np.concatenate([u[many], v[many]]))
                    a, b = np.concatenate([np.maximum(u, v)[~many], own]), np.concatenate([np.minimum(u, v)[~many], own])
                else:
                    a, b = local_stars(u, v)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            # The last group may go on in the next batch: its rows wait.
            whole = pa.Table.from_batches(held)
            keys = [whole.column(c).to_numpy() for c in ("meet", "i", "j")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from found(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    met = short.unionByName(split).repartition(parts, "meet", "i", "j").sortWithinPartitions("meet", "i", "j")
    return met.mapInArrow(common.served(compared, "simhash"), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, within: int = 4) -> DataFrame:
    """Every row's fingerprint and the smallest doc_id that its links reach.

    Returns the columns of `docs` other than text, with fp and more (signed longs) and component_id.
    """
    common.prepare(docs.sparkSession)
    fps = common.written(fingerprints(docs, size), "fingerprints")
    nodes = common.written(fps.groupBy("fp", "more").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull()), "nodes")
    reached = components(links(nodes, within))
    known = common.written(nodes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "more", F.coalesce("component", "rep").alias("component_id")), "known")
    return fps.join(known, ["fp", "more"], "left")


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """row_key and doc_id with the size n and the digest of the set of distinct shingles, and the set's fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, bands = [], [np.zeros(0, np.uint64)]
            for t in batch.column("text"):
                x = shingle_set(t.as_py(), size)
                made.append((*np.array(majority(iter([x])), np.uint64).view(np.int64).tolist(), len(x), xxhash.xxh128_hexdigest(x.tobytes())))
                bands.append(band_keys(x))
            fp, more, n, digest = zip(*made, strict=True) if made else ([], [], [], [])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (fp, more, n)), pa.array(digest, pa.string()), keys], names=["row_key", "doc_id", "fp", "more", "n", "digest", "bands"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select("row_key", "doc_id", "text").mapInArrow(common.served(run, "simhash"), f"row_key {kinds['row_key']}, doc_id {kinds['doc_id']}, fp long, more long, n long, digest string, bands array<long>")


def similar(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of row_keys whose texts' shingle sets have a Jaccard similarity of LEAST or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "s"])

    out = pairs.where("a <> b")
    sets = common.among(rows, out.select(F.explode(F.array("a", "b")).alias("row_key"))).mapInArrow(common.served(run, "simhash"), "key long, s array<long>")
    for c in "ab":
        out = out.join(sets.select(F.col("key").alias(c), F.col("s").alias(f"s{c}")), c)
    # i / (na + nb - i) >= p / q without division.
    p, q = LEAST
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return out.where(both * (p + q) >= (F.size("sa") + F.size("sb")).cast("long") * p).select("a", "b")


def deduplicated(docs: DataFrame, size: int = 5, within: int = 24, wide: int = 38) -> DataFrame:
    """`docs` with one row of each component: of the smallest doc_id and, among its repeated rows, any one.

    Texts link if their sets of shingles have a Jaccard similarity of LEAST or more, counted exactly
    on the candidates. Sets meet in any of BANDS bands of least hashes, so that unlike texts don't meet
    however many there are; pivot tables and fingerprints of the sets then discard pairs. A similarity
    of 0.8 is a cosine of about 0.89, at which 19.4 of 128 bits differ on average with a deviation of
    4.1: `wide` is 4.5 deviations above it and `within`, for each word, 5.

    Sets of groups with many pairs get longer sketches. A forest of pairs with near sketches is checked
    first; then all pairs that these links have not joined and whose sketches aren't far, which lets
    little below a similarity of 0.74 through. So a large group of copies, near or not so near, doesn't
    cost the square of its rows where sets are joined. Rows without a
    doc_id are kept only where no row of their component has one. Columns of any name are carried.
    """
    common.prepare(docs.sparkSession)
    held = common.written(common.keyed(common.boxed(docs)), "rows")
    rows = held.select("row_key", "row.doc_id", "row.text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array([sketch(shingle_set(t.as_py(), size)) for t in batch.column("text")], pa.binary())], names=["rep", "sketch"])

    sets = common.written(shingled(rows, size), "shingled")
    known = common.written(sets.groupBy("digest").agg(F.min(F.struct("row_key", "fp", "more", "n")).alias("s"), F.min("bands").alias("bands")).select("digest", F.col("s.row_key").alias("rep"), "s.fp", "s.more", "s.n", "bands"), "known")
    nodes = known.drop("digest")
    texts = rows.select("row_key", "text")
    met = common.written(links(nodes, within, wide).distinct(), "met")
    links_ = common.written(similar(met, texts, size), "similar")
    crowded = met.where("a = b")
    if crowded.limit(1).count():
        near = common.among(texts, crowded.select(F.col("a").alias("row_key"))).mapInArrow(common.served(sketched, "simhash"), "rep long, sketch binary")
        left = common.written(nodes.join(near, "rep"), "left")
        forest = common.written(links(left, within, wide).distinct(), "forest")
        links_ = links_.unionByName(common.written(similar(forest, texts, size), "similar"))
        first = components(links_).withColumnRenamed("node", "rep").withColumnRenamed("component", "label")
        rest = common.written(links(left.join(first, "rep", "left").withColumn("label", F.coalesce("label", "rep")), within, wide).distinct(), "rest")
        links_ = links_.unionByName(common.written(similar(rest, texts, size), "similar"))
        common.dropped(left, forest, rest)
    reached = components(links_).withColumnRenamed("node", "rep").withColumnRenamed("component", "component_id")
    placed = known.join(reached, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("s")
    kept = common.written(sets.select("digest", "doc_id", "row_key").join(placed, "digest").groupBy("component_id").agg(least).select("s.row_key"), "first")
    common.dropped(sets, known, met)
    return common.among(held, kept).select("row.*")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of a number or two a row, broadcast only if it has few rows."""
    return F.broadcast(df) if rows <= common.MOST_BROADCAST else df
