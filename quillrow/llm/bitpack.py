"""Token ids in fixed-width bit packing, as binary files with random access.

An id takes the least number of bits that the vocabulary needs. Ids are packed in blocks of
`BLOCK_IDS`; within a block, 64 ids fill as many 64-bit words as an id has bits, so that packing and
unpacking are a few dozen vector operations whatever the width.

File layout, all numbers little-endian:

    8 bytes   magic `QRBITS01`
    u32       bits of an id
    u32       ids of a block
    u64       ids of the file
    u64       documents of the file
    u64 * (blocks + 1)      offset of each block from the start of the data, and the end
    i64 * documents         doc_id (the least long for null)
    u64 * (documents + 1)   place of each document's first id, and the end
    data                    packed blocks

Files lie in the folder `<path>`, named `<partition>-<file>.bits`; names sort in document order. They
are written under a temporary name and renamed, so that a task that is run again leaves one file.

Shapes of input with a defined result: a null text is an empty one; a document without ids keeps its
end id; documents of one doc_id are ordered by their text; null doc_ids come first; an empty table
gives no file and an empty result; texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.llm import common

MAGIC = b"QRBITS01"
HEAD = struct.Struct("<8sIIQQ")
#: Ids of a block and about as many ids of a file; a document is never cut.
BLOCK_IDS, FILE_IDS = 1 << 14, 1 << 22
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Packed words of some ids; the last 64 are padded with zeros."""
    n = -(-len(ids) // 64)
    lanes = np.zeros(n * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(n, 64)
    out = np.zeros((n, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    """The first `count` ids of packed words."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & mask
    return out.reshape(-1)[:count].astype(np.uint32)


def build(doc_ids: list[int | None], docs: list[np.ndarray], bits: int) -> bytes:
    """A file of some documents' ids."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[at : at + BLOCK_IDS], bits) for at in range(0, len(ids), BLOCK_IDS)]
    parts = [HEAD.pack(MAGIC, bits, BLOCK_IDS, len(ids), len(docs))]
    parts.append(np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes())
    parts.append(np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes())
    parts.append(np.cumsum([0, *map(len, docs)]).astype("<u8").tobytes())
    return b"".join(parts + blocks)


@dataclass
class Reader:
    """Random access to the bytes of a file: documents, or any range of ids."""

    data: memoryview

    def __post_init__(self) -> None:
        magic, self.bits, self.block, self.n_ids, self.n_docs = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at, n = HEAD.size, -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at)
        self.base = at + 8 * (self.n_docs + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of places [start, end), unpacking only the blocks that hold them."""
        start, end = max(0, start), min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.data[self.base + int(self.offsets[b]) : self.base + int(self.offsets[b + 1])], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: The split that a tokenizer has to name for its words to be encoded on their own, and the same for Latin-1 in lower case.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LATIN = "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
END = "</w>"
#: The sorts of Latin-1 characters in lower case: white space, letters, digits (each a word of its own) and others.
_SORT = np.full(256, 3, np.uint8)
_SORT[[b for b in range(256) if re.match(r"\s", chr(b))]] = 0
_SORT[[b for b in range(256) if re.match("[a-zªµºß-öø-ÿ]", chr(b))]] = 1
_SORT[[b for b in range(256) if re.match("[0-9²³¹¼½¾]", chr(b))]] = 2
#: Characters of a chunk of whole texts whose words are told at once.
CHARS_AT_ONCE = 1 << 20


class Encoder:
    """Encodes texts with a tokenizers file, keeping the ids of words seen before.

    A tokenizer that lower-cases, drops white space and splits by SPLIT encodes each word on its own,
    the last id of each being one of a word's end. In a text of Latin-1 characters without special
    tokens or odd white space the words are told here, and new ones are encoded many at a time, one a
    line. Any other text, and any other tokenizer, is encoded as a whole.
    """

    def __init__(self, path: str, most_words: int = 400_000) -> None:
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        norm = {x["type"] for x in (made.get("normalizer") or {}).get("normalizers") or []}
        self.by_word = norm == {"NFC", "Lowercase", "Replace"} and split.get("behavior") == "Removed" and split.get("invert") is True and split.get("pattern") == {"Regex": SPLIT} and made["model"].get("end_of_word_suffix") == END
        self.marks = [x["content"] for x in made.get("added_tokens", [])]
        self.odd = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
        self.words_of = re.compile(LATIN).findall
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(END)]] = True
        # Two generations of words: what is asked for moves to the newer, the older is dropped when that is full.
        self.most, self.new, self.old = most_words, {}, {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def learn(self, words: list[bytes]) -> None:
        """Ids of words, as bytes."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            lines = b"\n".join(some).decode("latin-1")
            ids = np.array(self.tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                data, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.new.update(zip(some, [data[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], strict=True))
            else:
                for w, e in zip(some, self.tokenizer.encode_batch_fast(lines.split("\n"), add_special_tokens=False), strict=True):
                    self.new[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if not self.by_word or self.odd.search(t) or any(m in t for m in self.marks):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            low = t.lower()
            if "'" in low:
                # An apostrophe may begin a word with the letters behind it: the expression tells, and others get white space between.
                low = " ".join(self.words_of(low))
            held.append((i, low))
            size += len(low)
            if size >= CHARS_AT_ONCE:
                self._encode_words(held, out)
                held, size = [], 0
        if held:
            self._encode_words(held, out)
        return out

    def _encode_words(self, held: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        """Puts the ids of some texts of Latin-1 characters at their places."""
        each = [low.encode("latin-1") for _, low in held]
        data = b" ".join(each)
        x = np.frombuffer(data, np.uint8)
        sort = _SORT[x]
        new = np.ones(len(x), bool)
        new[1:] = ((sort[1:] != sort[:-1]) & ((x[:-1] != 39) | (sort[1:] != 1))) | (sort[1:] == 2)
        solid = sort != 0
        new &= solid
        at = np.append(np.flatnonzero(new[solid]), np.count_nonzero(solid)).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(x[solid])]).dictionary_encode()
        ids = self.ids_of(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = found.indices.to_numpy()
        flat, n = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        off, count = np.cumsum(n, dtype=np.int32) - n, n[which]
        end = np.cumsum(count, dtype=np.int64)
        place = np.arange(int(end[-1]) if len(end) else 0)
        place += np.repeat(off[which] - (end - count), count)
        flat = flat[place]
        # Words that start before the end of each text, and their ids.
        words = np.searchsorted(np.flatnonzero(new), np.cumsum([len(b) + 1 for b in each]))
        ends = np.append(0, end)[words].tolist()
        for (i, _), a, b in zip(held, [0, *ends[:-1]], ends, strict=True):
            out[i] = flat[a:b]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words in Latin-1, as bytes; new ones are learned."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        got = list(map(self.new.get, words))
        if None in got:
            missing = [w for w, g in zip(words, got, strict=True) if g is None]
            known = {w: self.old[w] for w in missing if w in self.old}
            self.new.update(known)
            self.learn([w for w in missing if w not in known])
            got = list(map(self.new.__getitem__, words))
        return got


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process: tasks that follow each other share its words."""
    return Encoder(path)


def _store(path: str):  # noqa: ANN202
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def write_files(docs: DataFrame, tokenizer: str, path: str, bits: int, end_id: int = 2) -> DataFrame:
    """Encodes the texts and writes their ids in order of doc_id; returns one row per file.

    Columns: name, partition, file, n_ids, n_docs. The folder has to be one that all executors share.
    Texts are dealt by ranges of doc_id before they are encoded, so nothing but them is shuffled.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = encoder(tokenizer)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = _store(path)
        doc_ids, docs, n, made = [], [], 0, 0
        schema = pa.schema([("name", pa.string()), ("partition", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{made:06d}.bits"
            with store.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(build(doc_ids, docs, bits))
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"name": name, "partition": part, "file": made, "n_ids": n, "n_docs": len(docs)}], schema=schema)

        for batch in batches:
            texts = known.encode([t or "" for t in batch.column("text").to_pylist()])
            for d, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                doc_ids.append(d)
                docs.append(np.append(ids, np.uint32(end_id)))
                n += len(docs[-1])
                if n >= FILE_IDS:
                    yield close()
                    doc_ids, docs, n, made = [], [], 0, made + 1
        if docs:
            yield close()

    store, root = _store(path)
    store.create_dir(root, recursive=True)
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(ranged.mapInArrow(run, "name string, partition int, file int, n_ids long, n_docs long"), "files")


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    start counts the ids of all documents before it, over all files in order; `files` has the sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                r = Reader(memoryview(content.as_buffer()))
                ids = r.ids(0, r.n_ids).astype("<u4")
                starts = r.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                doc_ids = pa.array(r.doc_ids, pa.int64(), mask=r.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], schema=schema)

    # Ids before each partition: one row a partition, so this window is short; then files within it.
    sums = files.groupBy("partition").agg(F.sum("n_ids").alias("n")).selectExpr("partition", "coalesce(sum(n) over (order by partition rows between unbounded preceding and 1 preceding), 0) as before")
    based = files.join(F.broadcast(sums), "partition").selectExpr("name", "before + coalesce(sum(n_ids) over (partition by partition order by file rows between unbounded preceding and 1 preceding), 0) as base")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.bits").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return content.join(F.broadcast(based), "name").select("base", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes, packs and writes every text, and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    common.prepare(spark)
    path = path or common.scratch_path(spark, "bits")
    bits = bits_for(max(encoder(tokenizer).vocabulary, end_id + 1))
    return read_files(spark, path, write_files(docs, tokenizer, path, bits, end_id))
