"""Token ids in binary chunks: bit-plane shuffling, zstandard for each plane, and a chunk index.

A chunk holds the ids of some whole documents. Its ids are cut into blocks of BLOCK_IDS (the last may be shorter); of a
block, bit k of all ids makes plane k, eight ids a byte, and each plane up to the highest bit in use is compressed by
itself. Low planes are nearly random, high ones nearly constant, and an id that few documents use costs little.

A chunk is one row of a Parquet data set, so Spark's committers make the files whole on any store and after any lost
executor. Its other columns are the chunk index (part, chunk, first, n_ids, doc_ids, doc_ids' counts, sizes of planes),
which can be read without the payload.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import small
from fogline.llm.words import Lexicon, require_pattern
from fogline.llm.words import parts as text_parts
from fogline.llm.workers import give_back, tidy

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19
LEVEL = 3
#: Words that a task remembers; when there are more it starts anew. Results don't depend on it.
KEPT_WORDS = 1_000_000
CHUNKS = "part int, chunk int, first long, n_ids long, doc_ids array<long>, counts array<long>, planes array<int>, sizes array<int>, payload binary"


def to_planes(ids: np.ndarray) -> tuple[int, list[bytes]]:
    """The number of planes of a block and the planes, lowest bit first."""
    n_planes = int(ids.max()).bit_length() if len(ids) else 0
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)[:, : (n_planes + 7) // 8], axis=1, bitorder="little")
    return n_planes, [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits[:, :n_planes].T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of ``n`` ids."""
    if not planes:
        return np.zeros(n, np.uint32)
    packed = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    bits = np.unpackbits(packed, axis=1, bitorder="little", count=n)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, : len(planes)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def pack(ids: np.ndarray, level: int = LEVEL) -> tuple[list[int], list[int], bytes]:
    """Of the ids of a chunk: planes of each block, bytes of each plane, and all compressed planes."""
    squeeze, planes, parts = zstandard.ZstdCompressor(level=level), [], []
    for a in range(0, len(ids), BLOCK_IDS):
        n, block = to_planes(ids[a : a + BLOCK_IDS])
        planes.append(n)
        parts += map(squeeze.compress, block)
    return planes, list(map(len, parts)), b"".join(parts)


def unpack(n_ids: int, planes: list[int], sizes: list[int], payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    expand, out, at, k = zstandard.ZstdDecompressor(), [], 0, 0
    for block, n in enumerate(planes):
        parts = []
        for size in sizes[k : k + n]:
            parts.append(expand.decompress(payload[at : at + size]))
            at += size
        k += n
        out.append(from_planes(parts, min(BLOCK_IDS, n_ids - block * BLOCK_IDS)))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class WordEncoder:
    """A tokenizer with the words that a task has met.

    The tokenizer splits text by the pattern of ``words`` and encodes each word by itself, so ids of distinct words make up the ids
    of a text. Texts with a string of an added token go through the tokenizer whole.
    """

    def __init__(self, path: str):
        require_pattern()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lexicon = Lexicon(KEPT_WORDS)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for a in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[a : a + 4096], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int32), np.array(list(map(len, found)), np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        whole = [any(t in text for t in self.added) for text in texts]
        self.lexicon.trim()
        rows, counts = self.lexicon.rows(["" if w else t for t, w in zip(texts, whole, strict=True)])
        self.lexicon.learn(self._words)
        at = 0
        for text, w, n in zip(texts, whole, counts.tolist(), strict=True):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32) if w else self.lexicon.ids(rows[at : at + n])
            at += n


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; a worker runs many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_chunks(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of the ids of all documents, each with ``end_id`` appended, in ascending doc_id order over the parts.

    One shuffle ranges the documents by id; a part is a range. A null text counts as empty and gets the end id alone; a
    null doc_id comes first; rows with equal ids are ordered by their text; other columns, whatever their names, are not read. A very
    long text makes a chunk of its own. An empty table makes no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        names, parts, total = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, first, names, parts, total
            ids = np.concatenate(parts)
            planes, sizes, payload = pack(ids)
            row = {"part": part, "chunk": chunk, "first": first, "n_ids": len(ids), "doc_ids": names, "counts": list(map(len, parts)), "planes": planes, "sizes": sizes, "payload": payload}
            chunk, first, names, parts, total = chunk + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("planes", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary())])
        end = np.array([end_id], np.int32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, texts in text_parts(batch.column(1)):
                for k, found in enumerate(encoder.encode(texts), a):
                    ids = np.append(found, end)
                    if total and total + len(ids) > CHUNK_IDS:
                        yield flush()
                    names.append(keys[k])
                    parts.append(ids)
                    total += len(ids)
            give_back()
        if parts:
            yield flush()
        encoder.lexicon.clear()

    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return body.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(run), CHUNKS)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode ``docs`` and write the chunks below ``path``."""
    encode_chunks(docs, tokenizer_path, end_id).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. Where each part begins comes from the chunk index alone, with a
    row for each part, which chunks are sent instead of being shuffled. The checksum is of the ids as little-endian unsigned 32-bit integers.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    starts = parts.select("part", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(unpack(row["n_ids"], row["planes"], row["sizes"], row["payload"]).astype("<u4").tobytes())
                ends = np.cumsum(row["counts"])
                begins = ends - row["counts"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["begin"] + row["first"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each part, that is, for each task of the write
    rows = chunks.join(small(starts), "part").select("begin", "first", "n_ids", "doc_ids", "counts", "planes", "sizes", "payload")
    return rows.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of all documents, end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["n_ids"], row["planes"], row["sizes"], row["payload"]).astype(np.int32)
                ends = np.append(0, np.cumsum(row["counts"])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return spark.read.schema(CHUNKS).parquet(path).select("n_ids", "doc_ids", "counts", "planes", "sizes", "payload").mapInArrow(tidy(run), "doc_id long, ids array<int>")
