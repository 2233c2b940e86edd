"""Media columns: payloads stored as lossless WebP pictures, and features of the decoded pixels."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm import webp
from fogline.llm.workers import tidy

#: Samples in a row; payloads are filled up to a positive multiple.
ROW = 576
#: Rows of one picture; the format ends at 16,384. A longer payload fills several pictures, one after the other.
MAX_ROWS = 16_383
FILL = b"\xff"


def store(payload: bytes) -> bytes:
    """The pictures of a payload, filled up with bytes 255."""
    filled = payload + FILL * (ROW if not payload else -len(payload) % ROW)
    samples = np.frombuffer(filled, np.uint8).reshape(-1, ROW)
    return b"".join(webp.encode_grey(samples[a : a + MAX_ROWS]) for a in range(0, len(samples), MAX_ROWS))


def pictures(media: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of the pictures in a media value."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield webp.decode(media[at : at + size])
        at += size


def feature(samples: np.ndarray) -> str:
    """Rows, sum, sum of squares and sums of steps along and across rows, of 8-bit samples; whole numbers, so the same anywhere."""
    x = samples.astype(np.int64)
    return f"rows={len(x)};sum={x.sum()};squares={(x * x).sum()};along={np.abs(np.diff(x, axis=1)).sum()};across={np.abs(np.diff(x, axis=0)).sum()}"


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each whole text as pictures.

    Null counts as empty, which is one row of bytes 255; repeated rows give repeated rows; a text of over MAX_ROWS * ROW bytes fills
    several pictures; an empty table stays empty; other columns, whatever their names, are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                raw = [x.as_buffer().to_pybytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(store, raw)), pa.binary())], ["doc_id", "n_bytes", "media"])

    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return body.mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """(doc_id, pixels): one row a picture, with its place in the value, its height and width, and its samples as RGBA bytes.

    A null or empty value has no pictures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                for k, pixels in enumerate(pictures(value.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([pixels.shape[0]], pa.int32()), pa.array([pixels.shape[1]], pa.int32()), pa.array([pixels.tobytes()], pa.binary())], ["doc_id", "picture", "height", "width", "pixels"])

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, picture int, height int, width int, pixels binary")


def digests(media: DataFrame) -> DataFrame:
    """Per media value, from its decoded pixels: payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes,
    media_sha256 and feature. Equal values give equal rows, repeated rows repeated ones; a value without pictures is an error."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for key, n, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    samples = np.concatenate([p[..., 1] for p in pictures(value)])
                    payload = samples.tobytes()
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(value), hashlib.sha256(value).hexdigest(), feature(samples)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that decoded values of few rows are held at once."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
