"""The coins of ``coins.existing`` for many edges at once, in numpy within a task: each step of MD5 is taken for all messages of a batch."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Worlds in a mask.
CHUNK = 64
#: Bytes of a message that fits one block of MD5.
ONE_BLOCK = 55
#: Edges that are done are put aside once fewer than this share of a batch goes on.
KEPT = 0.75
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _first_word(words: np.ndarray) -> np.ndarray:
    """The first eight hex digits of the MD5 of each column of ``words`` (16, n), a padded message, as a number."""
    a, b, c, d = (np.full(words.shape[1], x, dtype=np.uint32) for x in START)
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += ADDED[i]
        mixed += words[at]
        turn = TURNS[i // 16][i % 4]
        turned = mixed << np.uint32(turn)
        turned |= mixed >> np.uint32(32 - turn)
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + np.uint32(START[0])).byteswap()


def _bytes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys' bytes, each followed by the byte 128 and zeros, and their lengths."""
    keys = keys.cast(pa.large_binary())
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(keys), 64), dtype=np.uint8)
    for i in range(min(64, int(sizes.max(initial=0)))):
        has = np.flatnonzero(sizes > i)
        out[has, i] = data[offsets[has] + i]
    ends = np.flatnonzero(sizes < 64)
    out[ends, sizes[ends]] = 128
    return out, sizes


def _padded(key_bytes: np.ndarray, sizes: np.ndarray, ahead: int) -> np.ndarray:
    """Words (16, n) of messages of ``ahead`` zeros and a key."""
    block = np.zeros((len(sizes), 64), dtype=np.uint8)
    block[:, ahead:] = key_bytes[:, : 64 - ahead]
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14], words[15] = (sizes + ahead) * 8, 0
    return words


def masks(keys: pa.Array, p: np.ndarray, worlds: int) -> np.ndarray:
    """(n, masks) of each edge's worlds, by the law of ``coins.existing``."""
    wide = (worlds - 1) // CHUNK + 1
    out = np.zeros((len(keys), wide), dtype=np.uint64)
    for i in range(wide):
        left = min(CHUNK, worlds - CHUNK * i)
        out[p >= 1, i] = np.uint64(2**left - 1)
    key_bytes, sizes = _bytes(keys)
    flat, rows = out.reshape(-1), np.flatnonzero((p > 0) & (p < 1))
    at, miss, ahead, words = np.full(len(rows), -1, dtype=np.int64), np.log1p(-p[rows]), 0, None
    for i in range(1, worlds + 2):
        begun = f"{i}:".encode()
        goes_on = at < worlds
        if len(begun) != ahead or goes_on.sum() < KEPT * len(rows):
            rows, at, miss, words = rows[goes_on], at[goes_on], miss[goes_on], words if words is None else words[:, goes_on]
            goes_on = goes_on[goes_on]
        if not len(rows):
            return out
        if len(begun) != ahead:
            ahead, words = len(begun), _padded(key_bytes[rows], sizes[rows], len(begun))
        put = np.frombuffer(begun.ljust(-(-ahead // 4) * 4, b"\0"), dtype="<u4")[:, None]
        bare = words[: len(put)].copy()
        words[: len(put)] |= put
        coin = _first_word(words).astype(np.float64)
        words[: len(put)] = bare
        for k in np.flatnonzero(sizes[rows] + ahead > ONE_BLOCK):
            coin[k] = int(hashlib.md5(begun + keys[int(rows[k])].as_py().encode()).hexdigest()[:8], 16)
        gap = np.minimum(np.floor(np.log((coin + 0.5) / 4294967296.0) / miss), worlds).astype(np.int64)
        at[goes_on] += gap[goes_on] + 1
        met = np.flatnonzero(goes_on & (at < worlds))
        flat[rows[met] * wide + at[met] // CHUNK] |= np.uint64(1) << (at[met] % CHUNK).astype(np.uint64)
    return out


def toss_batches(batches: Iterator[pa.RecordBatch], worlds: int) -> Iterator[pa.RecordBatch]:
    """Batches (src, dst, key, p) to (src, dst, m0, m1 and so on), without edges that exist in no world."""
    for batch in batches:
        p = np.nan_to_num(batch.column("p").to_numpy(zero_copy_only=False).astype(np.float64))
        found = masks(batch.column("key"), p, worlds)
        some = np.flatnonzero(found.any(axis=1))
        columns = [batch.column(c).take(pa.array(some)) for c in ("src", "dst")] + [pa.array(np.ascontiguousarray(found[some, i]).view(np.int64)) for i in range(found.shape[1])]
        yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", *(f"m{i}" for i in range(found.shape[1]))])
