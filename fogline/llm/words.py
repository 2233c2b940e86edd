"""Splitting text into the words of byte-level BPE tokenizers, for many texts at once.

The words are the matches of the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Characters fall into four classes, and words begin where the class changes, with rules for the last white space before
other characters and for contractions. That makes a few array operations a block in place of a match a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern that ``spans`` splits by. Another one of the tokenizers' package is an error, not other words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters of text that are split together; bounds the arrays in memory.
BLOCK_CHARS = 500_000
#: Characters of new words that are encoded together.
LEARNT_CHARS = 1_000_000
#: The base of the words' 64-bit hashes.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_tables: dict[str, np.ndarray] = {}


def require_pattern() -> None:
    """Raise unless the tokenizers' package splits by PATTERN."""
    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizers split by another pattern")


def _classes() -> np.ndarray:
    if "class" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE] = SPACE
        _tables["class"] = table
    return _tables["class"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0 to n."""
    if len(_tables.get("power", ())) <= n:
        size = max(n + 1, 1 << 19)
        for name, x in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["power"], _tables["inverse"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of ``x`` changes about half of the bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where words begin in ``points``, the code points of texts one after the other; ``firsts`` is where texts begin."""
    n = len(points)
    kind = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    text_start = np.zeros(n + 1, bool)
    text_start[firsts] = True
    begins |= text_start
    # the last white space before another class: a word of its own, or, if it is a blank, the start of the next word
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n]) if n else np.zeros(0, int)
    begins[last] = True
    blank = last[points[last] == 0x20]
    begins[blank + 1] = False
    # contractions: a lone apostrophe that begins a word, and the letters after it
    quote = np.flatnonzero(points == 0x27)
    quote = quote[begins[quote] & (quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~text_start[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((quote[short], 1), (quote[long & ~short], 2)):
            begins[found + 1] = False
            end = found + 1 + size
            end = end[end < n]
            end = end[(kind[end] == LETTER) & ~text_start[end]]
            begins[end] = True
    return np.flatnonzero(begins[:n])


def hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words run from one start to the next."""
    n = len(points)
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    ends = np.append(starts[1:], n)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to ``most`` characters, of one text at least."""
    return ranges(list(map(len, texts)), most)


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to ``most`` at most, of one item at least."""
    start = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def parts(texts: pa.Array, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """A column of texts by and by, with up to ``most`` characters at once: where each part begins, and its texts."""
    for a, b in ranges(pc.utf8_length(texts).to_pylist(), most):
        yield a, texts.slice(a, b - a).to_pylist()


class Lexicon:
    """Distinct words with a row each, and texts as rows of words. ``encode`` gives the ids of new words.

    Words are found by their hashes in sorted arrays, and every word of a text is compared with the word that was found,
    code point by code point; words that only share a hash with another one have rows of their own in ``others``.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.points, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.others: dict[str, int] = {}
        self.new: list[str] = []
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word rows of all texts in one array, and how many words each text has."""
        out, counts = [], []
        for a, b in pieces(texts):
            part = texts[a:b]
            joined = "".join(part)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(sizes)
            starts = spans(points, (ends - sizes)[sizes > 0])
            counts.append(np.diff(np.searchsorted(starts, np.append(0, ends))))
            if len(starts):
                out.append(self._rows(joined, points, starts))
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _rows(self, joined: str, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        size = np.diff(np.append(starts, len(points)))
        distinct, first, which = np.unique(hashes(points, starts), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        found = np.append(self.known, np.uint64(0))[at] == distinct
        found &= at < len(self.known)
        row = np.empty(len(distinct), np.int32)
        row[found] = self.row[at[found]]
        fresh = np.flatnonzero(~found)
        row[fresh] = self._add(joined, points, starts[first[fresh]], size[first[fresh]])
        self.known, self.row = np.insert(self.known, at[fresh], distinct[fresh]), np.insert(self.row, at[fresh], row[fresh])
        rows = row[which]
        # words stand one after the other, so a word's place in the lexicon less its place here holds for all its characters
        wrong = self.size[rows] != size
        own = np.minimum(np.repeat(self.first[rows] - starts, size) + np.arange(len(points)), len(self.points) - 1)
        same = self.points[own] == points
        if not same.all():
            wrong |= np.add.reduceat(~same, starts) > 0
        for k in np.flatnonzero(wrong).tolist():
            word = joined[starts[k] : starts[k] + size[k]]
            if word not in self.others:
                self.others[word] = int(self._add(joined, points, starts[k : k + 1], size[k : k + 1])[0])
            rows[k] = self.others[word]
        return rows

    def _add(self, joined: str, points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New rows for words of ``points``."""
        rows = len(self.size) + np.arange(len(starts))
        ends = np.cumsum(size)
        self.first = np.append(self.first, len(self.points) + ends - size)
        self.size = np.append(self.size, size)
        self.points = np.append(self.points, points[np.repeat(starts - (ends - size), size) + np.arange(size.sum())])
        self.new += [joined[a:b] for a, b in zip(starts.tolist(), (starts + size).tolist(), strict=True)]
        return rows

    def learn(self, encode) -> None:
        """Encode the words that are new; ``encode`` takes some and returns their ids in one array and their counts."""
        for a, b in pieces(self.new, LEARNT_CHARS):
            flat, count = encode(self.new[a:b])
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(count) - count)
            self.flat, self.count = np.append(self.flat, flat.astype(np.int32)), np.append(self.count, count)
        self.new = []

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of words, one word after the other."""
        count = self.count[rows]
        ends = np.cumsum(count)
        if not len(ends):
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.begin[rows] - (ends - count), count) + np.arange(ends[-1])]

    def trim(self) -> None:
        """Start anew if there are too many words; results don't depend on it."""
        if len(self.size) > self.most:
            self.clear()
