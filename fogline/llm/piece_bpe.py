"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

Merging the best pair again and again gives the one sequence of pieces in which every piece is what its own characters merge to and
every two adjacent pieces stay apart when their characters are merged again: a merge over a boundary would come at the same place in
the merging of those two alone. So nothing is merged at run time. Aho-Corasick finds the longest piece from each character; the search
takes it, or the next shorter piece that is a prefix of it, as long as it fits the piece before, and goes back where none does. A
bitfield keeps the positions from which no piece led on, so that each is left for good once.

White space never follows another character within a piece (checked when a model is read), so words with the white space before them
are encoded by themselves, and a task remembers them.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm.words import parts
from fogline.llm.workers import give_back, tidy

#: The character that stands for a blank, and the types of pieces in a model file.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of text that are handed on at once.
OUT_CHARS = 2_000_000
#: Words, their characters and pairs of pieces that a task remembers; when there are more it starts anew. Results don't depend on it.
KEPT_WORDS, KEPT_CHARS, KEPT_PAIRS = 500_000, 64, 2_000_000


def _messages(data: bytes) -> Iterator[tuple[int, object]]:
    """The (field, value) pairs of a protocol-buffer message: varints as int, 32 and 64 bits and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """The pieces of a model file: ``pieces`` by id, ``kind`` by id, ``score`` of each normal piece by text, ``ids`` by text."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_messages(file.read()))
        self.pieces, self.kind, self.score, self.ids = [], [], {}, {}
        for piece in (dict(_messages(v)) for k, v in fields if k == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind == NORMAL:
                self.score[text], self.ids[text] = struct.unpack("<f", piece.get(2, bytes(4)))[0], len(self.pieces)
            self.pieces.append(text)
            self.kind.append(kind)
        trained = dict(_messages(b"".join(v for k, v in fields if k == 2)))
        cleaned = dict(_messages(b"".join(v for k, v in fields if k == 3)))
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kind, strict=True)) if k == BYTE}
        self.end, self.unknown = self.pieces.index("</s>"), self.kind.index(UNKNOWN)
        known = trained.get(3) == 2 and len(self.byte_ids) == 256 and not set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}
        plain = not cleaned.get(2) and cleaned.get(3, 1) and not cleaned.get(4, 1) and cleaned.get(5, 1) and not trained.get(24, 0)
        if not known or not plain:
            raise ValueError("only merge-type models with byte pieces, no normalisation and a blank put before the text are read")
        if any(a != BLANK and b == BLANK for text in self.ids for a, b in zip(text, text[1:], strict=False)):
            raise ValueError("a piece goes on over white space")


class Backtracker:
    """Encodes strings of a model's characters by backtracking."""

    def __init__(self, model: Model):
        self.model = model
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        own = [text for text in model.ids if self.merged(text) == [text]]
        reached = set(own)
        self.shorter = {text: next((text[:k] for k in range(len(text) - 1, 0, -1) if text[:k] in reached), None) for text in own}
        self.automaton = ahocorasick.Automaton()
        for text in own:
            self.automaton.add_word(text, (text, len(text) - 1))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """What the characters of a short text merge to: the pair of the best score first, the leftmost of those."""
        symbols, score = list(text), self.model.score
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                found = score.get(symbols[k] + symbols[k + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the pieces stay as they are when their characters are merged again."""
        found = self.merged(left + right) == [left, right]
        if self.n_fits >= KEPT_PAIRS:
            self.fits.clear()
            self.n_fits = 0
        self.fits.setdefault(left, {})[right] = found
        self.n_fits += 1
        return found

    def encode(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        n, shorter, none = len(text), self.shorter, {}
        longest: list[str] = [""] * n
        for last, (piece, more) in self.automaton.iter(text):
            longest[last - more] = piece  # of pieces from one character, the longest ends last
        failed, any_failed, out, at = bytearray(n // 8 + 1), False, [], 0
        before, piece = None, longest[0] if n else None
        while at < n:
            known = self.fits.get(before, none)
            while piece is not None:
                end = at + len(piece)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if before is None:
                        break
                    fits = known.get(piece)
                    if self.compatible(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                before, at = piece, at + len(piece)
                piece = longest[at] if at < n else None
            else:  # nothing leads on from here: take back the piece before, and try the next shorter one in its place
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                last = out.pop()
                at -= len(last)
                before, piece = out[-1] if out else None, shorter[last]
        return out


class Encoder(dict):
    """Words to (ids as text, number of ids, decoded text), as a task meets them; and whole texts."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.search = Backtracker(self.model)
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.strange = re.compile("([^" + re.escape("".join(c for c in self.model.ids if len(c) == 1)) + "])")
        kinds = {CONTROL: "", UNKNOWN: " ⁇ ", BYTE: None}
        self.told = [kinds[k] if k in kinds else p.replace(BLANK, " ") for p, k in zip(self.model.pieces, self.model.kind, strict=True)]

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word with the blanks before it. Characters that are no pieces never merge, and give the ids of their bytes."""
        out, model = [], self.model
        for k, part in enumerate(self.strange.split(word)):
            if k % 2:
                out += [model.byte_ids[b] for b in part.encode()]
            else:
                out += [model.ids[p] for p in self.search.encode(part)]
        return out

    def __missing__(self, word: str) -> tuple[str, int, str]:
        ids = self.word_ids(word)
        told = " ".join(map(str, ids)), len(ids), self.text_of(ids)
        if len(word) <= KEPT_CHARS:
            self[word] = told
        return told

    def words(self, text: str) -> list[str]:
        return self.word.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def trim(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()

    def ids(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        return [int(x) for w in self.words(text) for x in self[w][0].split(" ")]

    def text_of(self, ids: list[int]) -> str:
        """What ids stand for, the blank before the text included. Bytes that are no UTF-8 give replacement characters."""
        told = [self.told[i] for i in ids]
        if None not in told:
            return "".join(told)
        out, raw = [], bytearray()
        for i, text in zip(ids, told, strict=True):
            if text is None:
                raw.append(int(self.model.pieces[i][3:5], 16))
            else:
                out += [_utf8(raw), text]
                raw = bytearray()
        return "".join([*out, _utf8(raw)])

    def decode(self, ids: list[int]) -> str:
        return self.text_of(ids).removeprefix(" ")


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that belongs to no character gives a replacement character of its own."""
    try:
        return raw.decode()
    except UnicodeDecodeError as wrong:
        return raw[: wrong.start].decode() + "�" + _utf8(raw[wrong.start + 1 :])


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder for a model file; a worker runs many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _each_part(docs: DataFrame, model_path: str, doc_id: str, text: str, told: Callable[[Encoder, list[str]], list[pa.Array]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at, texts in parts(batch.column(1), OUT_CHARS):
                encoder.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *told(encoder, texts)], names)
            give_back()

    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return body.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id.

    A null text counts as empty and gets the end id alone; repeated rows give repeated rows; other columns, whatever their names, are
    not read. A very long text is a part of its own, and a very long word costs time in proportion to its length. An empty table stays
    empty. ``model_path`` must be readable on every executor.
    """

    def told(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        return [pa.array([[*encoder.ids(t), encoder.model.end] for t in texts], pa.list_(pa.int32()))]

    return _each_part(docs, model_path, doc_id, text, told, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text that ids stand for, without the blank that encoding put before it. Control ids stand for
    nothing; a null list counts as empty; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        for batch in batches:
            texts = [encoder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids as decimal text and of the decoded text.

    Words are encoded and their ids decoded as ``encode`` and ``decode`` do, once for each word that a task meets; a character's bytes
    never lie in two words. Nulls, long texts, repeated rows and further columns count as in ``encode``.
    """

    def told(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        counts, said, decoded = [], [], []
        for text in texts:
            found = list(map(encoder.__getitem__, encoder.words(text)))
            counts.append(sum(x[1] for x in found) + 1)
            said.append(_sha(" ".join([*[x[0] for x in found], str(encoder.model.end)])))
            decoded.append(_sha("".join([x[2] for x in found]).removeprefix(" ")))
        return [pa.array(counts, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]

    return _each_part(docs, model_path, doc_id, text, told, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
