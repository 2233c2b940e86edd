"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Text is split into words by the tokenizer's pattern; a word's ids depend on its bytes alone. So each task gathers the
distinct words of its part of the corpus and replays the merges once over all of them: an inverted index leads from each
merge to the positions of its pair in any word, merges come off a heap in rank order, and only the two neighbours of a
merged pair get new index entries. Documents then look their words up. No word or text is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm.words import Lexicon, parts, pieces, require_pattern
from fogline.llm.workers import give_back, tidy

#: Characters of text whose new words are replayed together; bounds a task's memory.
BLOCK_CHARS = 3_000_000
#: Characters of text whose ids are handed on at once, and lists of ids decoded at once.
OUT_CHARS, DECODED = 500_000, 512
#: Words that a task remembers; when there are more it starts anew. Results don't depend on it.
KEPT_WORDS = 400_000
SHIFT = 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Replays the merges of a rank table over many words at once.

    As tokenizers do, a word that is a token itself gets its id at once; else, again and again, the adjacent pair whose
    joined bytes have the lowest rank merges, the leftmost first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    merges[left << SHIFT | right] = rank
        self.keys = np.array(sorted(merges), np.int64)
        self.results = np.array([merges[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, -1 where there is none or ``right`` is below 0."""
        pair = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((right >= 0) & (left >= 0) & (self.keys[at] == pair), self.results[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has."""
        raw_words = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array([self.ranks.get(w, -1) for w in raw_words], np.int64)
        rest = np.flatnonzero(whole < 0)
        rest_words = [raw_words[k] for k in rest.tolist()]
        sizes = np.array([len(w) for w in rest_words], np.int64)
        ends = np.cumsum(sizes)
        token = self._replay(self.single[np.frombuffer(b"".join(rest_words), np.uint8)], ends)
        kept = token >= 0
        count = np.ones(len(words), np.int64)
        if len(rest):
            count[rest] = np.add.reduceat(kept, ends - sizes)
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        flat[start[whole >= 0]] = whole[whole >= 0]
        flat[np.repeat(start[rest] - np.cumsum(count[rest]) + count[rest], count[rest]) + np.arange(int(count[rest].sum()))] = token[kept]
        return flat, count

    def _replay(self, token: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merge in place: token ids by position, -1 where a token was merged into the one before it. Words end at ``ends``."""
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            """Enter the positions of pairs under the rank of their merge."""
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        if n:
            first = np.flatnonzero(after >= 0)
            ranks = self.rank(token[first], token[after[first]])
            if (found := ranks >= 0).any():
                add(first[found], ranks[found])
        while heap:
            now = heapq.heappop(heap)
            parts = index.pop(now)
            at = np.unique(np.concatenate(parts) if len(parts) > 1 else parts[0])
            at = at[(token[at] >= 0) & (after[at] >= 0)]
            at = at[self.rank(token[at], token[after[at]]) == now]
            if not len(at):
                continue
            # of pairs that overlap, the first, third, ... of each chain merge
            chained = np.append(False, after[at[:-1]] == at[1:])
            begin = np.flatnonzero(~chained)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            # the pairs that a merge makes, as they are when those to its left have merged and those to its right haven't
            right = after[after[at]]
            left = before[at]
            new_left = np.where(np.append(False, after[after[at[:-1]]] == at[1:]), now, np.where(left >= 0, token[left], -1))
            here = np.full(len(at), now)
            rank_right = self.rank(here, np.where(right >= 0, token[right], -1))
            rank_left = np.where(left >= 0, self.rank(new_left, here), -1)
            low = ((rank_right >= 0) & (rank_right < now)) | ((rank_left >= 0) & (rank_left < now))
            if low.any():
                # a pair of lower rank goes first in its word: what lies to the right in that word waits in the index
                word = np.searchsorted(ends, at, side="right")
                order = np.arange(len(at))
                until = np.full(len(ends), len(at))
                np.minimum.at(until, word[low], order[low])
                go = order <= until[word]
                index[now] = [at[~go]]
                heapq.heappush(heap, now)
                at = at[go]
            gone = after[at]
            right = after[gone]
            token[at], token[gone], after[at] = now, -1, right
            inner = right >= 0
            before[right[inner]] = at[inner]
            left = before[at]
            starts = np.concatenate([at[inner], left[left >= 0]])
            if len(starts):
                ranks = self.rank(token[starts], token[after[starts]])
                if (found := ranks >= 0).any():
                    add(starts[found], ranks[found])
        return token


class Encoder:
    """A rank table with the words that a task has met."""

    def __init__(self, path: str):
        require_pattern()
        self.replay = MergeReplay(load_ranks(path))
        self.lexicon = Lexicon(KEPT_WORDS)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        self.lexicon.trim()
        rows, counts = self.lexicon.rows(texts)
        self.lexicon.learn(self.replay.encode)
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            yield self.lexicon.ids(rows[a:b])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.bytes_of.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder for a rank file; a worker runs many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]), pa.int32()))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _each_part(docs: DataFrame, ranks_path: str, doc_id: str, text: str, told: Callable[[Encoder, list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and what ``told`` makes of an encoder and the ids of some texts. A block's new words are replayed together; ids are
    handed on for OUT_CHARS of text at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks_path)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at, texts in parts(batch.column(1), BLOCK_CHARS):
                found = encoder.encode(texts)
                for a, b in pieces(texts, OUT_CHARS):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at + a, b - a), *told(encoder, [next(found) for _ in range(a, b)])], names)
            give_back()
        encoder.lexicon.clear()

    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return body.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without special tokens.

    A null text counts as empty and gets an empty list; repeated rows give repeated rows; other columns, whatever their names, are
    not read. A very long text is a block of its own; its words are told apart before they are replayed. An empty table stays empty.
    ``ranks_path`` must be readable on every executor.
    """
    return _each_part(docs, ranks_path, doc_id, text, lambda _, found: [_lists(found)], "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for. A null list counts as empty; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks_path)
        for batch in batches:
            for a in range(0, batch.num_rows, DECODED):
                some = batch.slice(a, DECODED)
                decoded = [encoder.decode(ids.as_py() or []) for ids in some.column(1)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary")


def tokens(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids and the SHA-256 of the bytes that the ids decode to, in one pass over the texts.

    Nulls, long texts, repeated rows and further columns count as in ``encode``.
    """

    def told(encoder: Encoder, found: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(list(map(len, found)), pa.int64()), _lists(found), pa.array([_sha(encoder.decode(x.tolist())) for x in found], pa.string())]

    return _each_part(docs, ranks_path, doc_id, text, told, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids as decimal text and of the decoded bytes.

    Encodes and decodes as ``encode`` and ``decode`` do, within one pass over the texts, so that ids don't leave the task. Nulls,
    long texts, repeated rows and further columns count as in ``encode``.
    """

    def told(encoder: Encoder, found: list[np.ndarray]) -> list[pa.Array]:
        ids = [x.tolist() for x in found]
        said = [_sha(",".join(map(str, x)).encode()) for x in ids]
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array(said, pa.string()), pa.array([_sha(encoder.decode(x)) for x in ids], pa.string())]

    return _each_part(docs, ranks_path, doc_id, text, told, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
