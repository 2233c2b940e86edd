"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

The lexicon's entries and weights come from labelled documents: whole words and word beginnings that occur far more
often in toxic than in other documents. Folding maps homoglyphs, accents and digit or sign substitutions to one letter,
in the lexicon and in every text alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize
from fogline.llm.words import parts, pieces
from fogline.llm.workers import tidy

#: Labelled rows that the model is fitted on at most, taken in the order of a hash of doc_id. This bounds what is
#: broadcast and what reaches the driver; all else covers every document.
MAX_LABELLED = 20_000
#: Lexicon entries at most, those of the largest weights.
MAX_ENTRIES = 4_000
#: Lengths of word beginnings that can be entries, besides whole words.
STEMS = (4, 5, 6)
#: A weight is the log odds of the lower bound of an entry's toxic rate, at so many standard errors, above the base rate.
Z, LEAST_WEIGHT, LEAST_DOCS = 2.0, 1.5, 3
#: Without labels of both kinds these words are the lexicon, with this weight and model.
DEFAULT_WORDS, DEFAULT_WEIGHT, DEFAULT_MODEL = ("idiot", "moron", "scum", "stupid", "worthless", "loser"), 4.0, (-4.0, 3.5, 0.0)
#: Phrases in which an entry doesn't count.
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "trash bag", "idiot proof", "pathetic fallacy", "loser bracket", "pond scum")
#: Letters of other scripts and signs by the Latin letter they look like; l and 1 fold to i.
LOOKALIKES = {
    "a": "аɑα4@", "b": "вь8β", "c": "сϲ", "d": "ԁ", "e": "еєεҽ3", "g": "ɡ", "h": "һнհ", "i": "іιӏɩ1l!|ı", "j": "јϳ", "k": "кκ",
    "m": "м", "n": "ոη", "o": "оοσօ0", "p": "рρ", "q": "ԛ", "s": "ѕ5$ꜱ", "t": "тτ7", "u": "υսʋ", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
SIGNS = "@!|$"
END = 0x10FFFF

_table: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to folded code point: 0 to delete, a blank for what isn't part of a word. Signs fold to blanks here."""
    if not _table:
        like = {c: base for base, signs in LOOKALIKES.items() for c in signs}
        table = np.full(0x110000, 0x20, np.uint32)
        for c in range(0x110000):
            char = chr(c)
            kind = unicodedata.category(char)
            if kind in ("Mn", "Me", "Cf"):
                table[c] = 0
            elif kind[0] in "LN" or kind == "Mc":
                base = unicodedata.normalize("NFKD", char)[0].casefold()[0]
                table[c] = ord(like.get(base, base))
        table[END] = END
        _table.append(table)
    return _table[0]


def fold(texts: Sequence[str]) -> list[str]:
    """Each text as folded words with one blank before, between and after them."""
    mark = chr(END)
    points = np.frombuffer(mark.join([t.replace(mark, " ") for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = fold_table()[points]
    for sign in SIGNS:  # a sign stands for a letter only before a letter
        at = np.flatnonzero(points[:-1] == ord(sign))
        at = at[(folded[at + 1] != 0x20) & (folded[at + 1] != END)]
        folded[at] = next(ord(base) for base, signs in LOOKALIKES.items() if sign in signs)
    folded = folded[folded != 0]
    gap = folded == 0x20
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return [f" {x.strip()} " for x in folded[keep].tobytes().decode("utf-32-le", "surrogatepass").split(mark)]


def entries_of(folded: str) -> set[str]:
    """The possible lexicon entries in a text: ' word ' and ' stem'."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    """Entries with weights, and the logistic model of a text's features."""

    weights: dict[str, float]
    model: tuple[float, float, float] = DEFAULT_MODEL
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = fold([phrase])[0]
            found.add_word(entry, (len(entry), None))
        found.make_automaton()
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        bias, density, largest = self.model
        return 1 / (1 + np.exp(-np.clip(bias + features @ np.array([density, largest]), -500, 500)))


def features(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, float]:
    """Weight per 100 words (as a logarithm) and the largest weight. A word counts once, with its largest entry; words in
    exception phrases don't count. A text without words has 0 and 0."""
    best: dict[int, float] = {}
    excepted = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excepted.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excepted:
        best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in excepted)}
    if not best:
        return 0.0, 0.0
    return math.log1p(100 * sum(best.values()) / (folded.count(" ") - 1)), max(best.values())


def weigh(counts: dict[str, tuple[int, int]], n_docs: int, n_toxic: int) -> dict[str, float]:
    """Weights from documents with an entry and toxic ones among them: the Wilson bound's log odds over the base rate's."""
    base = math.log((n_toxic + 1) / (n_docs - n_toxic + 1))
    out = {}
    for entry, (n, toxic) in counts.items():
        if toxic >= LEAST_DOCS:
            rate, zz = toxic / n, Z * Z
            low = (rate + zz / (2 * n) - Z * math.sqrt(rate * (1 - rate) / n + zz / (4 * n * n))) / (1 + zz / n)
            weight = math.log(low / (1 - low)) - base
            if weight >= LEAST_WEIGHT:
                out[entry] = weight
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Bias and two slopes by Newton steps; the ridge draws them to the default model where rows are few."""
    a = np.column_stack([np.ones(len(x)), x])
    prior = np.array(DEFAULT_MODEL)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3), a.T @ (p - y) + ridge * (w - prior))
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Learn the lexicon and its model from the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most ``max_labelled`` rows are used, in the order of a hash of doc_id; labels and ids choose rows and are no input
    of a score. Entries are counted on the executors, for two halves of the rows apart; each half is scored by the other
    half's lexicon, and the model is fitted to those scores. Null labels and texts, and labels without a document, are
    left out; of several labels of a document the largest counts.
    """
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    bodies = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = materialize(bodies.join(F.broadcast(chosen), "doc_id").select("toxic", half, "text"), "toxic")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    if any(not sizes.get((h, t)) for h in (0, 1) for t in (0, 1)):
        return Lexicon({f" {w} ": DEFAULT_WEIGHT for x in DEFAULT_WORDS for w in fold([x])[0].split()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, halves, texts = (c.to_pylist() for c in batch.columns)
            for a, b in pieces(texts):
                seen: Counter = Counter()
                for t, h, folded in zip(toxic[a:b], halves[a:b], fold(texts[a:b]), strict=True):
                    seen.update((entry, h, t) for entry in entries_of(folded))
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["entry", "half", "toxic", "n"])

    part = lambda h, t: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}")
    counted = sample.mapInArrow(tidy(count), "entry string, half int, toxic int, n long").groupBy("entry").agg(*[part(h, t) for h in (0, 1) for t in (0, 1)])
    # of an entry to be weighed, most documents are toxic: the bound's odds must be above the base rate's
    rows = counted.where(F.col("n01") + F.col("n11") >= LEAST_DOCS).where((F.col("n01") + F.col("n11")) * 2 >= F.col("n00") + F.col("n10"))
    rows = rows.orderBy((F.col("n01") + F.col("n11") - F.col("n00") - F.col("n10")).desc(), "entry").limit(16 * MAX_ENTRIES).collect()
    halves = [weigh({r["entry"]: (r[f"n{h}0"] + r[f"n{h}1"], r[f"n{h}1"]) for r in rows if r[f"n{h}1"]}, sizes[h, 0] + sizes[h, 1], sizes[h, 1]) for h in (0, 1)]
    whole = weigh({r["entry"]: (r["n00"] + r["n01"] + r["n10"] + r["n11"], r["n01"] + r["n11"]) for r in rows}, sum(sizes.values()), sizes[0, 1] + sizes[1, 1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [Lexicon(halves[1]).automaton(), Lexicon(halves[0]).automaton()]
        for batch in batches:
            toxic, own, texts = (c.to_pylist() for c in batch.columns)
            x = np.array([features(other[h], f) for a, b in pieces(texts) for h, f in zip(own[a:b], fold(texts[a:b]), strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "density", "largest"])

    # at most max_labelled rows of three numbers, in a fixed order
    measured = np.array(sorted(map(tuple, sample.mapInArrow(tidy(measure), "toxic int, density double, largest double").collect())))
    return Lexicon(whole, logistic(measured[:, 1:], measured[:, 0]))


def scorer(spark: SparkSession, lexicon: Lexicon) -> Callable[[Column], Column]:
    """The score of a column of whole texts; a null or empty text scores as a text without any entry."""
    told = spark.sparkContext.broadcast(lexicon)  # MAX_ENTRIES entries at most

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = told.value.automaton()
        for batch in batches:
            x = [features(automaton, folded) for _, texts in parts(pc.fill_null(batch, "")) for folded in fold(texts)]
            yield pa.array(told.value.score(np.array(x).reshape(-1, 2)))

    return F.arrow_udf(tidy(run), "double")


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; no shuffle. Repeated rows give repeated rows, an empty table none; other columns,
    whatever their names, are not read. A very long text is scored as a whole, by itself."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), scorer(docs.sparkSession, lexicon)(F.col(text)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all columns; null and empty texts stay. Only texts go through Python."""
    return docs.where(scorer(docs.sparkSession, lexicon)(F.col("text")) < 0.5)
