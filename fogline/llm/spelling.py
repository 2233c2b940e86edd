"""Grouping of spelling variants by asymmetric q-chunks. DataFrame functions only.

Two words are near if one edit of a character leads from one to the other. The longer word (of words of equal length, either) gives
two disjoint chunks, its halves; one edit keeps one of them. The half with the edit is cut in two again, and one edit keeps one of
these as well, so a word has four keys: itself without one of its quarters. The other word gives grams: for its own length and the
next one, the characters where such chunks may lie, those after the edit one place to the left where it is the shorter word. Chunks
and grams join by key, and pairs are verified. A key holds three quarters of a word, so few words share it, however many there are. No join
broadcasts a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.runtime import Rounds, materialize, shuffled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what a run of letters is.
RUN = r"[A-Za-zÀ-ÿ]+"
#: A run loses a character where the crc32 of its document and itself is a multiple of this.
THINNED = 97
#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form has at least this many times its count.
FORM_TIMES = 2
QUARTERS = range(4)


def _lowered(run: Column) -> Column:
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of whole texts and how often they occur.

    A null text has none; a null id counts as an empty string in the crc32; repeated rows count as often as they occur; other columns,
    whatever their names, are not read. Runs are counted before they are shuffled, so frequent words don't gather in a task.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= LEAST_LENGTH).select("id", _lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % THINNED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(word: Column, own: Column, length: Column, quarter: int) -> Column:
    """Of a word of ``own`` characters, what a word of ``length`` characters has before and after its quarter, hashed."""
    first, last = F.floor(length * quarter / 4).cast("int"), F.floor(length * (quarter + 1) / 4).cast("int")
    after = (length - last).cast("int")
    return F.xxhash64(length, F.lit(quarter), F.substring(word, F.lit(1), first), F.substring(word, own - after + 1, after))


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the words (word, n) that one edit leads to, both ways, each pair once."""
    w, size = F.col("word"), F.char_length("word")
    chunks = counted.select("word", "n", F.explode(F.array(*[_key(w, size, size, q) for q in QUARTERS])).alias("key"))
    longer = [_key(w, size, size + more, q) for more in (0, 1) for q in QUARTERS]
    grams = counted.select(w.alias("other"), F.col("n").alias("other_n"), F.explode(F.array(*longer)).alias("key"))
    met = chunks.join(shuffled(grams), "key").where((F.char_length("word") > F.char_length("other")) | (F.col("word") < F.col("other")))
    pairs = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    back = F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), w.alias("other"), F.col("n").alias("other_n"))
    return pairs.select(F.inline(F.array(F.struct("word", "n", "other", "other_n"), back)))


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of words with a form (word, form): where forms lead at last. Each round doubles the steps taken.

    A form is more frequent than its word, so forms never lead back; a table that they do in raises.
    """
    rounds = Rounds("roots")
    state = rounds.write(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = state.join(shuffled(on), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        state = rounds.write(moved)
        if state.where("moved").limit(1).count() == 0:
            return state.drop("moved")
        state = state.drop("moved")
    raise RuntimeError(f"forms lead on after {max_rounds} rounds")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near words' number, the most frequent of them as its form (the
    smallest in code-point order among equals) if that occurs FORM_TIMES as often, and where forms lead at last.

    Nulls, repeated rows and further columns count as in ``words``; a very long text is one row until its runs are told apart; an
    empty table gives no words.
    """
    counted = materialize(words(docs, doc_id, text), "words")
    least = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = near_pairs(counted).groupBy("word", "n").agg(F.count("*").alias("n_near"), least)
    enough = -F.col("best.minus") >= FORM_TIMES * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "near")
    out = counted.join(shuffled(near), "word", "left").join(shuffled(roots(near.where("form is not null"))), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
