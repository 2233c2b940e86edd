"""Merge-type pieces against the library, and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize
from fogline.llm import piece_bpe, spelling

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, key string, run int, word string, id string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2) for i, t in rows], SCHEMA)


# 12: SentencePiece


def made_texts():
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "the", "1", "é", "日", "\n", "▁", " " * 17, "aaa", "ing", "-", "'", "\x00", "梦", "hello", "<s>", "<0x0A>", "ﬁ", "́", "🙂"]
    odd = [None, "", " ", "   ", "x", "a" * 3000, "=" * 500, " " * 1000 + "x", "日" * 2000, "x y" * 3000]
    return [*odd, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600))]


def test_pieces_equal_the_library_and_decode(spark):
    library, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), made_texts()
    docs = table(spark, [*enumerate(texts), (1, texts[1])])
    got = piece_bpe.decode(piece_bpe.encode(docs, MODEL), MODEL).collect()
    assert len(got) == len(texts) + 1
    told = {r["doc_id"]: r for r in piece_bpe.digests(docs, MODEL).collect()}
    for row in got:
        want = [*library.encode(texts[row["doc_id"]] or ""), 2]
        assert row["ids"] == want and row["decoded"] == library.decode(want)
        one = told[row["doc_id"]]
        assert one["n_tokens"] == len(want)
        assert one["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert one["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert piece_bpe.digests(table(spark, []), MODEL).count() == 0


def test_any_ids_decode_as_the_library_does():
    library, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.Encoder(MODEL), random.Random(7)
    for _ in range(300):
        ids = [rng.randrange(32000 if rng.random() < 0.5 else 260) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids)


def test_pieces_dont_depend_on_memory(monkeypatch):
    texts = [t or "" for t in made_texts()]
    want = [piece_bpe.Encoder(MODEL).ids(t) for t in texts[:50]]
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(piece_bpe, "KEPT_PAIRS", 2)
    encoder = piece_bpe.Encoder(MODEL)
    got = []
    for t in texts[:50]:
        encoder.trim()
        got.append(encoder.ids(t))
    assert got == want


def test_search_goes_back_and_equals_merging():
    """Over few pieces, so that the longest piece is often wrong."""

    class Few:
        def __init__(self, pieces):
            self.ids = {p: i for i, p in enumerate(pieces)}
            self.score = {p: -i for i, p in enumerate(pieces)}

    rng = random.Random(3)
    for _ in range(60):
        pieces = ["a", "b", "c"]
        for _ in range(rng.randint(1, 14)):
            new = rng.choice(pieces) + rng.choice(pieces)
            if new not in pieces:
                pieces.append(new)
        search = piece_bpe.Backtracker(Few(pieces))
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
            assert search.encode(text) == search.merged(text)


def test_models_of_other_kinds_are_errors(tmp_path):
    (tmp_path / "m").write_bytes(b"\x0a\x05\x0a\x03abc\x0a\x08\x0a\x04</s>\x18\x03\x0a\x09\x0a\x05<unk>\x18\x02")
    with pytest.raises(ValueError, match="merge-type"):
        piece_bpe.Model(str(tmp_path / "m"))


# 11: spelling variants


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        found = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form[w] = found[0] if found and n[found[0]] >= 2 * n[w] else None
        out[w] = len(found)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], form[w] and n[form[w]])
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["letter", "lattice", "garden", "ångström", "straße", "aaaaaaa", "Commit", "mixed", "abcde", "éclair", "Ünder"]
    words = [*base]
    for w in base * 12:
        k, c = rng.randrange(len(w)), rng.choice("abeéÿz")
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]))
    rows = [(i, " ".join(rng.choice(words[: rng.choice([3, 20, len(words)])]) + rng.choice(["", ",", "1", "×", "Ā"]) for _ in range(300))) for i in range(12)]
    rows += [(None, "letter letter lettre " * 4), (3, None), (4, ""), (5, "word " * 3000), (5, "word " * 3000), (6, "a" * 3000), (7, "w1 w2 _x_ ")]
    want = brute_variants(rows)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table(spark, rows)).collect()}
    assert got == want
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(v[3] > 3 for v in want.values())


def test_variants_of_odd_tables(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, "one two"), (3, "short")])).count() == 0
    tie = [(k, t) for k, t in enumerate(["abcdex abcdex abcdex abcdex abcdex abcdex", "abcdey " * 6, "abcde abcde abcde"])]
    assert {w: v for w, v in brute_variants(tie).items()} == {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table(spark, tie)).collect()}


def test_a_chain_of_forms_ends_at_its_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w20"}
    with pytest.raises(RuntimeError):
        spelling.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), max_rounds=3)


def test_no_key_holds_many_words(spark):
    words = [("".join(w), 3) for w in __import__("itertools").product("abcd", repeat=6)]
    keys = spark.createDataFrame(words, "word string, n long").select(F.explode(F.array(*[spelling._key(F.col("word"), F.lit(6), F.lit(6), q) for q in range(4)])).alias("k"))
    assert keys.groupBy("k").count().agg(F.max("count")).first()[0] <= 16


def test_no_join_of_words_broadcasts(spark, monkeypatch):
    """Spark sizes words by their file's bytes; their keys are many times as many."""
    planned = []
    monkeypatch.setattr(spelling, "materialize", lambda df, name: planned.append(df) or materialize(df, name))
    monkeypatch.setattr(spelling.Rounds, "write", lambda self, df, watch=None, write=spelling.Rounds.write: planned.append(df) or write(self, df, watch))
    out = spelling.variants(table(spark, [(1, "letter letter letter letter letter letter lettex lettex lettex ")]))
    assert {r["word"]: r["root"] for r in out.collect()} == {"letter": "letter", "lettex": "letter"}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*planned, out]]
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
