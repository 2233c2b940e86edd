"""The trie of conversations against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fogline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block string, depth string, owner string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "o") for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def sequences(rows, family=20, heads=4):
    """Rebuilt turns by conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    for turns in own.values():
        turns.sort()
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = [(t[3], t[4]) for t in own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]]
    return out


def brute_trie(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, out = {}, set()
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved = {p: (len(c) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, c in nodes.items()}
    leaves = {p: int(p not in kids) for p in nodes}
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    for p, c in nodes.items():
        ends = ",".join(map(str, sorted(x for x in c if len(seqs[x]) == len(p))))
        out.add((min(c), len(p), min(nodes[p[:-1]]) if p else None, len(c), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made_rows():
    rng, rows = random.Random(4), []
    for c in [*range(0, 65), -7, -20, 10**12]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, k, rng.choice(["user", None, "assistant"]), rng.choice(["hi", "hello there", "", None, "a b  c\td"])))
    rows += [(90, k, "user", f"turn {k % 7}") for k in range(400)] + [(91, k, "user", f"turn {k % 7}") for k in range(390)]
    rows += [(70, 0, "user", "only one")] * 3 + [(71, None, "b", "x"), (71, None, "a", "x"), (71, 1, "a", "y z")]
    rows += [(c, 0, "user", "same") for c in range(100, 160)]
    rows += [(None, 0, "user", "nobody's"), (165, 0, "u", "long " * 5000)]
    rng.shuffle(rows)
    return rows


def told(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


@pytest.mark.parametrize("bounds", [{}, {"COMPONENT": 3, "PATH_BIN": 8, "MEMBER_BITS": 2, "HOT_PART": 4}, {"COMPONENT": 60, "PATH_BIN": 64, "HOT_PART": 1}])
def test_trie_equals_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rows = made_rows()
    got = told(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, rows)))))
    assert len(got) == len(set(got)) and set(got) == brute_trie(sequences(rows))


def test_trie_of_conversations_as_they_are(spark):
    rows = [r for r in made_rows() if r[0] is not None]
    turns = prefix_trie.turns(table(spark, rows))
    assert set(told(prefix_trie.trie(turns, prefix_trie.members(turns)))) == brute_trie(sequences(rows, family=1, heads=1))


def test_trie_of_odd_tables(spark):
    for rows in ([], [(None, 1, "a", "b")]):
        assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, rows)))).count() == 0
    # 3 has a base without turns and fewer turns than it would replace, so it is left without any
    assert zlib.crc32(b"3") % 4 >= 1
    assert set(told(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, [(3, 5, None, None)])))))) == brute_trie({3: []})


def test_rounds_follow_the_logarithm_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "COMPONENT", 20)
    rows = [(0, k, "u", str(k)) for k in range(600)]
    turns = prefix_trie.turns(table(spark, rows))
    way = prefix_trie.paths(turns, prefix_trie.members(turns))
    nodes = prefix_trie.forest(way).selectExpr("*", "cast(n_children = 0 as long) as leaves", "depth as saved")
    got = {r["depth"]: (r["n_leaves"], r["saved_tokens"]) for r in prefix_trie.rollup(nodes, way, max_rounds=7).collect()}
    assert got == {d: (1, sum(range(d, 601))) for d in range(601)}
    with pytest.raises(RuntimeError):
        prefix_trie.rollup(nodes, way, max_rounds=3)


def test_subtree_totals_of_random_forests():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 80)
        # each node is its own conversation; a node's parent is named by the parent's conversation
        up = [rng.randrange(max(0, k - rng.choice([1, 3, 80])), k) if k and rng.random() < 0.95 else -1 for k in range(n)]
        depth = [0] * n
        for k in range(n):
            depth[k] = depth[up[k]] + 1 if up[k] >= 0 else 0
        label = [0] * n
        for k in range(n):
            label[k] = label[up[k]] if up[k] >= 0 and rng.random() < 0.9 else k
        values = np.array([[rng.randint(0, 9), rng.randint(-3, 10**12)] for _ in range(n)], np.int64)
        want = values.copy()
        for k in reversed(range(n)):
            if up[k] >= 0 and label[up[k]] == label[k]:
                want[up[k]] += want[k]
        order = rng.sample(range(n), n)
        pick = lambda x: np.array([x[k] for k in order], np.int64)
        parent = [u if u >= 0 else 0 for u in up]
        got = prefix_trie.subtree_totals(pick(parent), pick(range(n)), pick(depth), pick(label), values[order])
        assert (got == want[order]).all()
