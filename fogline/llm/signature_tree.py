"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold. Linked sets share some
of their rarest shingles (prefix filtering), so documents that share enough of these form clusters, and no link crosses
clusters. A cluster, or a block of a large one, is joined in one task by a signature tree: leaves hold a few documents,
nodes hold the OR of their documents' token bitmaps and the range of their set sizes, and a dual traversal drops node
pairs whose largest possible overlap is too small. Pairs left are checked on the sets themselves.

Shingles are compared by 64-bit hashes; two different shingles of a compared pair collide with a chance below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import Rounds, arrow_rows, materialize, small
from fogline.llm.bitmaps import filter_of, may_have
from fogline.llm.words import BASE, mixed, powers
from fogline.llm.workers import tidy

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Bits of a document's bitmap, documents of a leaf, children of a node.
BITMAP_BITS, LEAF, FANOUT = 1024, 32, 4
#: Frequent shingles that order prefixes, at most: 4 MB for driver and broadcast. A prefix prefers shingles that aren't
#: among them, then rarer ones. Any such order finds every link; a good one keeps clusters small.
MAX_FREQUENT, LEAST_IN_BATCH, LEAST_FREQUENT = 1 << 18, 2, 32
#: Rows up to which a shingle's pairs are listed, and the part of a set that prefixes of linked sets share at least: a tenth
#: keeps apart documents that share passages only.
SMALL, SHARED_PART = 8, 10
#: Bounds of what a task joins at once: documents, and shingles of them.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 4_000_000
#: Documents that stand for a block's component, and for a cluster, when blocks are first brought together.
STANDS, MAX_STANDS = 8, 1024
#: Bytes whose words are hashed at once; bounds the arrays in memory.
PIECE_BYTES = 500_000
#: Documents whose sets are held at once where each is handled by itself.
SLICE = 512
#: Rows of an Arrow batch, and shingles that are counted together (of one document at least).
BATCH_ROWS, COUNTED = 1000, 2_000_000
#: Edges that one task joins, 1.6 MB; beyond that, rounds of joins do.
TASK_EDGES = 100_000
#: A key is hot if it has this part of all rows or more. There are at most so many, which bounds what is sent to all rows.
HOT_PART = 1000
#: Bits of the filter of documents that are in clusters: the bound of what is broadcast to keep other texts from the
#: shuffle (4 MB). If more documents than fit are in clusters, more texts are shuffled, and the result stays the same.
FILTER_BITS = 1 << 25


_byte_values = mixed(np.arange(256, dtype=np.uint64) * np.uint64(BASE) + np.uint64(7))
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles: runs of ``words`` words, A-Z lower-cased. A text with
    fewer words has one shingle of them all; one without words, or a null, has none."""
    out: list[np.ndarray] = []
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    a = 0
    while a < len(sizes):
        b, total = a + 1, int(sizes[a])
        while b < len(sizes) and total + sizes[b] + 1 <= PIECE_BYTES:
            total += int(sizes[b]) + 1
            b += 1
        out += _shingles(b"\n".join([x.as_buffer() for x in lowered.slice(a, b - a)]), sizes[a:b], words)
        a = b
    return out


def _shingles(joined: bytes, sizes: np.ndarray, words: int) -> list[np.ndarray]:
    raw = np.frombuffer(joined, np.uint8)
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~_white[raw]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values[raw] * power[: len(raw)], out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum(sizes + 1) - sizes - 1
    first = np.append(np.searchsorted(starts, begins), len(starts))
    factor = power[1 : words + 1]
    n = max(len(word) - words + 1, 0)
    runs = np.full(n, words, np.uint64)
    for k in range(words):
        runs += word[k : k + n] * factor[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([(word[a:b] * factor[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set: equal sets have equal names."""
    with np.errstate(over="ignore"):
        one, two = mixed(tokens).sum(), np.bitwise_xor.reduce(mixed(tokens + np.uint64(0x5851F42D4C957F2D)))
        names = np.array([one * np.uint64(3) + two + np.uint64(len(tokens)), two * np.uint64(5) ^ one ^ np.uint64(0x2545F4914F6CDD1D)], np.uint64)
        first, second = mixed(names).view(np.int64).tolist()
        return first, second


def told_apart(signed: DataFrame) -> DataFrame:
    """``signed`` with classes of one name and several second names named by both; sets that differ then share a class only if 128 bits are
    equal. Such names are next to none, so their number is checked before they are sent to the rows."""
    clash = signed.where("class is not null").groupBy("class").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a != b")
    clash = materialize(clash.select(F.col("class").alias("name")), "clashes")
    if clash.limit(1).count():
        signed = signed.join(small(clash), F.col("class") == F.col("name"), "left")
        signed = signed.withColumn("class", F.when(F.col("name").isNotNull(), F.col("class").bitwiseXOR(F.col("second"))).otherwise(F.col("class"))).drop("name")
    return signed.drop("second")


def _least_overlap(n: int) -> int:
    return -(-NUMERATOR * n // DENOMINATOR)


def _shared(n: int) -> int:
    """How many shingles the prefix of a set of this size shares at least with that of a linked set not larger in this number."""
    return max(1, n // SHARED_PART)


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles in many documents, from the least to the most frequent.

    Counts cover all documents; a shingle with fewer than LEAST_IN_BATCH documents of those counted together isn't counted there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            kept = n >= LEAST_IN_BATCH
            return pa.RecordBatch.from_arrays([pa.array(token[kept].view(np.int64)), pa.array(n[kept])], ["token", "n"])

        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            for tokens in shingles(batch.column(0)):
                held.append(tokens)
                size += len(tokens)
            if size >= COUNTED:
                yield counted()
                size = 0
        yield counted()

    rows = docs.select("text").mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    rows = rows.orderBy(F.col("n").desc(), "token").limit(MAX_FREQUENT).toArrow()
    return rows.column("token").to_numpy().view(np.uint64)[::-1].copy()


def signatures(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class and second (its names, null if none), and its rarest shingles: ``prefix`` those that aren't among
    the frequent ones of ``order``, ``common`` those that are."""
    told = docs.sparkSession.sparkContext.broadcast((np.sort(order), np.argsort(order).astype(np.int64)))  # MAX_FREQUENT at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = told.value
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            sets = shingles(batch.column(1))
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = np.minimum(np.searchsorted(known, every), max(len(known) - 1, 0))
            rank = np.where(known[at] == every, place[at], -1) if len(known) else np.full(len(every), -1)
            names, prefixes, commons, k = [], [], [], 0
            for tokens in sets:
                n = len(tokens)
                own = rank[k : k + n]
                k += n
                if not n:
                    names.append((None, None))
                    prefixes.append(tokens.view(np.int64))
                    commons.append(tokens.view(np.int64))
                    continue
                size = n - _least_overlap(n) + _shared(n)
                hot = own >= 0
                rare = tokens[~hot][:size]
                names.append(class_id(tokens))
                prefixes.append(rare.view(np.int64))
                commons.append(tokens[hot][np.argsort(own[hot])][: size - len(rare)].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, commons)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), *lists], ["doc_id", "n_shingles", "class", "second", "prefix", "common"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, class long, second long, prefix array<long>, common array<long>")


def _met(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` by ``key``, where ``weight`` counts a key's rows of ``total``: hot keys, which HOT_PART bounds, are
    sent to the rows, and the others' rows are shuffled."""
    hot = table.where(F.col(weight) * HOT_PART >= total)
    if not hot.limit(1).count():
        return rows.join(table, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) * HOT_PART < total), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges: the smallest node that it is connected with.

    Alternates large-star and small-star steps: each node points all larger neighbours, then all others, to the smallest. Every
    step is written to the shared folder, in place of the one before. Aggregates combine before the shuffle, and nodes with very
    many neighbours don't meet in a task. Up to TASK_EDGES edges, two ids each, are united by one task instead.
    """
    larger = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    rounds, between, nodes, before = Rounds("components"), Rounds("large"), Rounds("least"), None
    now = rounds.write(edges.where(F.col(a) != F.col(b)).select(*larger).distinct())
    total = now.count()
    if total <= TASK_EDGES:
        return materialize(now.coalesce(1).mapInArrow(tidy(_united), "node long, root long"), "roots")
    while True:
        # large star: of u and its neighbours, the larger ones go to the smallest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = nodes.write(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "w"))
        large = _met(now, least, "v", "w", total).select("u", F.col("m").alias("v")).where("u != v")
        large = between.write(large.distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        least = nodes.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")))
        near = _met(large, least, "u", "w", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = rounds.write(near.where("u != v").distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == before:
            break
        before, total = state, max(state["n"], 1)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a bounded number of edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["node", "root"])


class Tree:
    """Documents of a block with sets, bitmaps and the nodes above them; nodes are ranges of the documents' order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array(list(map(len, sets)), np.int64)
        # similar sets stand near each other: by size class, then by the smallest shingle
        scale = np.floor(np.log(self.sizes) / np.log(1.25))
        self.order = np.lexsort((np.array([s[0] for s in sets], np.uint64), scale))
        self.sets = [sets[k] for k in self.order.tolist()]
        self.sizes = self.sizes[self.order]
        bits = np.zeros((len(sets), BITMAP_BITS), bool)
        flat = np.concatenate(self.sets)
        bits[np.repeat(np.arange(len(sets)), self.sizes), (flat % np.uint64(BITMAP_BITS)).astype(np.int64)] = True
        self.maps = np.packbits(bits, axis=1).view(np.uint64)
        #: shingles that share a bit with another one of their document
        self.slack = self.sizes - bits.sum(1)
        self.nodes: list[tuple[int, int, list[int], np.ndarray, int, int, int]] = []
        level = [self._node(a, min(a + LEAF, len(sets)), []) for a in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._node(self.nodes[g[0]][0], self.nodes[g[-1]][1], g) for g in (level[a : a + FANOUT] for a in range(0, len(level), FANOUT))]
        self.root = level[0]

    def _node(self, a: int, b: int, children: list[int]) -> int:
        union = np.bitwise_or.reduce([self.nodes[c][3] for c in children] if children else self.maps[a:b], axis=0)
        sizes = self.sizes[a:b]
        self.nodes.append((a, b, children, union, int(sizes.min()), int(sizes.max()), int(self.slack[a:b].max())))
        return len(self.nodes) - 1


def enough(overlap, n, m):
    """Whether an overlap links sets of sizes n and m."""
    return DENOMINATOR * overlap >= NUMERATOR * (n + m - overlap)


class Labels:
    """Which documents are known to be connected."""

    def __init__(self, first: np.ndarray):
        _, self.of = np.unique(first, return_inverse=True)

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        self.of[self.of == max(x, y)] = min(x, y)


def join_trees(one: Tree, two: Tree | None, labels: Labels) -> Iterator[tuple[int, int]]:
    """Links between documents of two trees, or within one, as far as they connect what isn't connected yet.

    Places of ``two`` follow those of ``one`` in ``labels``. Yields places; every pair of linked documents ends up
    connected. Node pairs are dropped if all their documents are connected already, if their size ranges don't meet the
    threshold, or if the bits that both unions have, with the shingles that share bits, are too few for an overlap.
    """
    other, shift = (one, 0) if two is None else (two, len(one.sets))
    stack = [(one.root, other.root)]
    while stack:
        p, q = stack.pop()
        a, b, children, union, least, most, slack = one.nodes[p]
        c, d, others, union2, least2, most2, slack2 = other.nodes[q]
        first = labels.of[a]
        if (labels.of[a:b] == first).all() and (labels.of[c + shift : d + shift] == first).all():
            continue
        if DENOMINATOR * most < NUMERATOR * least2 or DENOMINATOR * most2 < NUMERATOR * least:
            continue
        bound = int(np.bitwise_count(union & union2).sum()) + min(slack, slack2)
        if not enough(min(bound, most, most2), least, least2):
            continue
        same = two is None and p == q
        if not children and not others:
            yield from _leaves(one, other, a, b, c, d, shift, same, labels)
        elif same:
            pairs = [(x, y) for k, x in enumerate(children) for y in children[k:]]
            stack += sorted(pairs, key=lambda x: x[0] == x[1])  # a node with itself comes first
        elif not others or (children and b - a >= d - c):
            stack += [(x, q) for x in children]
        else:
            stack += [(p, y) for y in others]


def _leaves(one: Tree, other: Tree, a: int, b: int, c: int, d: int, shift: int, same: bool, labels: Labels) -> Iterator[tuple[int, int]]:
    n, m = one.sizes[a:b, None], other.sizes[None, c:d]
    only = np.bitwise_count(one.maps[a:b, None] & ~other.maps[None, c:d]).sum(2).astype(np.int64)
    only2 = np.bitwise_count(other.maps[None, c:d] & ~one.maps[a:b, None]).sum(2).astype(np.int64)
    possible = enough(np.minimum(n - only, m - only2), n, m)
    if same:
        possible = np.triu(possible, 1)
    for i, j in np.argwhere(possible).tolist():
        x, y = a + i, c + j
        if labels.of[x] != labels.of[y + shift]:
            s, t = one.sets[x], other.sets[y]
            if len(s) > len(t):
                s, t = t, s
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            if enough(int((t[at] == s).sum()), len(s), len(t)):
                labels.join(x, y + shift)
                yield x, y


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """The rows of each value of the first column; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if held and keys[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield key, pa.Table.from_batches(held)


LINK = "a long, b long"


def _links(rows: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def join_within(members: DataFrame, block: str = "block") -> DataFrame:
    """Links (a, b) of classes within each block of ``members`` (block, class, text) that connect all linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches):
            names = table.column(1).to_pylist()
            tree = Tree(shingles(table.column(2).combine_chunks()))
            ordered = [names[k] for k in tree.order.tolist()]
            yield _links((ordered[x], ordered[y]) for x, y in join_trees(tree, None, Labels(np.arange(len(names)))))

    return members.select(block, "class", "text").repartition(block).sortWithinPartitions(block).mapInArrow(tidy(run), LINK)


def join_across(targets: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (a, b) between a block's documents and the queries sent to it; both have block, class, root and text.

    Documents with one root are connected already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches):
            asked = table.column(1).to_numpy().astype(bool)
            names, roots = table.column(2).to_numpy(), table.column(3).to_numpy()
            if asked.all() or not asked.any():
                continue
            sets = shingles(table.column(4).combine_chunks())
            one, two = (Tree([sets[k] for k in np.flatnonzero(side).tolist()]) for side in (~asked, asked))
            mine, theirs = np.flatnonzero(~asked)[one.order], np.flatnonzero(asked)[two.order]
            labels = Labels(roots[np.concatenate([mine, theirs])])
            yield _links((int(names[mine[x]]), int(names[theirs[y]])) for x, y in join_trees(one, two, labels))

    rows = targets.select("block", F.lit(0).alias("asked"), "class", "root", "text").unionByName(queries.select("block", F.lit(1).alias("asked"), "class", "root", "text"))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(run), LINK)


def clusters(signed: DataFrame) -> DataFrame:
    """(node, root) of classes that can be linked, directly or over others.

    Prefixes of linked sets share at least the smaller of their two ``_shared`` numbers of shingles. A shingle in the
    prefixes of up to SMALL classes gives its pairs of classes, at most 28; a pair stays if its shingles of this kind, with
    the frequent ones that both could share, are enough. Pairs that share frequent shingles only have enough of those
    each, so classes with enough are tied to the smallest of them at each frequent shingle, in as many rows as classes.

    A class is taken once, however many copies it has: only rows whose class a filter of repeated ones lets through are
    shuffled for that. The classes of a common shingle, of which there are MAX_FREQUENT at most, are counted where they are.
    """
    signed = signed.where("class is not null").select("class", F.col("n_shingles").alias("n"), "prefix", "common")
    repeated = may_have(filter_of(signed.groupBy("class").count().where("count > 1"), F.col("class")), F.col("class"))
    once = materialize(signed.where(~repeated).unionByName(signed.where(repeated).dropDuplicates(["class"])), "classes")
    rare_ones = once.select("class", "n", F.explode("prefix").alias("token")).repartition("token")
    common_ones = once.select("class", "n", F.explode("common").alias("token"))
    counts = lambda entries: entries.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = rare_ones.join(counts(rare_ones), "token").withColumn("sent", F.lit(False))
    shared = shared.unionByName(common_ones.join(F.broadcast(counts(common_ones)), "token").withColumn("sent", F.lit(True)))
    shared = materialize(shared, "shared")
    frequent_ones = shared.where(F.col("rows") > SMALL)
    enough_for = lambda n: F.greatest(F.lit(1).cast("long"), F.floor(n / SHARED_PART))
    counted = materialize(frequent_ones.groupBy("class").agg(F.count("*").alias("hot"), F.first("n").alias("n")), "hot")
    rare = shared.where(F.col("rows") <= SMALL).select("token", "class", "n")
    other = rare.select("token", F.col("class").alias("b"), F.col("n").alias("m"))
    pairs = rare.join(other, "token").where((F.col("class") < F.col("b")) & _fits("n", "m")).groupBy("class", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    pairs = pairs.join(counted.select("class", F.col("hot").alias("hot_a")), "class", "left").join(counted.select(F.col("class").alias("b"), F.col("hot").alias("hot_b")), "b", "left")
    most = F.col("c") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    pairs = pairs.where(most >= enough_for(F.least("n", "m"))).select("class", F.col("b").alias("least"))
    taking_part = counted.where(F.col("hot") >= enough_for(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR))).select("class")
    tied = materialize(frequent_ones.join(taking_part, "class", "left_semi").select("token", "class", "sent"), "tied")
    stars = None
    for sent in (True, False):
        own = tied.where(F.col("sent") == sent)
        centres = own.groupBy("token").agg(F.min("class").alias("least"))
        found = own.join(F.broadcast(centres) if sent else centres, "token").where("class != least").select("class", "least")
        stars = found if stars is None else stars.unionByName(found)
    return components(pairs.unionByName(stars.distinct()), "class", "least")


def _fits(n: str, m: str) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return (F.least(n, m) * DENOMINATOR) >= (F.greatest(n, m) * NUMERATOR)


def linked(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that links lead to, the row's own included. Rows without words link with
    nothing and keep their own id; rows with equal sets are one class, so copies aren't paired with each other; a null id
    counts for no minimum. Whole texts are read, however long; an empty table stays empty; other columns, whatever their names,
    are not read. The order of shingles, clusters and blocks only save comparisons; sets are told apart by 128 bits.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _linked(docs)


def _linked(docs: DataFrame) -> DataFrame:
    signed = told_apart(materialize(signatures(docs, frequent(docs)), "signatures"))
    classes = signed.where("class is not null").groupBy("class").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("least_id"))
    near = clusters(signed)
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    named = materialize(near.join(classes, F.col("node") == F.col("class")).select("class", F.col("root").alias("cluster"), "n", "least_id"), "clusters")
    # a cluster that fits is one block; else blocks are hashed parts of a size class
    whole = named.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    fits = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= BLOCK_SHINGLES)
    scaled = named.join(whole.select("cluster", fits.alias("fits")), "cluster").withColumn("scale", F.when(F.col("fits"), 0).otherwise(F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int") + 1))
    scaled = materialize(scaled, "scaled")
    parts = scaled.where("not fits").groupBy("cluster", "scale").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = scaled.join(parts, ["cluster", "scale"], "left").withColumn("part", F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1))).cast("int"))
    placed = placed.withColumn("block", F.xxhash64("cluster", "scale", "part"))
    texts = _named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), placed)
    members = placed.join(texts, placed["least_id"].eqNullSafe(texts["doc_id"])).select("block", "class", "cluster", "scale", "fits", "n", "text")
    members = materialize(_of_class(members), "members")
    links = [materialize(join_within(members), "links")]
    large = members.where("not fits")
    if large.limit(1).count():
        links += _across_blocks(large, links[0])
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    roots = components(every, "a", "b")
    joined = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "least_id", F.coalesce("root", "class").alias("root"))
    joined = materialize(joined, "joined")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = materialize(joined.join(least, "root").select("class", "component_id"), "by-class")
    out = signed.drop("prefix", "common").join(by_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _named(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id may be a least_id of ``placed``, by a filter of FILTER_BITS bits: all that are, and some others."""
    return texts.where(may_have(filter_of(placed, F.xxhash64("least_id"), FILTER_BITS), F.xxhash64("doc_id"), FILTER_BITS))


def _of_class(members: DataFrame) -> DataFrame:
    """Rows whose text has the class they stand for; ids that repeat bring other texts along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column(batch.schema.get_field_index("text")))
            names = batch.column(batch.schema.get_field_index("class")).to_pylist()
            own = (class_id(s) if len(s) else (None, 0) for s in sets)
            yield batch.filter(pa.array([a is not None and c in (a, a ^ b) for (a, b), c in zip(own, names, strict=True)], pa.bool_()))

    return members.mapInArrow(tidy(run), members.schema)


def _across_blocks(members: DataFrame, links: DataFrame) -> list[DataFrame]:
    """Links between blocks of clusters that fill several.

    First some documents of each block's components meet in one task a cluster, which connects most of what belongs
    together. Then every document that isn't in its cluster's largest component so far goes to all blocks of about its
    size: of any two documents that aren't connected yet, one is such a document.
    """
    roots = components(links, "a", "b")
    local = materialize(members.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node"), "local")
    some = local.groupBy("cluster", "root").agg(F.count("*").alias("docs"), F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("class"), F.lit(16)) == 0, F.col("class")))), 1, STANDS).alias("few"))
    some = some.withColumn("few", F.array_distinct(F.concat("few", F.array("root")))).withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.col("docs").desc(), "root")))
    stands = some.where(F.col("rank") <= MAX_STANDS // (STANDS + 1)).select(F.explode("few").alias("class"))
    met = materialize(join_within(local.join(stands, "class", "left_semi"), "cluster"), "stands")
    merged = components(met.unionByName(local.select(F.col("class").alias("a"), F.col("root").alias("b"))), "a", "b")
    local = materialize(local.drop("root").join(merged, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node"), "merged")
    largest = local.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    asked = local.join(largest, "cluster").where("root != main").select("cluster", "class", "root", "text", F.col("scale").alias("at"))
    # a task gets a block and up to about as many queries; more queries make more such units
    split = asked.groupBy("cluster", "at").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("parts"))
    asked = asked.join(split, ["cluster", "at"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    blocks = local.select("cluster", "scale", "block").distinct()
    sent = asked.join(blocks, "cluster").where(F.abs(F.col("scale") - F.col("at")) <= 1)
    sent = sent.withColumn("unit", F.xxhash64("block", "at", "part"))
    targets = local.join(sent.select("block", "unit").distinct(), "block").drop("block").withColumnRenamed("unit", "block")
    sent = sent.drop("block").withColumnRenamed("unit", "block")
    return [met, materialize(join_across(targets, sent), "across")]
