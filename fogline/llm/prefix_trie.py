"""A trie of conversations by their turns, with totals of subtrees by centroid decomposition.

A node is a sequence of turns that some conversations begin with. It is named by its smallest member and its depth; that member owns
it, and what a conversation owns are its deepest nodes. A prefix is told by the XOR of hashes of its turns, each with its place, 120
bits in all: an XOR can be taken block by block, so a conversation of any length is worked on by many tasks.

Totals over subtrees come by centroid decomposition of the forest of parent edges. In every component the centroid, the deepest node with
more than half of the component below it, is cut off with all that hangs from it. The total of what is cut off, within the component,
is the centroid's; it is added to each node on the path from the centroid up to the component's top, and the parts are decomposed
again. So a chain of n nodes takes some log2(n) rounds and not n. Components of more than COMPONENT nodes are split by joins, all of
them at once in each round; a task then decomposes whole smaller ones.

Rows of turns are (conv, block, depth, len, digest, words): the block is the range of rows that the row was dealt to, depth counts
from 1, len is the number of turns. Joins by conversation go by (conv, block), so that a conversation with a large part of all turns
stays spread over its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize, small
from fogline.llm.workers import tidy

#: Nodes of a component that a task decomposes by itself.
COMPONENT = 4096
#: A prefix is hot if it has this part of all rows or more, so there are HOT_PART hot ones at most, which bounds their broadcast.
HOT_PART = 1000
#: Depths that are looked up together on the path of a centroid, and bits of the ids of members whose ids are put together first.
PATH_BIN, MEMBER_BITS = 4096, 13
WORDS = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(rows: DataFrame, order: list[Column], values: dict[str, Column], fold) -> DataFrame:
    """``rows`` with running folds of ``values`` along ``order`` within a conversation, and the fold of all as all_<name>.

    Blocks are folded by themselves and then one after the other, so no task has more of a conversation than a block.
    """
    inner = W.partitionBy("conv", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = rows.groupBy("conv", "block").agg(*[fold(v).alias(k) for k, v in values.items()])
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    told = blocks.select("conv", "block", *[F.coalesce(fold(k).over(before), zero).alias(f"before_{k}") for k in values], *[fold(k).over(W.partitionBy("conv")).alias(f"all_{k}") for k in values])
    out = rows.withColumns({k: fold(v).over(inner) for k, v in values.items()}).join(told, ["conv", "block"])
    join = (lambda a, b: F.col(a) + F.col(b)) if fold is F.sum else (lambda a, b: F.col(a).bitwiseXOR(F.col(b)))
    return out.withColumns({k: join(k, f"before_{k}") for k in values}).drop(*[f"before_{k}" for k in values])


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with what ``facts`` says of their conversation, joined by block."""
    return rows.join(rows.select("conv", "block").distinct().join(facts, "conv"), ["conv", "block"])


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns of (conv_id, turn, role, text), numbered by turn, null first.

    A null role or text is empty. Turns of a conversation with equal numbers go by role, then by the digest of role and text; repeated rows
    are as many turns. Rows without an id belong to no conversation and are left out. Other columns, whatever their names, are not read;
    whole texts are read here, and only their digest and number of words go on.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), digest.alias("digest"),
        F.regexp_count(said, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.repartitionByRange("conv", "turn", "role", "digest", "row").withColumn("block", F.spark_partition_id()), "turns")
    counted = _scan(rows, [F.col(c) for c in ("turn", "role", "digest", "row")], {"depth": F.lit(1).cast("long")}, F.sum)
    return materialize(counted.select("conv", "block", "depth", F.col("all_depth").alias("len"), "digest", "words"), "numbered")


def members(rows: DataFrame) -> DataFrame:
    """(conv, len) of the conversations of rows of turns."""
    return rows.groupBy("conv").agg(F.max("len").alias("len"))


def rebuilt(rows: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: rows of turns and (conv, len), turnless ones included.

    Conversation c gets the first h turns of c - c % family (all if it has fewer), then its own turns after its first h, where h is
    the crc32 of its decimal id modulo ``heads``.
    """
    found = members(rows)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    found = found.select("conv", F.col("len").alias("own"), h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    of_base = found.select(F.col("conv").alias("base"), F.col("own").alias("base_len"))
    facts = found.join(of_base, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_len", F.lit(0))))
    facts = materialize(facts.select("conv", "base", "h", "lead", (F.col("lead") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("new_len")), "families")
    own = _with_facts(rows, facts).where(F.col("depth") > F.col("h"))
    own = own.select("conv", "block", (F.col("lead") + F.col("depth") - F.col("h")).alias("depth"), F.col("new_len").alias("len"), "digest", "words")
    first = rows.where(F.col("depth") < heads).select(F.col("conv").alias("base"), "depth", "digest", "words")
    lent = facts.join(first, "base").where(F.col("depth") <= F.col("h")).select("conv", F.lit(-1).alias("block"), "depth", F.col("new_len").alias("len"), "digest", "words")
    return own.unionByName(lent), facts.select("conv", F.col("new_len").alias("len"))


def paths(rows: DataFrame, every: DataFrame) -> DataFrame:
    """(conv, block, depth, len, words, owner, parent, n): for each conversation and depth, 0 included, the node that it is in there, by its
    owner, the owner of the node above (null at depth 0), and the node's number of members.

    ``every`` is (conv, len) of all conversations, those without turns too. Prefixes are counted before they are shuffled; hot ones
    are sent to the rows.
    """
    hashed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"))
    lanes = {"x": F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), "y": F.conv(F.substring(hashed, 17, 15), 16, 10).cast("long")}
    steps = rows.withColumns(lanes).select("conv", "block", "depth", "len", "words", "x", "y")
    zero = F.lit(0).cast("long")
    root = every.select("conv", F.lit(-2).alias("block"), zero.alias("depth"), "len", zero.alias("words"), zero.alias("x"), zero.alias("y"))
    prefixes = _scan(steps, [F.col("depth")], {"x": F.col("x"), "y": F.col("y")}, F.bit_xor).drop("all_x", "all_y").unionByName(root)
    prefixes = materialize(prefixes, "prefixes")
    key = ["depth", "x", "y"]
    groups = materialize(prefixes.groupBy(*key).agg(F.min("conv").alias("owner"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("n") * HOT_PART >= total))
    met = prefixes.join(hot, key).unionByName(prefixes.join(hot.select(*key), key, "left_anti").join(groups.where(F.col("n") * HOT_PART < total), key))
    met = materialize(met.drop("x", "y"), "owners")
    above = met.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    return materialize(met.join(above, ["conv", "depth"], "left").select("conv", "block", "depth", "len", "words", "owner", "parent", "n"), "paths")


def forest(way: DataFrame) -> DataFrame:
    """(conv, depth, block, parent, n_convs, words, n_children, size) of the nodes of ``paths``; size counts the nodes of the subtree."""
    nodes = way.where("conv = owner").select("conv", "depth", "block", "parent", F.col("n").alias("n_convs"), "words")
    owned = nodes.groupBy("conv").agg(F.count("*").alias("owned"))
    # a member other than the owner has all that it owns below the node
    others = way.where("conv != owner")
    below = _with_facts(others, owned).select("owner", "depth", F.col("owned").alias("nodes"))
    mine = way.where("conv = owner").select("owner", "depth", (F.col("len") - F.col("depth") + 1).alias("nodes"))
    sizes = mine.unionByName(below).groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum("nodes").alias("size"))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = nodes.join(sizes, ["conv", "depth"]).join(children, ["conv", "depth"], "left").fillna(0, ["n_children"])
    return materialize(out, "forest")


TOP = ["top", "top_depth"]
STATE = "conv long, depth long, parent long, block int, top long, top_depth long, size long, leaves long, saved long, sum_leaves long, sum_saved long"


def rollup(nodes: DataFrame, way: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(conv, depth, n_leaves, saved_tokens): totals over the subtrees of nodes (conv, depth, parent, block, size, leaves, saved)."""
    zero = F.lit(0).cast("long")
    root = nodes.where("depth = 0").select("conv").first()
    state = nodes.select("conv", "depth", "parent", "block", F.lit(root[0] if root else None).cast("long").alias("top"), zero.alias("top_depth"), "size", "leaves", "saved", zero.alias("sum_leaves"), zero.alias("sum_saved"))
    done, rest = [], []
    for _ in range(max_rounds):
        totals = state.groupBy(*TOP).agg(F.count("*").alias("total")).where(F.col("total") > COMPONENT)
        totals = small(materialize(totals, "components"))
        rest.append(state.join(totals, TOP, "left_anti"))
        if totals.limit(1).count() == 0:
            break
        large = state.join(totals, TOP)
        deepest = F.max(F.when(F.col("size") * 2 > F.col("total"), F.struct("depth", "conv", "size"))).alias("z")
        centroids = materialize(large.groupBy(*TOP).agg(deepest).select(*TOP, F.col("z.conv").alias("z"), F.col("z.depth").alias("z_depth"), F.col("z.size").alias("z_size")), "centroids")
        cut = small(centroids)
        large = large.drop("total").join(cut, TOP)
        asked = large.where("depth > z_depth").select(*TOP, "conv", "block", "z", "z_depth").distinct()
        through = way.select("conv", (F.col("depth") - 1).alias("z_depth"), F.col("parent").alias("z"), F.col("owner").alias("child"))
        under = asked.join(through, ["conv", "z_depth", "z"]).select(*TOP, "conv", "block", "child")
        told = large.join(under, [*TOP, "conv", "block"], "left")
        told = told.withColumn("child", F.when(F.col("depth") > F.col("z_depth"), F.col("child")))
        told = materialize(told.withColumn("is_z", (F.col("conv") == F.col("z")) & (F.col("depth") == F.col("z_depth"))), "cut")
        # what is cut off at a centroid, and the path that it is added along
        off = told.where("is_z or child is not null").groupBy(*TOP).agg(F.sum("leaves").alias("off_leaves"), F.sum("saved").alias("off_saved"))
        off = materialize(off.join(centroids, TOP), "totals")
        bins = F.explode(F.sequence(F.floor(F.col("top_depth") / PATH_BIN), F.floor((F.col("z_depth") - 1) / PATH_BIN)))
        asked = off.where(F.col("z_depth") > F.col("top_depth")).withColumn("bin", bins).select(F.col("z").alias("conv"), "bin", "top_depth", "z_depth", "z_size", "off_leaves", "off_saved")
        met = way.select("conv", "depth", "owner", F.floor(F.col("depth") / PATH_BIN).alias("bin")).join(small(asked), ["conv", "bin"])
        along = met.where((F.col("depth") >= F.col("top_depth")) & (F.col("depth") < F.col("z_depth"))).select(F.col("owner").alias("conv"), "depth", F.col("z_size").alias("less"), "off_leaves", "off_saved")
        left = told.where("not is_z and child is null").drop("z", "z_depth", "z_size", "child", "is_z").join(along, ["conv", "depth"], "left")
        plus = {"size": F.col("size") - F.coalesce("less", zero), "sum_leaves": F.col("sum_leaves") + F.coalesce("off_leaves", zero), "sum_saved": F.col("sum_saved") + F.coalesce("off_saved", zero)}
        left = left.withColumns(plus)
        fallen = told.where("child is not null").withColumns({"top": F.col("child"), "top_depth": F.col("z_depth") + 1})
        names = [c.split()[0] for c in STATE.split(", ")]
        state = materialize(left.select(*names).unionByName(fallen.select(*names)), "parts")
        hit = told.where("is_z").join(small(off.select(*TOP, "off_leaves", "off_saved")), TOP)
        done.append(hit.select("conv", "depth", (F.col("sum_leaves") + F.col("off_leaves")).alias("n_leaves"), (F.col("sum_saved") + F.col("off_saved")).alias("saved_tokens")))
    else:
        raise RuntimeError(f"components are still large after {max_rounds} rounds")
    out = _by_task(rest[0])
    for more in rest[1:]:
        out = out.unionByName(_by_task(more))
    for more in done:
        out = out.unionByName(more)
    return out


def _by_task(parts: DataFrame) -> DataFrame:
    """The totals of small components, each decomposed whole in a task."""
    names, kinds = ["conv", "depth", "n_leaves", "saved_tokens"], [pa.int64()] * 4

    def decomposed(table: pa.Table) -> pa.RecordBatch:
        a = {c: table.column(c).to_numpy() for c in table.column_names}
        sums = subtree_totals(a["parent"], a["conv"], a["depth"], a["label"], np.stack([a["leaves"], a["saved"]], 1)) + np.stack([a["sum_leaves"], a["sum_saved"]], 1)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a["conv"], a["depth"], sums[:, 0], sums[:, 1]), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tops = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in TOP], 1)
            new = np.append(last is None or bool((tops[0] != last).any()), (tops[1:] != tops[:-1]).any(1))
            labels, last = label + np.cumsum(new), tops[-1]
            label = int(labels[-1])
            table = pa.Table.from_batches([batch]).append_column("label", pa.array(labels, pa.int64())).drop_columns(TOP)
            begin = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if begin:
                yield decomposed(pa.concat_tables([*held, table.slice(0, begin)]))
                held = [table.slice(begin)]
            elif new.any() and held:
                yield decomposed(pa.concat_tables(held))
                held = [table]
            else:
                held.append(table)
        if held:
            yield decomposed(pa.concat_tables(held))

    rows = parts.select("conv", "depth", F.coalesce("parent", F.lit(0)).alias("parent"), *TOP, "leaves", "saved", "sum_leaves", "sum_saved")
    rows = rows.repartition(*TOP).sortWithinPartitions(*TOP)
    return rows.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def subtree_totals(parent: np.ndarray, conv: np.ndarray, depth: np.ndarray, label: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The totals of ``values`` (a row a node) over each node's subtree within its component ``label``, by centroid decomposition of
    all components at once. The node above (conv, depth) is (parent, depth - 1), where that is in the same component."""
    n = len(conv)
    _, name = np.unique(np.concatenate([conv, parent]), return_inverse=True)
    wide = int(depth.max()) + 2
    code, asked = name[:n] * wide + depth + 1, name[n:] * wide + depth
    order = np.argsort(code)
    at = order[np.minimum(np.searchsorted(code[order], asked), n - 1)]
    up = np.where((code[at] == asked) & (label[at] == label), at, -1)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    size, top = np.ones(n, np.int64), np.arange(n)
    for level in levels:
        inner = level[up[level] >= 0]
        top[inner] = top[up[inner]]
    for level in reversed(levels):
        inner = level[up[level] >= 0]
        np.add.at(size, up[inner], size[inner])
    out, alive = np.zeros_like(values), np.ones(n, bool)
    while alive.any():
        heavy = by_depth[(alive & (2 * size > size[top]))[by_depth]]
        centroid = np.full(n, -1)
        centroid[top[heavy]] = heavy  # the deepest of a component comes last
        z = np.unique(centroid[top[heavy]])
        is_z = np.zeros(n, bool)
        is_z[z] = True
        fallen = np.full(n, -1)
        for level in levels:
            inner = level[alive[level] & (up[level] >= 0)]
            above = up[inner]
            fallen[inner] = np.where(is_z[above], inner, fallen[above])
        off = np.zeros_like(values)
        cut = np.flatnonzero(fallen >= 0)
        np.add.at(off, centroid[top[cut]], values[cut])
        off[z] += values[z]
        out[z] += off[z]
        at, lot = up[z], z
        while True:
            on = at >= 0
            at, lot = at[on], lot[on]
            if not len(at):
                break
            size[at] -= size[lot]
            out[at] += off[lot]
            at = up[at]
        top[cut] = fallen[cut]
        up[is_z[up] & (up >= 0)] = -1
        alive[z] = False
        up[z] = -1
    return out


def ends(way: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of the nodes where conversations end: SHA-256 of their decimal ids, ascending, with commas between.

    Ids are put together to texts of at most 2 ** MEMBER_BITS ids before; a digest is one pass over a node's texts, which a task gets one after
    the other, never all at once.
    """
    last = way.where("depth = len").groupBy(F.col("owner"), "depth", F.shiftright("conv", MEMBER_BITS).alias("part")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    texts = last.select("owner", "depth", "part", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    texts = texts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (owner, depth) == key:
                    sha.update(f",{ids}".encode())
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (owner, depth), hashlib.sha256(ids.encode())
            yield _told(out)
        if key:
            yield _told([(*key, sha.hexdigest())])

    return texts.mapInArrow(tidy(run), "conv long, depth long, ends_sha256 string")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], ["conv", "depth", "ends_sha256"])


def trie(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are rows of turns and ``every`` is (conv, len) of all conversations. Equal conversations share their nodes; a conversation
    without turns ends at the root; without conversations there is no node.
    """
    way = paths(rows, every)
    nodes = forest(way)
    valued = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    totals = rollup(valued, way)
    out = nodes.join(totals, ["conv", "depth"]).join(ends(way), ["conv", "depth"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
