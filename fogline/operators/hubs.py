"""Reach from many nodes by way of hubs: what lies ahead of a hub is found once in each world, not again from each start.

In a world, all that reach a hub reach whatever the hub does. So a start that lies behind the hub of a world needs a search of its own only
among nodes that don't lie ahead of it, and one that doesn't lie behind it only among nodes that don't either; both are few where most
nodes reach each other. Worlds without a hub are searched from each start. Any choice of hubs gives the same reach.

A world's hub is, of some nodes of many edges, the one that has most edges there both out and in. One search ahead of the hubs of all worlds
and one behind them go over masks side by side (``wide``); what is left to each start is little and goes by ``reach``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.coins import CHUNK
from fogline.functions.runtime import BROADCAST_ROWS, Buckets, materialize, small
from fogline.operators.reach import reach
from fogline.operators.wide import every, lay_wide, names, narrow, none, wide_buckets, wide_reach, widened, without

#: Nodes that are tried as hubs.
HUBS = 16
#: Starts of a block that nodes are paired with.
BLOCK_STARTS = 1000


class Shared(NamedTuple):
    """``behind`` (keys, m0, m1 and so on): the worlds in which a start lies behind the world's hub; ``ahead`` (node, m0, m1 and so on): those
    in which a node lies ahead of it; ``rest`` (keys, chunk, node, mask): what each start reaches else, in further worlds only."""

    behind: DataFrame
    ahead: DataFrame
    rest: DataFrame


def _bit(mask: str = "mask") -> Column:
    return F.call_function("shiftright", F.col(mask), F.col("i")).bitwiseAND(F.lit(1).cast("long"))


def _each_world(masks: DataFrame) -> DataFrame:
    """``masks`` (chunk and more, mask) with a row for each bit i of a mask that is set."""
    return masks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1)))).where(_bit() != 0)


def _hubs(laid: dict[bool, Buckets], worlds: int, n: int) -> DataFrame:
    """(node, m0, m1 and so on): the worlds whose hub a node is, of the ``n`` nodes that have most edges over all worlds both out and in."""
    ms = names(worlds)
    bits = F.sum(sum((F.bit_count(m).cast("long") for m in ms), none()))
    out, into = (laid[way].rows.groupBy("node").agg(bits.alias(name)) for way, name in ((False, "out"), (True, "into")))
    tried = [r["node"] for r in out.join(into, "node").orderBy(F.least("out", "into").desc(), "node").limit(n).collect()]
    met = [_each_world(narrow(laid[way].rows.where(F.col("node").isin(tried)).select("node", *ms), ms)).groupBy("node", "chunk", "i").agg(F.count("*").alias(name)) for way, name in ((False, "out"), (True, "into"))]
    best = met[0].join(met[1], ["node", "chunk", "i"]).groupBy("chunk", "i").agg(F.min_by("node", F.struct(-F.least("out", "into"), "node")).alias("node"))
    return widened(best.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))), ["node"], worlds, "mask")


def shared_reach(masks: DataFrame, begin: DataFrame, keys: Sequence[str], worlds: int, hubs: int = HUBS, arcs: int | None = None) -> Shared:
    """Reach from the start rows ``begin`` (keys, node) in all worlds, over all colors.

    ``masks`` are those of ``wide_masks`` or of ``edge_masks``; ``arcs`` is about how many rows they have, if known, else they are counted.
    Edges are laid out once each way.
    """
    keys, spark, ms = list(keys), masks.sparkSession, names(worlds)
    if "em" in masks.columns:
        masks = materialize(widened(masks, ["src", "dst"], worlds, "em"), "wide-masks")
    buckets = wide_buckets(spark, masks.count() if arcs is None else arcs)
    laid = {False: lay_wide(masks.select(F.col("src").alias("node"), F.col("dst").alias("next"), *ms), buckets)}
    laid[True] = lay_wide(laid[False].rows.select(F.col("next").alias("node"), F.col("node").alias("next"), *ms), buckets)
    begun = materialize(_hubs(laid, worlds, hubs), "hubs")
    ahead, behind = (wide_reach(laid[way], begun, worlds) for way in (False, True))

    back, to = names(worlds, "b"), names(worlds, "a")
    of_ahead, of_behind = ahead.select("node", *[F.col(m).alias(a) for m, a in zip(ms, to, strict=True)]), behind.select("node", *[F.col(m).alias(b) for m, b in zip(ms, back, strict=True)])
    begun = materialize(begin.select(*keys, "node").join(of_behind, "node", "left").join(of_ahead, "node", "left"), "begun")
    hubbed = materialize(begun.groupBy(*keys).agg(*[F.coalesce(F.bit_or(b), none()).alias(m) for b, m in zip(back, ms, strict=True)]), "hubbed")
    begun = begun.select(*keys, "node", *to).join(hubbed, keys)
    by_hub = [without(m, a).alias(m) for m, a in zip(ms, to, strict=True)]
    alone = [without(whole, m).alias(m) for whole, m in zip(every(worlds), ms, strict=True)]
    kinds = [narrow(begun.select(F.lit(kind).alias("kind"), *keys, "node", *own), ms) for kind, own in ((0, by_hub), (1, alone))]
    # nodes that lie ahead are left out for starts behind a hub; nodes that lie behind for the others, which can't reach them
    into = laid[True].rows.join(of_ahead.hint("shuffle_hash"), "node", "left").select(F.lit(0).alias("kind"), F.col("next").alias("src"), F.col("node").alias("dst"), *by_hub)
    out = laid[False].rows.join(of_behind.hint("shuffle_hash"), "node", "left").select(F.lit(1).alias("kind"), F.col("node").alias("src"), F.col("next").alias("dst"), *[without(m, b).alias(m) for m, b in zip(ms, back, strict=True)])
    own = narrow(into, ms, "em").unionByName(narrow(out, ms, "em")).groupBy("kind", "chunk", "src", "dst").agg(F.bit_or("em").alias("em"))
    own = materialize(own.select("kind", "chunk", "src", "dst", F.lit(0).cast("long").alias("color"), "em"), "own-masks")
    for lie in laid.values():
        lie.forget()
    rest = reach(own, kinds[0].unionByName(kinds[1]), ["kind", *keys], edge_keys=["kind"])
    return Shared(hubbed, ahead, rest.select(*keys, "chunk", "node", "mask"))


def pair_hits(shared: Shared, keys: Sequence[str], worlds: int) -> DataFrame:
    """(keys, node, hits): in how many worlds each node is reached, where it is in any.

    There is a row for nearly each start and node, so these rows are made where the nodes lie and not shuffled; only what is reached
    without a hub is. Nodes meet starts by blocks of these.
    """
    keys, ms, back = list(keys), names(worlds), names(worlds, "b")
    ahead, n = shared.ahead, shared.behind.count()
    behind = materialize(shared.behind.select(*keys, *[F.col(m).alias(b) for m, b in zip(ms, back, strict=True)]), "behind")
    block = F.pmod(F.xxhash64(*keys), F.lit(-(-max(1, n) // BLOCK_STARTS)))
    blocks = materialize(behind.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*keys, *back)).alias("starts")), "starts").select("starts")
    blocks = F.broadcast(blocks) if n <= BROADCAST_ROWS else blocks
    extra = materialize(shared.rest.groupBy(*keys, "node").agg(F.sum(F.bit_count("mask")).cast("long").alias("extra")), "extra")
    start = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    seen = extra.groupBy("node").agg(F.collect_list(start).alias("seen"))
    met = ahead.join(seen, "node", "left").crossJoin(blocks).select("node", "seen", *ms, F.inline("starts")).where(F.col("seen").isNull() | ~F.array_contains("seen", start))
    far = met.select(*keys, "node", sum((F.bit_count(F.col(m).bitwiseAND(F.col(b))).cast("long") for m, b in zip(ms, back, strict=True)), none()).alias("hits")).where("hits > 0")
    common = sum((F.bit_count(F.coalesce(m, none()).bitwiseAND(F.coalesce(b, none()))).cast("long") for m, b in zip(ms, back, strict=True)), none())
    near = extra.join(small(behind), keys, "left").join(ahead, "node", "left")
    return far.unionByName(near.select(*keys, "node", (common + F.col("extra")).alias("hits")))


def spread_of_starts(shared: Shared, keys: Sequence[str]) -> DataFrame:
    """(keys, hits): nodes reached, starts among them, summed over the worlds. What lies ahead of hubs is counted once a world."""
    ms = [c for c in shared.ahead.columns if c != "node"]
    sizes = materialize(_each_world(narrow(shared.ahead, ms)).groupBy("chunk", "i").agg(F.count("*").alias("n")), "sizes")
    far = narrow(shared.behind, ms).join(F.broadcast(sizes), "chunk").where(_bit() != 0).select(*keys, F.col("n").alias("hits"))  # a row for each world
    near = shared.rest.select(*keys, F.bit_count("mask").cast("long").alias("hits"))
    return far.unionByName(near).groupBy(*keys).agg(F.sum("hits").alias("hits"))
