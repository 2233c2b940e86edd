"""Probabilities and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chance(columns: list[str]) -> Column:
    """The probability of an edge: p where there is one, else whole percent p_pct."""
    return F.col("p").cast("double") if "p" in columns else F.col("p_pct").cast("double") / 100.0


def cost(p: Column) -> Column:
    """-ln(p) in whole thousandths, for a probability."""
    return F.floor(-F.log(F.least(p, F.lit(1.0))) * 1000.0).cast("long")


def rounded_down(p: Column, steps: int = 10) -> Column:
    """A probability rounded down to a multiple of 1 / steps."""
    return F.floor(F.round(p * steps, 9)) / F.lit(float(steps))


def miss_pct(p_pct: Column) -> Column:
    """Of a group of edges, the product of 100 - p_pct as a double: the chance that none exists, times 100 to the number of edges.

    Exact up to 2^53, that is, for 7 edges; multiplied in ascending order, so that it is the same each time.
    """
    return F.aggregate(F.array_sort(F.collect_list(100 - p_pct)), F.lit(1.0), lambda a, x: a * x)
