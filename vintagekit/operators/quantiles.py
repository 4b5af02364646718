"""Exact quantiles of a whole column without a task that holds it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
SMALL = 10_000


def exact_quantile(df: DataFrame, col: str, q: float, bins: int = BINS, small: int = SMALL) -> float | None:
    """Linear quantile of a numeric column; nulls and NaN are left out, none left gives null.

    Passes of counts by `bins` equal steps narrow the values to those around the wanted ranks, until at
    most `small` rows are left, which are sorted. Only counts and those rows reach the driver. Values
    that are far apart take more passes, never more memory.
    """
    v = F.col(col).cast("double")
    rows = df.select(v.alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    n, low, high = rows.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    if not n:
        return None
    at = q * (n - 1)
    first, last, below, inside = math.floor(at), math.ceil(at), 0, n
    while inside > small and low < high:
        step = F.least(F.floor((F.col("_v") / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1))
        held = sorted(rows.filter(F.col("_v").between(low, high)).groupBy(step.alias("_bin")).agg(
            F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect())
        ends, total = [], below
        for r in held:
            total += r["n"]
            ends.append(total)
        i = next(j for j, e in enumerate(ends) if e > first)
        j = next(j for j, e in enumerate(ends) if e > last)
        below = ends[i] - held[i]["n"]
        narrower = ends[j] - below
        low, high = held[i]["low"], held[j]["high"]
        if narrower == inside:
            break  # neighbours too close together to part: equal values, or two runs of them
        inside = narrower
    if low == high:
        return low
    # Equal values are one row here, so what is left is small even if a value stands many times.
    counts = sorted(rows.filter(F.col("_v").between(low, high)).groupBy("_v").count().collect())
    picked = []
    for rank in (first, last):
        total = below
        for r in counts:
            total += r["count"]
            if total > rank:
                picked.append(r["_v"])
                break
    return picked[0] + (picked[1] - picked[0]) * (at - first)
