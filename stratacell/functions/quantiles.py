"""Exact quantiles of columns of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values that one aggregate may hold; beyond that quantiles are bracketed first.
MOST_DISTINCT = 1_000_000
#: Rank error of the brackets, as one part in so many.
ACCURACY = 10_000


def exact_quantiles(values: DataFrame, ps: Sequence[float], most_distinct: int = MOST_DISTINCT) -> list[float] | None:
    """The quantiles ``ps`` of the one column of ``values``, linearly interpolated; none of no values. Where there are many
    distinct values, approximate quantiles give a narrow bracket for each, and only the values within are gathered."""
    v = values.toDF("v").where("v is not null").select(F.col("v").cast("double").alias("v"))
    sides = [min(1.0, max(0.0, p + d)) for p in ps for d in (-2 / ACCURACY, 2 / ACCURACY)]
    n, distinct, ends = v.agg(F.count("*"), F.approx_count_distinct("v"), F.percentile_approx("v", [float(x) for x in sides], ACCURACY)).first()
    if not n:
        return None
    if distinct <= most_distinct:
        return list(v.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in ps]))).first()[0])
    out = []
    for p, low, high in zip(ps, ends[::2], ends[1::2], strict=True):
        at = p * (n - 1)
        need = (int(at), min(int(at) + 1, n - 1))
        while True:
            below = v.where(F.col("v") < low).count()
            inside = v.where(F.col("v").between(low, high)).groupBy("v").count().orderBy("v").collect()  # a few parts in ACCURACY of all
            if below <= need[0] and need[1] < below + sum(r["count"] for r in inside):
                break
            low, high = v.agg(F.max(F.when(F.col("v") < low, F.col("v"))), F.min(F.when(F.col("v") > high, F.col("v")))).first()  # a value more on either side
            low, high = (inside[0]["v"] if low is None else low), (inside[-1]["v"] if high is None else high)
        rank, found = below, []
        for r in inside:
            found += [r["v"] for k in need if rank <= k < rank + r["count"]]
            rank += r["count"]
        out.append(found[0] + (found[-1] - found[0]) * (at - int(at)))
    return out
