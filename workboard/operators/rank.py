"""Global ``RANK()`` without a single-partition exchange of all rows.

``rank() OVER (ORDER BY c DESC)`` with no PARTITION BY makes Spark move every
row to one task. For a count column the rank only depends on how many rows have
a strictly larger count, so it is computed on the histogram of distinct counts:

    rank(c) = 1 + number of rows whose count is greater than c

Size bound of the histogram: k distinct non-negative integer counts whose rows
together account for at most T items satisfy 0 + 1 + ... + (k - 1) <= T, so
k <= 1/2 + sqrt(2T + 1/4). For T = 10^11 items that is under 450,000 rows, so
broadcasting it is safe at any data size. Only use this for count columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_rank(df: DataFrame, count_col: str, out: str = "rank",
               descending: bool = True) -> DataFrame:
    hist = df.groupBy(count_col).agg(F.count(F.lit(1)).alias("__rk_n"))
    order = F.col(count_col).desc() if descending else F.col(count_col).asc()
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.select(
        F.col(count_col).alias("__rk_v"),
        (F.lit(1) + F.coalesce(F.sum("__rk_n").over(ahead), F.lit(0))).cast("long").alias(out),
    )
    joined = df.join(F.broadcast(ranks), F.col(count_col).eqNullSafe(F.col("__rk_v")), "inner")
    return joined.drop("__rk_v")
