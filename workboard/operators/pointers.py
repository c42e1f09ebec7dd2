"""Pointer jumping: where chains of rows that wait for one another end.

Each row names one other row (or one that waits for nothing). Every pass replaces
a row's pointer by the pointer of the row it points to, so a chain of n rows takes
about log2(n) joins on keys that are unique on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.session import stage


def follow(links: DataFrame) -> DataFrame:
    """``seq, to, odd, sure`` (stored): the end of each chain of ``links``.

    ``links`` has the same columns: ``seq`` unique, ``to`` another ``seq`` or one that
    is no row of ``links``, without cycles. ``odd`` (a boolean) of a chain is true if
    that of an odd number of its links is; ``sure`` if that of all its links is.
    """
    now = stage(links.select("seq", "to", "odd", "sure", F.lit(True).alias("moved")), "links")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("seq").alias("to"), F.col("to").alias("__next"), F.col("odd").alias("__odd"),
                        F.col("sure").alias("__sure"))
        now = stage(now.join(on, "to", "left").select(
            "seq", F.coalesce("__next", "to").alias("to"),
            (F.col("odd") != F.coalesce("__odd", F.lit(False))).alias("odd"),
            (F.col("sure") & F.coalesce("__sure", F.lit(True))).alias("sure"),
            F.col("__next").isNotNull().alias("moved")), "links")
    return now.drop("moved")
