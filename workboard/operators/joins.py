"""Row-level lookups from a large table to a dimension with a unique key.

Hot keys are left to adaptive execution: both sides of the join are plain
shuffles, so a partition that one key fills is split at run time, without a
pass over the data to count keys. Only NULL keys (an unassigned task) are
spread here: they never match, but would all hash to one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: NULL keys spread over this many stand-in values.
SPREAD = 1 << 20


def lookup_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str,
                row_id: str) -> DataFrame:
    """``fact JOIN dim ON fact_key = dim_key`` (``how`` inner or left).

    A NULL key is replaced by a value made from ``row_id`` for the shuffle
    only; the condition still asks for a key, so a stand-in matches nothing.
    """
    if how == "inner":
        return fact.join(dim, fact[fact_key] == dim[dim_key], "inner")
    if how != "left":
        raise ValueError(how)
    key = fact[fact_key]
    stand_in = F.coalesce(key, -1 - F.pmod(F.xxhash64(fact[row_id]), F.lit(SPREAD)))
    return fact.join(dim, (stand_in == dim[dim_key]) & key.isNotNull(), "left")
