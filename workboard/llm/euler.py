"""List ranking and prefix sums over tables: what the Euler-tour technique needs.

:func:`list_ranks` ranks one linked list whose rows lie anywhere. A level picks
rulers by a hash (one row in eight and the end), lets every row jump by pointer
doubling until it meets a ruler, and goes on with the rulers alone; a list of at
most LAST rows is walked on the driver. A gap between rulers is short (about
``8 ln n`` rows at most), so a level takes a few joins on keys that are unique on
both sides, and all levels together move a small multiple of the list.

:func:`running` gives running totals over dense positions 1, 2, ... of a key: in
blocks of BLOCK positions, whose totals are carried on by the same rule. No group
ever holds more than BLOCK rows, however long the key's rows are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.common import drop_stored, stored

#: A list of this many rows or fewer is ranked on the driver.
LAST = 16_384
#: One row in this many is a ruler.
GAP = 8
#: Positions in a block, as a power of two.
BLOCK_BITS = 10


def _is_ruler(a: str, c: str, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col(a), F.col(c)), F.lit(GAP)) == 0


def _walked(links: DataFrame) -> DataFrame:
    """Ranks of a list of at most LAST rows."""
    rows = links.toArrow().to_pylist()
    back = {(r["ta"], r["tc"]): r for r in rows if r["ta"] is not None}
    at = next(r for r in rows if r["ta"] is None)
    out, rank = [(at["a"], at["c"], 0)], 0
    while (r := back.get((at["a"], at["c"]))) is not None:
        rank += r["dist"]
        out.append((r["a"], r["c"], rank))
        at = r
    table = pa.table({"a": [x[0] for x in out], "c": [x[1] for x in out], "rank": [x[2] for x in out]},
                     schema=pa.schema([("a", pa.int64()), ("c", pa.int64()), ("rank", pa.int64())]))
    return links.sparkSession.createDataFrame(table)


def list_ranks(links: DataFrame, last: int = LAST, level: int = 0) -> DataFrame:
    """``a, c, rank`` of a list ``a, c, ta, tc, dist`` (both longs; stored).

    ``(a, c)`` names a row, ``(ta, tc)`` the next one (null at the end, which is one
    row) and ``dist`` how far that is. ``rank`` is the distance to the end.
    """
    if links.count() <= last:
        return _walked(links)
    done = F.coalesce(_is_ruler("ta", "tc", level), F.lit(True))
    # The end is a ruler: a row that points to it is done.
    end = links.filter("ta is null").select(F.col("a").alias("ea"), F.col("c").alias("ec")).first()
    at_end = (F.col("ta") == end["ea"]) & (F.col("tc") == end["ec"])
    state = stored(links.withColumn("done", done | F.coalesce(at_end, F.lit(True))), "ranks")
    while not state.filter("not done").isEmpty():
        over = state.filter(~_is_ruler("a", "c", level)).select(
            F.col("a").alias("ta"), F.col("c").alias("tc"), F.col("ta").alias("na"), F.col("tc").alias("nc"),
            F.col("dist").alias("more"), F.col("done").alias("then"))
        moved = state.filter("not done").drop("done").join(over, ["ta", "tc"]).select(
            "a", "c", F.col("na").alias("ta"), F.col("nc").alias("tc"), (F.col("dist") + F.col("more")).alias("dist"),
            F.col("then").alias("done"))
        before, state = state, stored(state.filter("done").unionByName(moved), "ranks")
        drop_stored(before)
    rulers = state.filter(_is_ruler("a", "c", level) | F.col("ta").isNull()).drop("done")
    above = list_ranks(stored(rulers, "rulers"), last, level + 1).select(F.col("a").alias("ta"), F.col("c").alias("tc"), "rank")
    near = (state.filter("ta is not null").join(above, ["ta", "tc"])
            .select("a", "c", (F.col("rank") + F.col("dist")).alias("rank")))
    out = stored(near.unionByName(state.filter("ta is null").select("a", "c", F.lit(0).cast("long").alias("rank"))), "ranked")
    drop_stored(state)
    return out


def running(df: DataFrame, keys: list[str], pos: str, sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """``df`` (stored) with ``run_<column>``: the sum or bitwise XOR of a column over positions 1 to the row's own."""
    def own(name: str) -> Column:
        return F.sum(name) if name in sums else F.bit_xor(name)

    columns = [*sums, *xors]
    block = F.shiftright(F.col(pos) - 1, BLOCK_BITS)
    window = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_block", block).withColumns({f"run_{c}": own(c).over(window) for c in columns})
    if (df.agg(F.max(pos)).first()[0] or 0) <= 1 << BLOCK_BITS:
        return local.drop("_block")
    totals = stored(df.groupBy(*keys, (block + 1).alias("_place")).agg(*[own(c).alias(c) for c in columns]), "totals")
    # A block's inclusive total goes into the next block, whose number (from 0) is its place (from 1).
    carried = running(totals, keys, "_place", sums, xors).select(
        *keys, F.col("_place").alias("_block"), *[F.col(f"run_{c}").alias(f"_in_{c}") for c in columns])
    add = {f"run_{c}": (F.col(f"run_{c}") + F.coalesce(f"_in_{c}", F.lit(0)) if c in sums
                        else F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"_in_{c}", F.lit(0)))) for c in columns}
    return local.join(carried, [*keys, "_block"], "left").withColumns(add).drop("_block", *[f"_in_{c}" for c in columns])
