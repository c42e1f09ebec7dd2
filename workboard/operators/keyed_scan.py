"""Skew-safe ordered scans within key groups.

``ROW_NUMBER() OVER (PARTITION BY k ORDER BY o)`` and "last non-NULL value so
far" are plain window functions in Spark, but a window puts each key group in
one task: if one key holds a third of all rows, one task sorts and buffers a
third of the data. This operator cuts large groups into slices instead:

1. Groups are counted (a partial aggregate over key and order columns alone).
   Without a group above the slice size the plan is the plain window.
2. A larger group is cut at the quantiles of its first order column that is not
   constant (``percentile_approx``: a mergeable summary of fixed size, combined
   on the map side). The cuts are stored, so they are the same for every reader.
   Slices that are still too large, by ties or by number, are cut again, by the
   next column where the first is constant.
3. Every row learns its slice from the stored cuts (broadcast: at most one row per
   shuffle partition and pass) and the window runs per ``(key, slice)``: one
   shuffle of the data, no range sampling, no copy of the rows in storage.
4. Per slice of a cut group the row count and the last values are aggregated and
   scanned in slice order; what comes from the slices before is joined back.

``order`` must be a total order within each key (append a unique column) so that
results are deterministic under task retries. Order columns are names, or
``(name, "desc")``; NULL is smallest. Orders over other types than numbers and
times (or given as Column expressions) take the older way, ``_ranged_scan``: a
range partitioning whose locally numbered frame is stored once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.session import stage

_PID, _LRN, _KEY = "__ks_pid", "__ks_lrn", "__ks_key"
_SLICE, _CUTS = "__ks_slice", 64
#: Rows of a slice, about; more only where the shuffle has fewer partitions than slices.
SLICE_ROWS = 100_000

OrderCol = Column | str | tuple[str, str]


def _falls(o: OrderCol) -> bool:
    return isinstance(o, tuple) and o[1] == "desc"


def _order_cols(order: Sequence[OrderCol]) -> list[Column]:
    return [o if isinstance(o, Column) else F.col(o) if isinstance(o, str)
            else F.col(o[0]).desc_nulls_last() if _falls(o) else F.col(o[0]) for o in order]


def _parallelism(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _images(df: DataFrame, order: Sequence[OrderCol]) -> list[Column] | None:
    """Order columns as long integers that sort alike; None if one has no such image."""
    out = []
    for o in order:
        if isinstance(o, Column):
            return None
        name = o if isinstance(o, str) else o[0]
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.TimestampNTZType):
            image = F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.TimestampType):
            image = F.unix_micros(c)
        elif isinstance(kind, T.DateType):
            image = F.unix_date(c).cast("long")
        elif isinstance(kind, T.IntegralType):
            image = c.cast("long")
        else:
            return None
        image = F.coalesce(image, F.lit(-(1 << 63)))
        out.append(image.bitwiseXOR(F.lit(-1).cast("long")) if _falls(o) else image)
    return out


def _same(keys: Sequence[str], names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])


def _sliced(df: DataFrame, keys: list[str], images: list[str], cuts: list[DataFrame]) -> DataFrame:
    """``df`` with the slice of each row; rows of groups that were not cut are in slice 0."""
    df = df.withColumn(_SLICE, F.lit(0).cast("long"))
    names = [f"__ks_ck_{i}" for i in range(len(keys) + 1)]
    for cut in cuts:
        named = cut.select(*[F.col(k).alias(n) for k, n in zip([*keys, _SLICE], names)], "__ks_at", "__ks_bounds")
        value = F.element_at(F.array(*images), F.col("__ks_at"))
        below = F.size(F.filter("__ks_bounds", lambda b: b < value))
        df = (df.join(F.broadcast(named), _same([*keys, _SLICE], names), "left")
              .withColumn(_SLICE, F.col(_SLICE) * _CUTS + F.coalesce(F.when(F.col("__ks_bounds").isNotNull(), below), F.lit(0)))
              .drop(*names, "__ks_at", "__ks_bounds"))
    return df


def _cut(narrow: DataFrame, keys: list[str], images: list[str], partitions: int, slice_rows: int) -> list[DataFrame]:
    """Stored cuts of the groups with too many rows, pass by pass; empty if there are none."""
    cuts: list[DataFrame] = []
    most = None
    while True:
        rows = _sliced(narrow, keys, images, cuts)
        # The first image that is not constant; 0 if all are.
        spread = [F.when(F.min(c) < F.max(c), F.lit(i)) for i, c in enumerate(images, 1)]
        sizes = rows.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("n"), F.coalesce(*spread, F.lit(0)).alias("__ks_at"))
        if most is None:
            total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
            most = max(slice_rows, -(-(total or 0) // partitions))
            if (largest or 0) <= most:
                return cuts
        large = sizes.where((F.col("n") > most) & (F.col("__ks_at") > 0)).drop("n")
        large = stage(large, "large-groups")
        if large.isEmpty():
            return cuts
        names = [f"__ks_lk_{i}" for i in range(len(keys) + 1)]
        named = large.select(*[F.col(k).alias(n) for k, n in zip([*keys, _SLICE], names)], "__ks_at")
        inside = rows.join(F.broadcast(named), _same([*keys, _SLICE], names)).drop(*names)
        shares = [i / _CUTS for i in range(1, _CUTS)]
        bounds = F.percentile_approx(F.element_at(F.array(*images), F.col("__ks_at")), F.lit(shares), F.lit(2000))
        # A value below the largest is always among the cuts, so that a pass makes progress.
        least = F.min(F.element_at(F.array(*images), F.col("__ks_at")))
        cuts.append(stage(inside.groupBy(*keys, _SLICE, "__ks_at").agg(
            F.slice(F.array_union(F.array(least), bounds), 1, _CUTS - 1).alias("__ks_bounds")), "cuts"))


def keyed_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[OrderCol],
    *,
    row_number: str | None = None,
    carry: Mapping[str, str] | None = None,
    carry_before: Mapping[str, str] | None = None,
    num_partitions: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``row_number`` (1-based position within the key group in ``order``);
    for each ``out -> src`` in ``carry`` the last non-NULL value of ``src`` up
    to and including the row; for each ``out -> src`` in ``carry_before`` the
    same strictly before the row. ``keys=[]`` scans the whole frame as one
    group (dense global numbering)."""
    images = _images(df, order)
    if images is None:
        return _ranged_scan(df, keys, order, row_number=row_number, carry=carry, carry_before=carry_before,
                            num_partitions=num_partitions)
    carry, carry_before = dict(carry or {}), dict(carry_before or {})
    sources = sorted(set(carry.values()) | set(carry_before.values()))
    keys = list(keys)
    work = df
    if not keys:
        work, keys = work.withColumn(_KEY, F.lit(0)), [_KEY]
    image_names = [f"__ks_i{i}" for i in range(len(images))]
    work = work.withColumns(dict(zip(image_names, images)))
    cuts = _cut(work.select(*keys, *image_names), keys, image_names, _parallelism(df, num_partitions), slice_rows)
    rows = _sliced(work, keys, image_names, cuts)
    ordered = Window.partitionBy(*keys, _SLICE).orderBy(*_order_cols(order))
    upto, before = (ordered.rowsBetween(Window.unboundedPreceding, last) for last in (Window.currentRow, -1))
    if not cuts:
        rows = rows.withColumns({
            **({row_number: F.row_number().over(ordered).cast("long")} if row_number else {}),
            **{out: F.last(src, ignorenulls=True).over(upto) for out, src in carry.items()},
            **{out: F.last(src, ignorenulls=True).over(before) for out, src in carry_before.items()}})
        return rows.drop(_KEY, _SLICE, *image_names)
    # What each slice of a cut group hands on: its row count and its last values.
    names = [f"__ks_sk_{i}" for i in range(len(keys) + 1)]
    whole = cuts[0].select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    place = F.struct(*image_names)
    states = (_sliced(work, keys, image_names, cuts).join(F.broadcast(whole), _same(keys, names), "left_semi")
              .groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("n"),
                                          *[F.max_by(s, F.when(F.col(s).isNotNull(), place)).alias(f"__ks_l{i}")
                                            for i, s in enumerate(sources)]))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    handed = stage(states.select(
        *[F.col(k).alias(n) for k, n in zip([*keys, _SLICE], names)], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__ks_off"),
        *[F.last(f"__ks_l{i}", ignorenulls=True).over(earlier).alias(f"__ks_in{i}") for i in range(len(sources))]), "handed-on")
    rows = rows.withColumns({
        _LRN: F.row_number().over(ordered),
        **{f"__ks_u{i}": F.last(s, ignorenulls=True).over(upto) for i, s in enumerate(sources)},
        **{f"__ks_b{i}": F.last(s, ignorenulls=True).over(before) for i, s in enumerate(sources)}})
    rows = rows.join(F.broadcast(handed), _same([*keys, _SLICE], names), "left")
    if row_number:
        rows = rows.withColumn(row_number, (F.col(_LRN) + F.coalesce("__ks_off", F.lit(0))).cast("long"))
    at = {s: i for i, s in enumerate(sources)}
    for prefix, wanted in (("u", carry), ("b", carry_before)):
        for out, src in wanted.items():
            rows = rows.withColumn(out, F.coalesce(F.col(f"__ks_{prefix}{at[src]}"), F.col(f"__ks_in{at[src]}")))
    outputs = {row_number, *carry, *carry_before}
    return rows.drop(*[c for c in rows.columns if c.startswith("__ks_") and c not in outputs])


def _ranged_scan(df: DataFrame, keys: Sequence[str], order: Sequence[OrderCol], *, row_number: str | None,
                 carry: Mapping[str, str] | None, carry_before: Mapping[str, str] | None,
                 num_partitions: int | None) -> DataFrame:
    """The same by range partitions on ``(k, o)``, for orders without an integer
    image. Each partition holds a contiguous part of the global order and is
    scanned on its own; a summary of one row per partition carries on what the
    first key of a partition continues. The locally numbered frame is stored, as
    two reads of a plan would sample their own range bounds."""
    carry = dict(carry or {})
    carry_before = dict(carry_before or {})
    sources = sorted(set(carry.values()) | set(carry_before.values()))
    src_idx = {src: i for i, src in enumerate(sources)}
    keys = list(keys)
    order_cols = _order_cols(order)
    n = _parallelism(df, num_partitions)

    work = df
    key_names = keys
    if not keys:
        work = work.withColumn(_KEY, F.lit(0))
        key_names = [_KEY]

    ranged = (work.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in key_names],
                                      *order_cols)
              .withColumn(_PID, F.spark_partition_id()))
    w = Window.partitionBy(_PID, *key_names).orderBy(*order_cols)
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn(_LRN, F.row_number().over(w))
    w_prev = w.rowsBetween(Window.unboundedPreceding, -1)
    run_cols = {src: f"__ks_run_{i}" for src, i in src_idx.items()}
    for src, col in run_cols.items():
        local = local.withColumn(col, F.last(src, ignorenulls=True).over(w_run))
    for out, src in carry_before.items():
        local = local.withColumn(f"__ks_prev_{out}", F.last(src, ignorenulls=True).over(w_prev))
    local = stage(local, "keyed-scan")

    # One row per non-empty range partition.
    kstruct = F.struct(*[F.col(k) for k in key_names])
    state = F.struct(F.col(_LRN).alias("cnt"),
                     *[F.col(c).alias(f"s{src_idx[src]}") for src, c in run_cols.items()])
    summary = local.groupBy(_PID).agg(
        F.min(kstruct).alias("first"),
        F.max(kstruct).alias("last"),
        F.max_by(state, F.struct(kstruct, F.col(_LRN))).alias("st"),
    )
    # Scan the summary: partitions ending in the same key are contiguous.
    w_last = (Window.partitionBy("last").orderBy(_PID)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summary = summary.withColumn("cum", F.sum("st.cnt").over(w_last))
    for i in src_idx.values():
        summary = summary.withColumn(f"cy_{i}", F.last(f"st.s{i}", ignorenulls=True).over(w_last))
    # Single-partition window over the summary only: its size is the number of
    # range partitions, independent of data volume.
    w_pid = Window.orderBy(_PID)
    connected = F.coalesce(F.lag("last").over(w_pid) == F.col("first"), F.lit(False))
    offsets = summary.select(
        F.col(_PID).alias("__ks_opid"),
        *[F.col("first").getField(k).alias(f"__ks_ok_{i}") for i, k in enumerate(key_names)],
        F.when(connected, F.lag("cum").over(w_pid)).otherwise(F.lit(0)).alias("__ks_off"),
        *[F.when(connected, F.lag(f"cy_{i}").over(w_pid)).alias(f"__ks_in_{i}")
          for i in src_idx.values()],
    )
    cond = F.col(_PID) == F.col("__ks_opid")
    for i, k in enumerate(key_names):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__ks_ok_{i}"))
    joined = local.join(F.broadcast(offsets), cond, "left")

    if row_number:
        joined = joined.withColumn(
            row_number, (F.col(_LRN) + F.coalesce(F.col("__ks_off"), F.lit(0))).cast("long"))
    for out, src in carry.items():
        joined = joined.withColumn(
            out, F.coalesce(F.col(run_cols[src]), F.col(f"__ks_in_{src_idx[src]}")))
    for out, src in carry_before.items():
        joined = joined.withColumn(
            out, F.coalesce(F.col(f"__ks_prev_{out}"), F.col(f"__ks_in_{src_idx[src]}")))
    outputs = {row_number, *carry, *carry_before}
    helper = [c for c in joined.columns if c.startswith("__ks_") and c not in outputs]
    return joined.drop(*helper)


def keyed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[OrderCol],
                     out: str, num_partitions: int | None = None) -> DataFrame:
    return keyed_scan(df, keys, order, row_number=out, num_partitions=num_partitions)


def assign_ids(df: DataFrame, order: Sequence[OrderCol], start: Column, out: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """Dense identity values ``start + 1, start + 2, ...`` in ``order`` without a
    single-partition sort (``start`` is typically a scalar subquery of max id)."""
    numbered = keyed_scan(df, [], order, row_number="__ids_rn", num_partitions=num_partitions)
    return numbered.withColumn(out, (start + F.col("__ids_rn")).cast("long")).drop("__ids_rn")
