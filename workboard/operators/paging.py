"""Offset paging (``Skip((p-1)*n).Take(n)``) and page facts.

``orderBy(...).offset().limit()`` plans as ``TakeOrderedAndProject`` with an
offset: every task keeps its own top ``p*n`` rows and only those reach the
final merge, so a shallow page never sorts the table. Deep pages cost
O(offset); ``keyset_page`` is the constant-cost alternative.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.operators.keyed_scan import (_KEY, _SLICE, SLICE_ROWS, OrderCol, _cut, _falls, _images, _order_cols,
                                            _parallelism, _sliced)
from workboard.session import stage


def _check(page: int, size: int) -> None:
    if page < 1 or size < 1:
        raise ValueError(f"page and page size must be >= 1 (got {page}, {size})")


def page(df: DataFrame, order: Sequence[Column], page_number: int, page_size: int) -> DataFrame:
    _check(page_number, page_size)
    return df.orderBy(*order).offset((page_number - 1) * page_size).limit(page_size)


def keyset_page(df: DataFrame, key_cols: Sequence[str], after: Sequence | None, page_size: int,
                descending: bool = True) -> DataFrame:
    """Rows strictly after ``after`` (a tuple of key values) in key order."""
    _check(1, page_size)
    keys = F.struct(*[F.col(k) for k in key_cols])
    if after is not None:
        # Same field names and types as the key struct; datetimes go through
        # text so that no zone conversion applies.
        bound = F.struct(*[
            F.lit(v.isoformat(sep=" ") if isinstance(v, datetime) else v)
            .cast(df.schema[k].dataType).alias(k) for k, v in zip(key_cols, after)])
        df = df.where(keys < bound if descending else keys > bound)
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in key_cols]
    return df.orderBy(*order).limit(page_size)


def page_info(df: DataFrame, page_number: int, page_size: int) -> DataFrame:
    """One row: total_count, page_number, page_size, total_pages (ceil),
    has_previous, has_next. A global count: partial counts per task, one final
    row."""
    _check(page_number, page_size)
    total = F.count(F.lit(1)).cast("long")
    one = df.agg(total.alias("total_count"))
    pages = F.ceil(F.col("total_count") / F.lit(page_size)).cast("long")
    return one.select(
        "total_count",
        F.lit(page_number).cast("long").alias("page_number"),
        F.lit(page_size).cast("long").alias("page_size"),
        pages.alias("total_pages"),
        F.lit(page_number > 1).alias("has_previous"),
        (F.lit(page_number) < pages).alias("has_next"),
    )


# ------------------------------------------------------------ anchored pages
def page_anchors(df: DataFrame, order: Sequence[OrderCol], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A small stored table by which any page is read from one key range.

    The rows are cut into slices of about ``slice_rows`` at quantiles of the order
    columns (as ``keyed_scan`` cuts a large group). An anchor is the first key of a
    slice, as integer images, and the number of rows before it: one row per slice.
    ``order`` ends in a unique column; numbers and times only."""
    images = _images(df, order)
    if images is None:
        raise TypeError("anchors need an order over numbers or times, by column names")
    names = _image_names(order)
    rows = df.select(F.lit(0).alias(_KEY), *[i.alias(n) for i, n in zip(images, names)])
    cuts = _cut(rows, [_KEY], names, _parallelism(df, None), slice_rows)
    sizes = (_sliced(rows, [_KEY], names, cuts).groupBy(_SLICE)
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*names)).alias("first")))
    # One row per slice: the window is over their summary, not over the data.
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return stage(sizes.select("first.*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "page-anchors")


def anchored_page(df: DataFrame, order: Sequence[OrderCol], anchors: DataFrame, page_number: int, page_size: int) -> DataFrame:
    """Page ``page_number`` of ``df`` in ``order``: only the key range between two
    anchors of the same rows is read and sorted, however deep the page is."""
    _check(page_number, page_size)
    start = (page_number - 1) * page_size
    names = _image_names(order)
    key = F.struct("offset", *names)
    at = anchors.where(F.col("offset") <= start).agg(F.max(key).alias("k")).first()["k"]
    if at is None:
        return df.limit(0)
    end = anchors.where(F.col("offset") >= start + page_size).agg(F.min(key).alias("k")).first()["k"]

    def place(row) -> Column:
        return F.struct(*[F.lit(row[n]).cast("long").alias(n) for n in names])

    own = F.struct(*[i.alias(n) for i, n in zip(_images(df, order), names)])
    rows = df.where(own >= place(at))
    if end is not None:
        rows = rows.where(own < place(end))
    rows = _in_range(rows, order[0], at[names[0]], None if end is None else end[names[0]])
    return rows.orderBy(*_order_cols(order)).offset(start - at["offset"]).limit(page_size)


def _image_names(order: Sequence[OrderCol]) -> list[str]:
    return [f"__pg_{i}" for i in range(len(order))]


def _in_range(df: DataFrame, order: OrderCol, first: int, last: int | None) -> DataFrame:
    """A plain filter on the first order column, which reaches the scan; none where NULL is in the range."""
    null, falls = -(1 << 63), _falls(order)
    name = order[0] if isinstance(order, tuple) else order
    values = [None if v is None else ~v if falls else v for v in (first, last)]
    if null in values or (falls and last is None):
        return df
    kind = df.schema[name].dataType

    def literal(v: int) -> Column:
        if isinstance(kind, T.DateType):
            return F.date_from_unix_date(F.lit(v).cast("int"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.timestamp_micros(F.lit(v)).cast(kind)
        return F.lit(v).cast(kind)

    low, high = reversed(values) if falls else values
    df = df if low is None else df.where(F.col(name) >= literal(low))
    return df if high is None else df.where(F.col(name) <= literal(high))
