"""Scalar column expressions shared by every plan.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage codegen; there is no Python UDF anywhere on the data path.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.sources import schemas as S


def ts_lit(value: str | datetime) -> Column:
    """A ``timestamp_ntz`` literal (zone-free, like DATETIME2)."""
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(T.TimestampNTZType())


def as_ts(value: str | datetime | Column) -> Column:
    return value if isinstance(value, Column) else ts_lit(value)


def parse_enum(col: Column | str, names: list[str]) -> Column:
    """Lenient enum parse: the trimmed exact (case-sensitive) name, or the
    digit string of a defined value. Anything else is NULL (= "did not parse").
    Undefined digits and comma lists are rejected on purpose."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.trim(c)
    # try_cast: no ANSI cast error whatever order the predicates run in.
    num = t.try_cast("int")
    by_digit = F.element_at(F.array(*[F.lit(n) for n in names]), num + 1)
    return (F.when(t.isin(*names), t)
            .when(t.rlike(r"^[0-9]{1,3}$") & (num < len(names)), by_digit))


def enum_literal(text: str, names: list[str]) -> str | None:
    """``parse_enum`` of one literal: the same trim (blanks only) and ASCII digits."""
    s = text.strip(" ")
    if s in names:
        return s
    if 0 < len(s) <= 3 and all(c in "0123456789" for c in s) and int(s) < len(names):
        return names[int(s)]
    return None


def task_status(col: Column | str) -> Column:
    return parse_enum(col, S.TASK_STATUSES)


def task_priority(col: Column | str) -> Column:
    return parse_enum(col, S.TASK_PRIORITIES)


def user_status(col: Column | str) -> Column:
    return parse_enum(col, S.USER_STATUSES)


def is_overdue(due: Column, status: Column, as_of: Column) -> Column:
    """Past due and still open. A NULL due date is never overdue (NULL -> false)."""
    return F.coalesce((due < as_of) & ~status.isin(*S.CLOSED_STATUSES), F.lit(False))


def flag(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` operand."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_if(cond: Column) -> Column:
    """Conditional count as BIGINT, 0 (never NULL) on empty input."""
    return F.coalesce(F.sum(flag(cond)), F.lit(0)).cast("long")


def proc_full_name(first: Column, last: Column) -> Column:
    """Procedure-style ``CONCAT(first, ' ', last)``: NULL parts read as ''."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def dto_full_name(matched: Column, first: Column, last: Column) -> Column:
    """View-style name: NULL when there is no related row."""
    return F.when(matched, F.concat(first, F.lit(" "), last))


def json_image(*fields: tuple[str, Column]) -> Column:
    """JSON text with keys in the given order; NULL values are kept as
    ``null`` (the source used ISNULL(x,'null')). Text is escaped, unlike the
    source's plain concatenation (deliberate)."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields]), {"ignoreNullFields": "false"})


def audit_insert_image(df_prefix: str = "") -> Column:
    p = df_prefix
    return json_image(("Title", F.col(p + "title")), ("Status", F.col(p + "status")),
                      ("Priority", F.col(p + "priority")), ("ProjectId", F.col(p + "project_id")),
                      ("AssignedToId", F.col(p + "assigned_to_id")))


def audit_update_image(df_prefix: str = "") -> Column:
    p = df_prefix
    return json_image(("Title", F.col(p + "title")), ("Status", F.col(p + "status")),
                      ("Priority", F.col(p + "priority")),
                      ("AssignedToId", F.col(p + "assigned_to_id")))


def audit_delete_image(df_prefix: str = "") -> Column:
    p = df_prefix
    return json_image(("Title", F.col(p + "title")), ("Status", F.col(p + "status")),
                      ("ProjectId", F.col(p + "project_id")))


def text_key(col: Column | str) -> Column:
    """Comparison key for case-insensitive, trailing-blank-insensitive
    uniqueness (username, email, role name)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.rtrim(c))


def _default_for(dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.IntegralType, T.FractionalType, T.DecimalType)):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return ts_lit("0001-01-01 00:00:00").cast(dtype)
    return F.lit(None).cast(dtype)


def conform(df: DataFrame, shape: T.StructType) -> DataFrame:
    """Map any result onto a declared report shape: columns are matched by
    name ignoring case and underscores (``InProgressTasks`` matches
    ``in_progress_tasks``) and cast to the declared type; extra columns are
    dropped; a missing column or a NULL value becomes the type's default
    (0 / '' / false) unless the field is nullable, in which case it stays NULL."""
    def norm(name: str) -> str:
        return name.lower().replace("_", "")

    by_norm = {norm(c): c for c in df.columns}
    cols = []
    for f in shape.fields:
        src = by_norm.get(norm(f.name))
        value = F.col(f"`{src}`").cast(f.dataType) if src is not None else F.lit(None).cast(f.dataType)
        if not f.nullable:
            value = F.coalesce(value, _default_for(f.dataType))
        cols.append(value.alias(f.name))
    return df.select(*cols)
