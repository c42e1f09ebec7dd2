"""Audit capture (the three task triggers) as change-data-capture over
before / after images or whole snapshots, plus the audit trail and the overdue check.

* INSERT rows: keys Title, Status, Priority, ProjectId, AssignedToId.
* UPDATE rows: old and new images with Title, Status, Priority,
  AssignedToId (no ProjectId), written for every update even if nothing
  changed.
* DELETE rows: old image with Title, Status, ProjectId.

The JSON text is built by ``to_json`` (escaped; NULL kept as ``null``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.exprs import (as_ts, audit_delete_image, audit_insert_image,
                                       audit_update_image)
from workboard.operators.keyed_scan import keyed_row_number
from workboard.sources import schemas as S

AsOf = str | datetime | Column
AUDIT_COLUMNS = ["entity_name", "entity_id", "action", "old_values", "new_values",
                 "performed_by", "performed_at"]


def _rows(df: DataFrame, action: str, old: Column | None, new: Column | None,
          now: Column) -> DataFrame:
    return df.select(
        F.lit(S.AUDIT_ENTITY_TASK).alias("entity_name"), F.col("id").alias("entity_id"),
        F.lit(action).alias("action"),
        (old if old is not None else F.lit(None).cast("string")).alias("old_values"),
        (new if new is not None else F.lit(None).cast("string")).alias("new_values"),
        F.lit(None).cast("string").alias("performed_by"), now.alias("performed_at"))


def audit_rows(inserted: DataFrame | None = None, deleted: DataFrame | None = None,
               *, as_of: AsOf) -> DataFrame:
    """Audit rows for task rows that were inserted and / or deleted."""
    now = as_ts(as_of)
    parts = []
    if inserted is not None:
        parts.append(_rows(inserted, S.AUDIT_INSERT, None, audit_insert_image(), now))
    if deleted is not None:
        parts.append(_rows(deleted, S.AUDIT_DELETE, audit_delete_image(), None, now))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_snapshot_diff(before: DataFrame, after: DataFrame, as_of: AsOf) -> DataFrame:
    """A1-A3 from two snapshots of the tasks: one row per id that came (INSERT),
    went (DELETE) or whose row differs in any column (UPDATE; an update without
    new values still moves updated_at).

    One aggregate over both snapshots, tagged and united: each id's two rows meet
    in a single shuffle, which all three actions share."""
    now = as_ts(as_of)
    names = before.columns
    sides = before.select("id", F.struct(*names).alias("b"), F.lit(None).alias("a")).unionByName(
        after.select("id", F.lit(None).alias("b"), F.struct(*[F.col(c) for c in names]).alias("a")))
    met = (sides.groupBy("id").agg(F.max("b").alias("b"), F.max("a").alias("a"))
           .where(~F.col("a").eqNullSafe(F.col("b"))))
    action = (F.when(F.col("b").isNull(), S.AUDIT_INSERT).when(F.col("a").isNull(), S.AUDIT_DELETE).otherwise(S.AUDIT_UPDATE))
    flat = met.select("id", action.alias("action"), *[F.col("a")[c].alias(f"__a_{c}") for c in names],
                      *[F.col("b")[c].alias(f"__b_{c}") for c in names])

    def of(insert: Column | None, update: Column, delete: Column | None) -> Column:
        kind = F.col("action")
        parts = [(S.AUDIT_INSERT, insert), (S.AUDIT_UPDATE, update), (S.AUDIT_DELETE, delete)]
        return F.coalesce(*[F.when(kind == name, image) for name, image in parts if image is not None])

    return flat.select(
        F.lit(S.AUDIT_ENTITY_TASK).alias("entity_name"), F.col("id").alias("entity_id"), "action",
        of(None, audit_update_image("__b_"), audit_delete_image("__b_")).alias("old_values"),
        of(audit_insert_image("__a_"), audit_update_image("__a_"), None).alias("new_values"),
        F.lit(None).cast("string").alias("performed_by"), now.alias("performed_at"))


def audit_history(audit_logs: DataFrame, entity_name: str | None = None,
                  entity_id: int | None = None, since: AsOf | None = None,
                  until: AsOf | None = None) -> DataFrame:
    """A4: audit trail, newest first, with each row's position in its
    entity's trail (1 = latest). Filters are optional and reach the scan."""
    a = audit_logs
    if entity_name is not None:
        a = a.where(F.col("entity_name") == F.lit(entity_name))
    if entity_id is not None:
        a = a.where(F.col("entity_id") == F.lit(entity_id))
    if since is not None:
        a = a.where(F.col("performed_at") >= as_ts(since))
    if until is not None:
        a = a.where(F.col("performed_at") < as_ts(until))
    trail = keyed_row_number(a, ["entity_name", "entity_id"],
                             [("performed_at", "desc"), ("id", "desc")],
                             out="trail_position")
    return trail.orderBy(F.col("performed_at").desc(), F.col("id").desc())


def overdue_since(tasks: DataFrame, previous_as_of: AsOf, as_of: AsOf) -> DataFrame:
    """Open tasks whose due date passed in [previous_as_of, as_of), i.e.
    the tasks a periodic overdue check would newly report."""
    prev, now = as_ts(previous_as_of), as_ts(as_of)
    due = F.col("due_date")
    return (tasks.where((due >= prev) & (due < now)
                        & ~F.col("status").isin(*S.CLOSED_STATUSES))
            .select("id", "title", "project_id", "assigned_to_id", "due_date",
                    F.datediff(now.cast("date"), due.cast("date")).cast("long")
                    .alias("days_overdue")))


def audit_problem() -> Column:
    """What makes an audit entry unfit for the log; NULL if nothing does."""
    needed = ["id", "entity_name", "entity_id", "action", "performed_at"]
    missing = F.greatest(*[F.col(c).isNull() for c in needed])
    known = [S.AUDIT_INSERT, S.AUDIT_UPDATE, S.AUDIT_DELETE]
    broken = F.greatest(*[F.col(c).isNotNull() & F.try_parse_json(F.col(c)).isNull() for c in ["old_values", "new_values"]])
    return (F.when(missing, "MISSING_VALUE").when(~F.col("action").isin(*known), "UNKNOWN_ACTION")
            .when(broken, "BROKEN_VALUES"))


# Fixed value: the drain's log template.
AUDIT_LINE_TEMPLATE = "[AUDIT] %s on %s#%s by %s at %s"


def audit_lines(audit_logs: DataFrame) -> DataFrame:
    """T1 body: one log line per audit entry. A NULL user prints as
    ``(null)``; the time prints as ISO-8601."""
    when = F.date_format(F.col("performed_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.format_string(AUDIT_LINE_TEMPLATE, F.col("action"), F.col("entity_name"),
                           F.col("entity_id").cast("string"),
                           F.coalesce(F.col("performed_by"), F.lit("(null)")), when)
    return audit_logs.select("id", line.alias("line"))
