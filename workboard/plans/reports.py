"""Flagship reports (the stored procedures), each one lazy plan.

"Now" is an explicit ``as_of`` so that every report can be repeated.
Plan shapes chosen for scale:

* aggregates run partial (map side) + final, so a hot project or assignee is
  combined before any shuffle;
* tasks are pre-aggregated per project / assignee *before* joining the
  dimension, so the join sees one row per key;
* the productivity rank is a histogram rank (no single-partition exchange);
* the per-project row number is a skew-safe keyed scan;
* every output order ends in a unique id so results and pages are stable.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.exprs import (as_ts, count_if, is_overdue, proc_full_name)
from workboard.operators.joins import lookup_join
from workboard.operators.keyed_scan import keyed_row_number
from workboard.operators.rank import count_rank
from workboard.session import stage


def _priority_order(priority: Column, mode: str) -> Column:
    """``text`` (source behaviour: the column is text, so DESC gives Medium,
    Low, High, Critical) or ``severity`` (enum value)."""
    if mode == "text":
        return priority
    if mode == "severity":
        return (F.when(priority == "Low", 0).when(priority == "Medium", 1)
                .when(priority == "High", 2).when(priority == "Critical", 3))
    raise ValueError(f"unknown priority order {mode!r}")


def task_summary(tasks: DataFrame, as_of: str | datetime | Column) -> DataFrame:
    """One row of totals; 0 (not NULL) on an empty table."""
    now = as_ts(as_of)
    st = F.col("status")
    return tasks.agg(
        F.count(F.lit(1)).cast("long").alias("total_tasks"),
        count_if(st == "Pending").alias("pending_tasks"),
        count_if(st == "InProgress").alias("in_progress_tasks"),
        count_if(st == "Completed").alias("completed_tasks"),
        count_if(is_overdue(F.col("due_date"), st, now)).alias("overdue_tasks"),
    )


def project_task_report(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """R2: active projects with at least one task, completion % (2 decimals)."""
    # COUNT(t.Id) over the primary key equals COUNT(*) and needs no id column.
    per_project = tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).cast("long").alias("total_tasks"),
        count_if(F.col("status") == "Completed").alias("completed_tasks"),
    )
    active = projects.where(F.col("is_active")).select(
        F.col("id").alias("p_id"), F.col("name").alias("project_name"))
    j = per_project.join(active, per_project.project_id == active.p_id, "inner")
    # A project in per_project has a task, so the total is never zero.
    pct = F.round(F.col("completed_tasks") * F.lit(100.0) / F.col("total_tasks"), 2)
    return (j.select("project_id", "project_name", "total_tasks", "completed_tasks",
                     pct.alias("completion_percentage"))
            .orderBy(F.col("completion_percentage").desc(), F.col("project_id")))


def user_productivity(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """Active users (also those without tasks), assigned / completed
    counts, RANK() by completed desc (ties share, gaps follow)."""
    per_user = (tasks.where(F.col("assigned_to_id").isNotNull())
                .groupBy("assigned_to_id").agg(
                    F.count(F.lit(1)).cast("long").alias("assigned_tasks"),
                    count_if(F.col("status") == "Completed").alias("completed_tasks")))
    active = users.where(F.col("status") == "Active").select(
        F.col("id").alias("user_id"), "username")
    j = active.join(per_user, active.user_id == per_user.assigned_to_id, "left").select(
        "user_id", "username",
        F.coalesce("assigned_tasks", F.lit(0)).cast("long").alias("assigned_tasks"),
        F.coalesce("completed_tasks", F.lit(0)).cast("long").alias("completed_tasks"))
    # Stored once: the ranking reads it twice, the tasks are read once.
    ranked = count_rank(stage(j, "productivity"), "completed_tasks", out="rank")
    return (ranked.select("user_id", "username", "assigned_tasks", "completed_tasks", "rank")
            .orderBy("rank", "user_id"))


def _detail_base(tasks: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """tasks INNER JOIN projects LEFT JOIN users, with the procedure's name
    text (NULL name parts read as '')."""
    p = projects.select(F.col("id").alias("p_id"), F.col("name").alias("project_name"))
    u = users.select(F.col("id").alias("u_id"), F.col("first_name").alias("u_first"),
                     F.col("last_name").alias("u_last"))
    tp = lookup_join(tasks, p, "project_id", "p_id", "inner", "id")
    return lookup_join(tp, u, "assigned_to_id", "u_id", "left", "id").withColumn(
        "assigned_to_name", proc_full_name(F.col("u_first"), F.col("u_last")))


def tasks_with_details(tasks: DataFrame, projects: DataFrame, users: DataFrame,
                       project_id: int | None = None, status: str | None = None,
                       priority_order: str = "text") -> DataFrame:
    """Task + project name + assignee name + row number per project by
    created desc. Filters run *before* numbering; a None parameter adds no
    filter at all."""
    t = tasks
    if project_id is not None:
        t = t.where(F.col("project_id") == F.lit(project_id))
    if status is not None:
        t = t.where(F.col("status") == F.lit(status))
    base = _detail_base(t, projects, users)
    numbered = keyed_row_number(base, ["project_id"],
                                [("created_at", "desc"), ("id", "desc")],
                                out="task_row_num")
    out = numbered.select("id", "title", "description", "status", "priority", "due_date",
                          "created_at", "completed_at", "project_name", "assigned_to_name",
                          "task_row_num")
    return out.orderBy(_priority_order(F.col("priority"), priority_order).desc(),
                       F.col("due_date").asc_nulls_first(), F.col("id"))


def overdue_tasks(tasks: DataFrame, projects: DataFrame, users: DataFrame,
                  as_of: str | datetime | Column) -> DataFrame:
    """Open tasks past due with whole days overdue (midnights crossed)."""
    now = as_ts(as_of)
    open_due = tasks.where((F.col("due_date") < now)
                           & ~F.col("status").isin("Completed", "Cancelled"))
    base = _detail_base(open_due, projects, users)
    days = F.datediff(now.cast("date"), F.col("due_date").cast("date")).cast("long")
    return (base.select(F.col("id").alias("task_id"), "title", "project_name",
                        F.col("assigned_to_name").alias("assigned_to"), "due_date",
                        days.alias("days_overdue"))
            .orderBy(F.col("days_overdue").desc(), F.col("task_id")))


def dashboard_stats(tasks: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """One row of totals over three tables, as one union-style aggregate
    (one pass, partial aggregation per task, no join)."""
    kind = F.col("__kind")
    u = (tasks.select(F.lit(0).alias("__kind"), (F.col("status") == "Completed").alias("__ok"))
         .unionByName(projects.select(F.lit(1).alias("__kind"),
                                      F.coalesce(F.col("is_active"), F.lit(False)).alias("__ok")))
         .unionByName(users.select(F.lit(2).alias("__kind"),
                                   (F.col("status") == "Active").alias("__ok"))))
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    return u.agg(
        count_if(kind == 0).alias("total_tasks"),
        count_if((kind == 0) & ok).alias("completed_tasks"),
        count_if(kind == 1).alias("total_projects"),
        count_if((kind == 1) & ok).alias("active_projects"),
        count_if(kind == 2).alias("total_users"),
        count_if((kind == 2) & ok).alias("active_users"),
    )
