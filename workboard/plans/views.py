"""Listing views: joined detail rows, overviews, paging.

* to-one lookups from tasks (project, assignee) read the tasks once; NULL keys
  are spread over several reducers, hot keys are split by adaptive execution
  (``lookup_join``);
* to-many counts are pre-aggregated per key *before* the join (never
  join-then-count raw collections);
* the role list is collected per user after the bridge join; each group is
  bounded by the role catalogue (the bridge key is unique per user and role).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.exprs import dto_full_name, enum_literal
from workboard.operators import paging
from workboard.operators.joins import lookup_join
from workboard.sources.schemas import TASK_STATUSES

TASK_DTO_COLUMNS = ["id", "title", "description", "status", "priority", "due_date",
                    "project_id", "project_name", "assigned_to_id", "assigned_to_name",
                    "created_at", "completed_at"]


def task_details(tasks: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """The task view. Project name is '' when the project is missing; the
    assignee name is NULL when there is no assignee."""
    p = projects.select(F.col("id").alias("__p_id"), F.col("name").alias("__p_name"))
    u = users.select(F.col("id").alias("__u_id"), F.col("first_name").alias("__u_first"),
                     F.col("last_name").alias("__u_last"))
    tp = lookup_join(tasks, p, "project_id", "__p_id", "left", "id")
    j = lookup_join(tp, u, "assigned_to_id", "__u_id", "left", "id")
    return j.select(
        "id", "title", "description", "status", "priority", "due_date", "project_id",
        F.coalesce(F.col("__p_name"), F.lit("")).alias("project_name"),
        "assigned_to_id",
        dto_full_name(F.col("__u_id").isNotNull(), F.col("__u_first"), F.col("__u_last"))
        .alias("assigned_to_name"),
        "created_at", "completed_at")


def project_overview(projects: DataFrame, users: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every project (inactive and empty ones too) with owner name ('' if
    missing) and task count over all statuses."""
    counts = tasks.groupBy("project_id").agg(F.count(F.lit(1)).cast("long").alias("__n"))
    owners = users.select(F.col("id").alias("__o_id"), F.col("first_name").alias("__o_first"),
                          F.col("last_name").alias("__o_last"))
    po = lookup_join(projects, owners, "owner_id", "__o_id", "left", "id")
    j = po.join(counts, po.id == counts.project_id, "left")
    owner_name = F.coalesce(
        dto_full_name(F.col("__o_id").isNotNull(), F.col("__o_first"), F.col("__o_last")),
        F.lit(""))
    return j.select("id", "name", "description", "owner_id",
                    owner_name.alias("owner_name"), "is_active", "created_at",
                    F.coalesce(F.col("__n"), F.lit(0)).cast("long").alias("task_count"))


def user_overview(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """User view with the sorted list of role names ([] if none); never
    exposes the password hash."""
    named = user_roles.join(roles.select(F.col("id").alias("__r_id"), F.col("name").alias("__r")),
                            user_roles.role_id == F.col("__r_id"), "inner")
    per_user = named.groupBy(F.col("user_id").alias("__uid")).agg(
        F.array_sort(F.collect_list("__r")).alias("__roles"))
    j = users.join(per_user, users.id == per_user.__uid, "left")
    return j.select("id", "username", "email", "first_name", "last_name", "status",
                    "created_at",
                    F.coalesce(F.col("__roles"), F.array().cast("array<string>")).alias("roles"))


def tasks_by_user(tasks: DataFrame, projects: DataFrame, users: DataFrame,
                  assignees: DataFrame) -> DataFrame:
    """Tasks of the given assignees (one id column ``user_id``), priority
    desc (as text) then due date asc. Many users at once is a semi join."""
    mine = tasks.join(assignees, tasks.assigned_to_id == assignees.user_id, "left_semi")
    view = task_details(mine, projects, users)
    return view.orderBy(F.col("assigned_to_id"), F.col("priority").desc(),
                        F.col("due_date").asc_nulls_first(), F.col("id"))


def filter_tasks(tasks: DataFrame, project_id: int | None = None,
                 status: str | None = None) -> DataFrame:
    """Optional equality filters. A status that does not parse as a task
    status is ignored (no filter), as in the source."""
    t = tasks
    if project_id is not None:
        t = t.where(F.col("project_id") == F.lit(project_id))
    if status:
        parsed = enum_literal(status, TASK_STATUSES)
        if parsed is not None:
            t = t.where(F.col("status") == F.lit(parsed))
    return t


def task_page(tasks: DataFrame, projects: DataFrame, users: DataFrame, page: int = 1,
              page_size: int = 10, project_id: int | None = None,
              status: str | None = None) -> DataFrame:
    """L1: newest first (created desc, id desc as the tie-break)."""
    t = filter_tasks(tasks, project_id, status)
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    ordered = paging.page(t, newest, page, page_size)
    # Only the page's rows reach the joins; re-sorting them is trivial.
    return task_details(ordered, projects, users).orderBy(*newest)


def task_page_deep(tasks: DataFrame, projects: DataFrame, users: DataFrame, page: int, page_size: int = 10,
                   project_id: int | None = None, status: str | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """L1 for pages far from the first: reads the key range between two page
    anchors instead of gathering all rows before the page. ``anchors`` (of the same
    filtered tasks, from ``paging.page_anchors``) may be kept between pages."""
    t = filter_tasks(tasks, project_id, status)
    order = [("created_at", "desc"), ("id", "desc")]
    anchors = anchors if anchors is not None else paging.page_anchors(t, order)
    rows = paging.anchored_page(t, order, anchors, page, page_size)
    return task_details(rows, projects, users).orderBy(F.col("created_at").desc(), F.col("id").desc())


def task_page_info(tasks: DataFrame, page: int = 1, page_size: int = 10,
                   project_id: int | None = None, status: str | None = None) -> DataFrame:
    """L2: TotalCount, TotalPages = ceil, HasPrevious, HasNext."""
    return paging.page_info(filter_tasks(tasks, project_id, status), page, page_size)


def project_page(projects: DataFrame, users: DataFrame, tasks: DataFrame, page: int = 1,
                 page_size: int = 10) -> DataFrame:
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    ordered = paging.page(projects, newest, page, page_size)
    # The page's ids restrict the task count aggregation before the shuffle.
    page_tasks = tasks.join(ordered.select(F.col("id").alias("__pg")),
                            tasks.project_id == F.col("__pg"), "left_semi")
    return project_overview(ordered, users, page_tasks).orderBy(*newest)


def user_page(users: DataFrame, user_roles: DataFrame, roles: DataFrame, page: int = 1,
              page_size: int = 10) -> DataFrame:
    ordered = paging.page(users, [F.col("id").asc()], page, page_size)
    return user_overview(ordered, user_roles, roles).orderBy("id")


def find(df: DataFrame, predicate: Column) -> DataFrame:
    """Generic predicate filter."""
    return df.where(predicate)


def count(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One-row count, optionally of the rows matching ``predicate``."""
    d = df if predicate is None else df.where(predicate)
    return d.agg(F.count(F.lit(1)).cast("long").alias("n"))
