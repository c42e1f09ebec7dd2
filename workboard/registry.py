"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Each callable maps the driver's tables onto the domain tables
(``workboard.sources.fixtures``) and runs one plan over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.functions.exprs import conform
from workboard.plans import audit as audit_plans
from workboard.plans import changes, quality, reports, views
from workboard.sources import schemas as S
from workboard.sources.fixtures import AUDIT_SINCE, AUDIT_UNTIL, AUDITED_ID, PREVIOUS_CHECK, TASKS_AS_OF, TOKENS_AS_OF, Domain

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# The same queries over any Domain (inline mapping or stored tables).
BUILDERS: dict[str, Callable[[Domain], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        BUILDERS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        return fn
    return deco


# ---------------------------------------------------------------- reports
@register("task_summary")
def _task_summary(d: Domain) -> DataFrame:
    return reports.task_summary(d.tasks, TASKS_AS_OF)


@register("project_task_report")
def _project_task_report(d: Domain) -> DataFrame:
    return reports.project_task_report(d.tasks, d.projects)


@register("user_productivity")
def _user_productivity(d: Domain) -> DataFrame:
    return reports.user_productivity(d.tasks, d.users)


@register("tasks_with_details")
def _tasks_with_details(d: Domain) -> DataFrame:
    return reports.tasks_with_details(d.tasks, d.projects, d.users)


@register("tasks_with_details_filtered")
def _tasks_with_details_filtered(d: Domain) -> DataFrame:
    return reports.tasks_with_details(d.tasks, d.projects, d.users, status="InProgress")


@register("overdue_tasks")
def _overdue_tasks(d: Domain) -> DataFrame:
    return reports.overdue_tasks(d.tasks, d.projects, d.users, TASKS_AS_OF)


@register("dashboard_stats")
def _dashboard_stats(d: Domain) -> DataFrame:
    return reports.dashboard_stats(d.tasks, d.projects, d.users)


# ---------------------------------------------------------------- views


@register("task_details")
def _task_details(d: Domain) -> DataFrame:
    return views.task_details(d.tasks, d.projects, d.users)


@register("project_overview")
def _project_overview(d: Domain) -> DataFrame:
    return views.project_overview(d.projects, d.users, d.tasks)


@register("user_overview")
def _user_overview(d: Domain) -> DataFrame:
    return views.user_overview(d.users, d.user_roles, d.roles)


@register("tasks_by_user")
def _tasks_by_user(d: Domain) -> DataFrame:
    active = d.users.where(F.col("status") == "Active").select(F.col("id").alias("user_id"))
    return views.tasks_by_user(d.tasks, d.projects, d.users, active)


@register("task_page")
def _task_page(d: Domain) -> DataFrame:
    return views.task_page(d.tasks, d.projects, d.users, page=3, page_size=25,
                           status="InProgress")


@register("task_page_unparsed_status")
def _task_page_unparsed(d: Domain) -> DataFrame:
    return views.task_page(d.tasks, d.projects, d.users, page=2, page_size=20,
                           status="NotAStatus")


@register("task_page_deep")
def _task_page_deep(d: Domain) -> DataFrame:
    return views.task_page_deep(d.tasks, d.projects, d.users, page=1000, page_size=10)


@register("find_unassigned")
def _find_unassigned(d: Domain) -> DataFrame:
    return views.find(d.tasks, F.col("assigned_to_id").isNull() & (F.col("priority") == "High")
                      & ~F.col("status").isin(*S.CLOSED_STATUSES))


@register("task_page_info")
def _task_page_info(d: Domain) -> DataFrame:
    return views.task_page_info(d.tasks, page=3, page_size=25, status="InProgress")


@register("project_page")
def _project_page(d: Domain) -> DataFrame:
    return views.project_page(d.projects, d.users, d.tasks, page=2, page_size=50)


@register("user_page")
def _user_page(d: Domain) -> DataFrame:
    return views.user_page(d.users, d.user_roles, d.roles, page=2, page_size=10)


@register("count_open_critical")
def _count_open_critical(d: Domain) -> DataFrame:
    return views.count(d.tasks, (F.col("priority") == "Critical")
                       & ~F.col("status").isin(*S.CLOSED_STATUSES))


@register("report_conform")
def _report_conform(d: Domain) -> DataFrame:
    # A raw procedure-style result: PascalCase / odd-case names, one column
    # missing (-> 0), one extra column (dropped).
    st = F.col("status")
    raw = d.tasks.agg(
        F.count(F.lit(1)).alias("TotalTasks"),
        F.sum(F.when(st == "Pending", 1).otherwise(0)).alias("PENDINGTASKS"),
        F.sum(F.when(st == "InProgress", 1).otherwise(0)).alias("InProgressTasks"),
        F.sum(F.when(st == "Completed", 1).otherwise(0)).alias("completedtasks"),
        F.max("id").alias("Junk"))
    return conform(raw, S.TASK_SUMMARY_REPORT)


# ---------------------------------------------------------------- change sets


def _create_tasks(d: Domain) -> changes.ChangeSet:
    return changes.create_tasks(d.tasks, d.projects, d.users, d.task_creates, TASKS_AS_OF)


def _patch_tasks(d: Domain) -> changes.ChangeSet:
    return changes.patch_tasks(d.tasks, d.users, d.task_patches, TASKS_AS_OF)


def _delete_projects(d: Domain) -> changes.ChangeSet:
    return changes.delete_projects(d.projects, d.tasks, d.project_deletes, TASKS_AS_OF)


def _create_users(d: Domain) -> changes.ChangeSet:
    return changes.create_users(d.users, d.user_roles, d.roles, d.user_creates, TASKS_AS_OF)


def _delete_users(d: Domain) -> changes.ChangeSet:
    return changes.delete_users(d.users, d.projects, d.user_roles, d.refresh_tokens, d.tasks,
                                d.user_deletes, TASKS_AS_OF)


def _assign_roles(d: Domain) -> changes.ChangeSet:
    return changes.assign_roles(d.user_roles, d.users, d.roles, d.role_assignments, TASKS_AS_OF)


register("create_tasks")(lambda d: _create_tasks(d).accepted)
register("create_tasks_rejected")(lambda d: _create_tasks(d).rejected)
register("patch_tasks")(lambda d: _patch_tasks(d).table)
register("patch_tasks_rejected")(lambda d: _patch_tasks(d).rejected)
register("audit_update")(lambda d: _patch_tasks(d).audit)
register("set_task_status")(
    lambda d: changes.set_task_status(d.tasks, d.task_status_sets, TASKS_AS_OF).table)
register("set_task_status_rejected")(
    lambda d: changes.set_task_status(d.tasks, d.task_status_sets, TASKS_AS_OF).rejected)
register("set_task_status_affected")(
    lambda d: changes.set_task_status(d.tasks, d.task_status_sets, TASKS_AS_OF).accepted)
register("audit_set_status")(
    lambda d: changes.set_task_status(d.tasks, d.task_status_sets, TASKS_AS_OF).audit)
register("audit_bulk_update")(
    lambda d: changes.bulk_update_status(d.tasks, d.bulk_ids, "InProgress", TASKS_AS_OF).audit)
register("bulk_update_status")(
    lambda d: changes.bulk_update_status(d.tasks, d.bulk_ids, "InProgress", TASKS_AS_OF).accepted)
register("delete_tasks")(lambda d: changes.delete_tasks(d.tasks, d.task_deletes, TASKS_AS_OF).table)
register("delete_tasks_rejected")(
    lambda d: changes.delete_tasks(d.tasks, d.task_deletes, TASKS_AS_OF).rejected)
register("delete_projects")(lambda d: _delete_projects(d).table)
register("delete_projects_tasks")(lambda d: _delete_projects(d).extra["tasks"])
register("audit_delete")(lambda d: _delete_projects(d).audit)
register("create_projects")(
    lambda d: changes.create_projects(d.projects, d.users, d.project_creates, TASKS_AS_OF).accepted)
register("create_projects_rejected")(
    lambda d: changes.create_projects(d.projects, d.users, d.project_creates, TASKS_AS_OF).rejected)
register("delete_projects_rejected")(lambda d: _delete_projects(d).rejected)
register("delete_users_user_roles")(lambda d: _delete_users(d).extra["user_roles"])
register("delete_users_tokens")(lambda d: _delete_users(d).extra["refresh_tokens"])
register("tasks_with_details_project")(
    lambda d: reports.tasks_with_details(d.tasks, d.projects, d.users, project_id=1))
register("patch_projects")(
    lambda d: changes.patch_projects(d.projects, d.project_patches, TASKS_AS_OF).table)
register("patch_projects_rejected")(
    lambda d: changes.patch_projects(d.projects, d.project_patches, TASKS_AS_OF).rejected)
register("create_users")(lambda d: _create_users(d).accepted)
register("create_users_rejected")(lambda d: _create_users(d).rejected)
register("create_users_roles")(lambda d: _create_users(d).extra["new_links"])
register("register_users_roles")(lambda d: changes.register_users(
    d.users, d.user_roles, d.roles, d.user_creates, TASKS_AS_OF).extra["new_links"])
register("patch_users")(lambda d: changes.patch_users(d.users, d.user_patches, TASKS_AS_OF).table)
register("patch_users_rejected")(
    lambda d: changes.patch_users(d.users, d.user_patches, TASKS_AS_OF).rejected)
register("delete_users")(lambda d: _delete_users(d).table)
register("delete_users_rejected")(lambda d: _delete_users(d).rejected)
register("delete_users_tasks")(lambda d: _delete_users(d).extra["tasks"])
register("audit_set_null")(lambda d: _delete_users(d).audit)
register("assign_roles")(lambda d: _assign_roles(d).accepted)
register("assign_roles_rejected")(lambda d: _assign_roles(d).rejected)
register("remove_roles")(lambda d: changes.remove_roles(d.user_roles, d.role_removals).table)
register("remove_roles_rejected")(
    lambda d: changes.remove_roles(d.user_roles, d.role_removals).rejected)
register("token_status")(lambda d: changes.token_status(d.refresh_tokens, TOKENS_AS_OF))
register("active_tokens_per_user")(
    lambda d: changes.active_tokens_per_user(d.refresh_tokens, TOKENS_AS_OF))

# ---------------------------------------------------------------- audit
register("audit_insert")(lambda d: _create_tasks(d).audit)
@register("audit_snapshot_diff")
def _audit_snapshot_diff(d: Domain) -> DataFrame:
    # Patched, then without the deleted, with the created: all three actions.
    patched = _patch_tasks(d).table
    left = changes.delete_tasks(patched, d.task_deletes, TASKS_AS_OF).table
    after = left.unionByName(_create_tasks(d).accepted.drop("seq"))
    return audit_plans.audit_snapshot_diff(d.tasks, after, TASKS_AS_OF)


register("audit_history_filtered")(lambda d: audit_plans.audit_history(
    d.audit_logs, entity_name=S.AUDIT_ENTITY_TASK, entity_id=AUDITED_ID, since=AUDIT_SINCE, until=AUDIT_UNTIL))
register("audit_history")(lambda d: audit_plans.audit_history(d.audit_logs))
register("overdue_since")(
    lambda d: audit_plans.overdue_since(d.tasks, PREVIOUS_CHECK, TASKS_AS_OF))
register("audit_lines")(lambda d: audit_plans.audit_lines(d.audit_logs))

# ---------------------------------------------------------------- quality


def _all_tables(d: Domain, users: DataFrame | None = None,
                tasks: DataFrame | None = None) -> dict[str, DataFrame]:
    return {"users": users if users is not None else d.users, "roles": d.roles,
            "user_roles": d.user_roles, "projects": d.projects,
            "tasks": tasks if tasks is not None else d.tasks,
            "audit_logs": d.audit_logs, "refresh_tokens": d.refresh_tokens}


register("unique_violations")(lambda d: quality.unique_violations(**_all_tables(d)))
register("unique_violations_staged")(
    lambda d: quality.unique_violations(**_all_tables(d, users=d.staged_users)))
register("fk_violations")(lambda d: quality.fk_violations(
    d.users, d.roles, d.user_roles, d.projects, d.tasks, d.refresh_tokens))
register("fk_violations_staged")(lambda d: quality.fk_violations(
    d.staged_users, d.roles, d.user_roles, d.projects, d.staged_tasks, d.refresh_tokens))
register("domain_violations")(lambda d: quality.domain_violations(_all_tables(d)))
register("domain_violations_staged")(lambda d: quality.domain_violations(
    _all_tables(d, users=d.staged_users, tasks=d.staged_tasks)))
