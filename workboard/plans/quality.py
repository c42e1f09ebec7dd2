"""Data-quality reports from the declared constraints.

* ``unique_violations``: one aggregate per constraint over its typed key alone
  (one pruned column is read, a number is shuffled as a number); only keys seen
  more than once are labelled and turned into text.
* ``fk_violations``: child keys are pre-aggregated to ``(key, rows)`` before
  the anti join with the parent keys, so the join sees one row per distinct
  key, never the hot key's rows.
* ``domain_violations``: one scan per table; each row yields the list of
  rules it breaks (``array_compact`` of ``when`` structs), exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.exprs import text_key
from workboard.sources import schemas as S


def _key_text(*cols: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in cols])


def unique_keys(users: DataFrame, roles: DataFrame, user_roles: DataFrame,
                projects: DataFrame, tasks: DataFrame, audit_logs: DataFrame,
                refresh_tokens: DataFrame) -> list[tuple[DataFrame, str, str, list[Column]]]:
    """(frame, table, constraint, key columns) for every declared unique key.
    Text keys compare case-insensitively and ignore trailing blanks; a token is
    compared exactly (its letters carry information, so folding would report
    different tokens)."""
    c = F.col
    return [
        (users, "users", "pk_users", [c("id")]),
        (users, "users", "uq_users_username", [text_key("username")]),
        (users, "users", "uq_users_email", [text_key("email")]),
        (roles, "roles", "pk_roles", [c("id")]),
        (roles, "roles", "uq_roles_name", [text_key("name")]),
        (user_roles, "user_roles", "pk_user_roles", [c("user_id"), c("role_id")]),
        (projects, "projects", "pk_projects", [c("id")]),
        (tasks, "tasks", "pk_tasks", [c("id")]),
        (audit_logs, "audit_logs", "pk_audit_logs", [c("id")]),
        (refresh_tokens, "refresh_tokens", "pk_refresh_tokens", [c("id")]),
        (refresh_tokens, "refresh_tokens", "uq_refresh_tokens_token", [c("token")]),
    ]


def unique_violations(users: DataFrame, roles: DataFrame, user_roles: DataFrame,
                      projects: DataFrame, tasks: DataFrame, audit_logs: DataFrame,
                      refresh_tokens: DataFrame) -> DataFrame:
    """Q1: (table_name, constraint_name, key_value, n) for keys seen n > 1 times."""
    out = None
    for df, t, name, key in unique_keys(users, roles, user_roles, projects, tasks, audit_logs, refresh_tokens):
        names = [f"k{i}" for i in range(len(key))]
        twice = (df.select(*[k.alias(n) for k, n in zip(key, names)]).groupBy(*names)
                 .agg(F.count(F.lit(1)).cast("long").alias("n")).where("n > 1"))
        part = twice.select(F.lit(t).alias("table_name"), F.lit(name).alias("constraint_name"),
                            F.concat_ws(",", *[F.col(n).cast("string") for n in names]).alias("key_value"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def fk_violations(users: DataFrame, roles: DataFrame, user_roles: DataFrame,
                  projects: DataFrame, tasks: DataFrame,
                  refresh_tokens: DataFrame) -> DataFrame:
    """Q2: (table_name, fk_name, key_value, n_rows) for child key values with
    no parent row. NULL foreign keys (an unassigned task) are allowed."""
    fks = [
        (user_roles, "user_roles", "fk_user_roles_user", "user_id", users),
        (user_roles, "user_roles", "fk_user_roles_role", "role_id", roles),
        (projects, "projects", "fk_projects_owner", "owner_id", users),
        (tasks, "tasks", "fk_tasks_project", "project_id", projects),
        (tasks, "tasks", "fk_tasks_assignee", "assigned_to_id", users),
        (refresh_tokens, "refresh_tokens", "fk_refresh_tokens_user", "user_id", users),
    ]
    out = None
    for child, table, name, col, parent in fks:
        keys = (child.where(F.col(col).isNotNull())
                .groupBy(F.col(col).alias("__k")).agg(F.count(F.lit(1)).cast("long").alias("n_rows")))
        orphans = keys.join(parent.select(F.col("id").alias("__pk")),
                            F.col("__k") == F.col("__pk"), "left_anti")
        part = orphans.select(F.lit(table).alias("table_name"), F.lit(name).alias("fk_name"),
                              F.col("__k").cast("string").alias("key_value"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def _row_violations(df: DataFrame, table: str, row_id: Column) -> DataFrame:
    rules: list[Column] = []
    for col in S.NOT_NULL.get(table, []):
        rules.append(F.when(F.col(col).isNull(),
                            F.struct(F.lit(col).alias("column_name"), F.lit("not_null").alias("rule"))))
    for col, n in S.MAX_LENGTHS.get(table, {}).items():
        rules.append(F.when(F.length(F.col(col)) > n,
                            F.struct(F.lit(col).alias("column_name"),
                                     F.lit(f"max_length_{n}").alias("rule"))))
    for col, names in S.ENUM_COLUMNS.get(table, {}).items():
        rules.append(F.when(F.col(col).isNotNull() & ~F.col(col).isin(*names),
                            F.struct(F.lit(col).alias("column_name"), F.lit("enum").alias("rule"))))
    broken = F.array_compact(F.array(*rules))
    return (df.select(row_id.alias("row_id"), F.explode(broken).alias("v"))
            .select(F.lit(table).alias("table_name"), "row_id", "v.column_name", "v.rule"))


def domain_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Q3: (table_name, row_id, column_name, rule) for NOT NULL, maximum
    length and enum-membership rules; one scan per table."""
    out = None
    for table, df in tables.items():
        if table == "user_roles":
            rid = _key_text(F.col("user_id"), F.col("role_id"))
        else:
            rid = F.col("id").cast("string")
        part = _row_violations(df, table, rid)
        out = part if out is None else out.unionByName(part)
    return out
