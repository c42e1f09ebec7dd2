"""Declared schemas of the seven domain tables and their value domains.

Ids are ``LongType`` everywhere so that a 100 TB deployment never overflows
an INT identity. Times are ``timestamp_ntz`` (all times are UTC wall clock).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's for right results.
# Enum names are stored as text, in declaration order (the position is the
# numeric enum value accepted as a digit string).
# ---------------------------------------------------------------------------
TASK_STATUSES = ["Pending", "InProgress", "Completed", "OnHold", "Cancelled"]
TASK_PRIORITIES = ["Low", "Medium", "High", "Critical"]
USER_STATUSES = ["Active", "Inactive", "Suspended"]
# Statuses that never count as overdue.
CLOSED_STATUSES = ["Completed", "Cancelled"]
# Seeded role catalogue.
SEED_ROLES = [(1, "Admin", "Full system access"), (2, "User", "Standard user access")]
# Role given on self-registration.
SELF_REGISTRATION_ROLE_ID = 2
# Audit entity name and actions.
AUDIT_ENTITY_TASK = "TaskItem"
AUDIT_INSERT, AUDIT_UPDATE, AUDIT_DELETE = "INSERT", "UPDATE", "DELETE"
# Reject reasons (HTTP status of the source system in brackets).
NOT_FOUND = "NOT_FOUND"  # 404
CONFLICT = "CONFLICT"  # 409
BAD_REQUEST = "BAD_REQUEST"  # 400
FK_VIOLATION = "FK_VIOLATION"  # 500, raised by the database constraint
# Maximum text lengths from the DDL (column -> NVARCHAR(n)).
MAX_LENGTHS = {
    "users": {"username": 50, "email": 100, "password_hash": 256, "first_name": 50,
              "last_name": 50, "status": 20},
    "roles": {"name": 50, "description": 200},
    "projects": {"name": 100, "description": 500},
    "tasks": {"title": 200, "description": 2000, "status": 20, "priority": 20},
    "audit_logs": {"entity_name": 100, "action": 20, "performed_by": 100},
    "refresh_tokens": {"token": 256},
}
NOT_NULL = {
    "users": ["id", "username", "email", "password_hash", "first_name", "last_name",
              "status", "created_at"],
    "roles": ["id", "name", "created_at"],
    "user_roles": ["user_id", "role_id", "assigned_at"],
    "projects": ["id", "name", "owner_id", "created_at", "is_active"],
    "tasks": ["id", "title", "status", "priority", "project_id", "created_at"],
    "audit_logs": ["id", "entity_name", "entity_id", "action", "performed_at"],
    "refresh_tokens": ["id", "token", "user_id", "expires_at", "created_at"],
}
ENUM_COLUMNS = {
    "users": {"status": USER_STATUSES},
    "tasks": {"status": TASK_STATUSES, "priority": TASK_PRIORITIES},
}


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


L, S, TS, B = T.LongType(), T.StringType(), T.TimestampNTZType(), T.BooleanType()

USERS = T.StructType([
    _f("id", L), _f("username", S), _f("email", S), _f("password_hash", S),
    _f("first_name", S), _f("last_name", S), _f("status", S), _f("created_at", TS),
    _f("updated_at", TS),
])
ROLES = T.StructType([_f("id", L), _f("name", S), _f("description", S), _f("created_at", TS)])
USER_ROLES = T.StructType([_f("user_id", L), _f("role_id", L), _f("assigned_at", TS)])
PROJECTS = T.StructType([
    _f("id", L), _f("name", S), _f("description", S), _f("owner_id", L),
    _f("created_at", TS), _f("updated_at", TS), _f("is_active", B),
])
TASKS = T.StructType([
    _f("id", L), _f("title", S), _f("description", S), _f("status", S), _f("priority", S),
    _f("due_date", TS), _f("project_id", L), _f("assigned_to_id", L), _f("created_at", TS),
    _f("updated_at", TS), _f("completed_at", TS),
])
AUDIT_LOGS = T.StructType([
    _f("id", L), _f("entity_name", S), _f("entity_id", L), _f("action", S),
    _f("old_values", S), _f("new_values", S), _f("performed_by", S), _f("performed_at", TS),
])
REFRESH_TOKENS = T.StructType([
    _f("id", L), _f("token", S), _f("user_id", L), _f("expires_at", TS),
    _f("created_at", TS), _f("revoked_at", TS),
])

DOMAIN_SCHEMAS = {
    "users": USERS, "roles": ROLES, "user_roles": USER_ROLES, "projects": PROJECTS,
    "tasks": TASKS, "audit_logs": AUDIT_LOGS, "refresh_tokens": REFRESH_TOKENS,
}

# Report shapes (snake_case names of the report records).
TASK_SUMMARY_REPORT = T.StructType([
    _f("total_tasks", L, False), _f("pending_tasks", L, False),
    _f("in_progress_tasks", L, False), _f("completed_tasks", L, False),
    _f("overdue_tasks", L, False),
])
PROJECT_TASK_REPORT = T.StructType([
    _f("project_id", L, False), _f("project_name", S, False), _f("total_tasks", L, False),
    _f("completed_tasks", L, False), _f("completion_percentage", T.DoubleType(), False),
])
USER_PRODUCTIVITY_REPORT = T.StructType([
    _f("user_id", L, False), _f("username", S, False), _f("assigned_tasks", L, False),
    _f("completed_tasks", L, False), _f("rank", L, False),
])

# Request tables of the change-set jobs. ``seq`` orders requests; a NULL value
# field means "leave unchanged" for patches.
TASK_CREATE_REQUESTS = T.StructType([
    _f("seq", L), _f("title", S), _f("description", S), _f("priority", S),
    _f("due_date", TS), _f("project_id", L), _f("assigned_to_id", L),
])
TASK_PATCH_REQUESTS = T.StructType([
    _f("seq", L), _f("id", L), _f("title", S), _f("description", S), _f("status", S),
    _f("priority", S), _f("due_date", TS), _f("assigned_to_id", L),
])
USER_CREATE_REQUESTS = T.StructType([
    _f("seq", L), _f("username", S), _f("email", S), _f("password_hash", S),
    _f("first_name", S), _f("last_name", S), _f("role_ids", T.ArrayType(L)),
])
USER_PATCH_REQUESTS = T.StructType([
    _f("seq", L), _f("id", L), _f("email", S), _f("first_name", S), _f("last_name", S),
    _f("status", S),
])
PROJECT_CREATE_REQUESTS = T.StructType([
    _f("seq", L), _f("name", S), _f("description", S), _f("owner_id", L),
])
PROJECT_PATCH_REQUESTS = T.StructType([
    _f("seq", L), _f("id", L), _f("name", S), _f("description", S), _f("is_active", B),
])
