"""Change sets: single-row creates / patches / deletes re-aimed as batch jobs.

Each job takes table snapshots plus a table of requests (``seq`` orders them)
and returns a ``ChangeSet``: the new snapshot(s), the accepted rows, the
rejected requests with a reason, and the audit rows the database triggers
would have written. Each part is planned when it is first asked for: asking for
the rejects of a batch does not number, store or resolve its other parts. A part
that needs new ids or per-request images runs one counting job when it is
planned (``keyed_scan``), cascades store the ids that go, and outcomes that depend
on the order of requests (C8, C9) are resolved in rounds; all others are lazy.
Nothing is collected.

Scale rules used throughout:

* validation is ``left_semi`` / ``left_anti`` joins (an OR of two keys is two
  joins, never one OR condition);
* the final image of several patches to one id is a **partial aggregate**
  (``max`` of ``struct(seq, value)`` over non-NULL values), so a hot id is
  combined map-side;
* per-request before/after images (one audit row per request) come from the
  skew-safe ``keyed_scan``, not a window over the whole id group;
* new identity values come from ``assign_ids`` (range-partitioned numbering
  plus a one-row ``max(id)`` scalar subquery), never a single-partition sort;
* the new snapshot is a left join of the old one with at most one folded row
  per key, so the join itself is skew-free; writing it is
  ``workboard.sources.sinks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import datetime
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.exprs import (as_ts, audit_update_image, enum_literal, json_image, task_priority,
                                       task_status, text_key, user_status)
from workboard.operators.keyed_scan import assign_ids, keyed_scan
from workboard.operators.pointers import follow
from workboard.plans.audit import audit_rows
from workboard.session import stage
from workboard.sources import schemas as S

AsOf = str | datetime | Column


Part = DataFrame | Callable[[], DataFrame] | None


class _Parts(Mapping):
    """Named frames; one given as a function is made when it is first asked for."""

    def __init__(self, parts: Mapping[str, Part]):
        self._parts = dict(parts)

    def __getitem__(self, name: str) -> DataFrame | None:
        if callable(self._parts[name]):
            self._parts[name] = self._parts[name]()
        return self._parts[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


class ChangeSet:
    """The outcome of a batch: new snapshot, accepted rows, rejects, audit rows, other tables."""

    def __init__(self, table: Part = None, accepted: Part = None, rejected: Part = None, audit: Part = None,
                 extra: Mapping[str, Part] | None = None):
        self._parts = _Parts({"table": table, "accepted": accepted, "rejected": rejected, "audit": audit})
        self.extra = _Parts(extra or {})

    table = property(lambda self: self._parts["table"])
    accepted = property(lambda self: self._parts["accepted"])
    rejected = property(lambda self: self._parts["rejected"])
    audit = property(lambda self: self._parts["audit"])


def _reject(df: DataFrame, reason: str, cols: list[str]) -> DataFrame:
    return df.select(*cols, F.lit(reason).alias("reason"))


def _max_id(df: DataFrame, col: str = "id") -> Column:
    """``max(id)`` as a scalar subquery (one partial + final aggregate); 0 on
    an empty table."""
    return F.coalesce(df.select(F.max(col)).scalar(), F.lit(0)).cast("long")


def _start(table: DataFrame, start: Column | None) -> Column:
    """Identity base: a caller-supplied high-water mark, else ``max(id)``."""
    return start.cast("long") if start is not None else _max_id(table)


def _too_long(table: str, columns: list[str]) -> Column:
    """Some value is longer than its column allows (NULL is not)."""
    limits = S.MAX_LENGTHS[table]
    return F.coalesce(F.greatest(*[F.length(c) > limits[c] for c in columns], F.lit(False)), F.lit(False))


def _repeats(ids: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per repeated request for an id of ``existing`` (column ``id``):
    the first one finds the row, the others do not any more."""
    again = ids.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return again.join(existing.select("id"), "id", "left_semi").select(
        "id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("__n"))).alias("__k")).select("id")


def fold_latest(requests: DataFrame, key: str, fields: list[str], seq: str = "seq",
                extra_aggs: list[Column] | None = None) -> DataFrame:
    """Per key, the latest non-NULL value of each field by ``seq`` (NULL means
    "leave unchanged"). A partial aggregate: hot keys combine map-side."""
    aggs = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(f).alias("v"))))
            .getField("v").alias(f) for f in fields]
    return requests.groupBy(key).agg(*aggs, *(extra_aggs or []))


def _apply_fold(table: DataFrame, folded: DataFrame, key: str, fields: list[str],
                extra: dict[str, Column] | None = None) -> DataFrame:
    """New snapshot: ``coalesce(new, old)`` per field for touched keys."""
    f = folded.select(F.col(key).alias("__fk"), *[F.col(c).alias(f"__new_{c}") for c in fields],
                      *[c for c in folded.columns if c.startswith("__agg_")])
    j = table.join(f, table[key] == f["__fk"], "left")
    touched = F.col("__fk").isNotNull()
    cols = []
    for c in table.columns:
        if c in fields:
            cols.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
        elif extra and c in extra:
            cols.append(F.when(touched, extra[c]).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


# ====================================================================== tasks
def create_tasks(tasks: DataFrame, projects: DataFrame, users: DataFrame,
                 requests: DataFrame, as_of: AsOf, start: Column | None = None) -> ChangeSet:
    """Project must exist (NOT_FOUND); a title that is missing or a text
    that is too long is a BAD_REQUEST; an assignee that is not a user fails the
    foreign key (FK_VIOLATION); an unparseable priority becomes Medium; status
    is Pending; ids continue from ``start`` (default: max(id) of the table) in
    ``seq`` order."""
    now = as_ts(as_of)
    judged = (requests.join(projects.select(F.col("id").alias("__pid")), requests.project_id == F.col("__pid"), "left")
              .join(users.select(F.col("id").alias("__uid")), F.col("assigned_to_id") == F.col("__uid"), "left")
              .withColumn("__why", F.when(F.col("__pid").isNull(), S.NOT_FOUND)
                          .when(F.col("title").isNull() | _too_long("tasks", ["title", "description"]), S.BAD_REQUEST)
                          .when(F.col("assigned_to_id").isNotNull() & F.col("__uid").isNull(), S.FK_VIOLATION)))
    good = judged.where(F.col("__why").isNull()).select(*requests.columns)

    @cache
    def created() -> DataFrame:
        numbered = assign_ids(good, ["seq"], _start(tasks, start), out="id")
        return numbered.select(
            "id", "title", "description", F.lit("Pending").alias("status"),
            F.coalesce(task_priority("priority"), F.lit("Medium")).alias("priority"),
            "due_date", "project_id", "assigned_to_id", now.alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
            F.lit(None).cast("timestamp_ntz").alias("completed_at"),
            "seq")

    rejected = judged.where(F.col("__why").isNotNull()).select("seq", "project_id", F.col("__why").alias("reason"))
    return ChangeSet(table=lambda: tasks.unionByName(created().drop("seq")), accepted=created, rejected=rejected,
                     audit=lambda: audit_rows(inserted=created().drop("seq"), as_of=now))


PATCH_FIELDS = ["title", "description", "status", "priority", "due_date", "assigned_to_id"]
IMAGE_FIELDS = ["title", "status", "priority", "assigned_to_id"]


def patch_tasks(tasks: DataFrame, users: DataFrame, requests: DataFrame, as_of: AsOf) -> ChangeSet:
    """NULL field = unchanged (so a due date or assignee can never be
    cleared); an unparseable status / priority is ignored; a Completed status
    stamps completed_at (leaving Completed later does not clear it);
    updated_at is always set. Unknown ids are NOT_FOUND, texts that are too long
    a BAD_REQUEST, an assignee that is not a user an FK_VIOLATION; such requests
    change nothing. One audit UPDATE row per accepted request, with the images
    before and after that request."""
    now = as_ts(as_of)
    judged = (requests.join(tasks.select(F.col("id").alias("__tid")), requests.id == F.col("__tid"), "left")
              .join(users.select(F.col("id").alias("__uid")), F.col("assigned_to_id") == F.col("__uid"), "left")
              .withColumn("__why", F.when(F.col("__tid").isNull(), S.NOT_FOUND)
                          .when(_too_long("tasks", ["title", "description"]), S.BAD_REQUEST)
                          .when(F.col("assigned_to_id").isNotNull() & F.col("__uid").isNull(), S.FK_VIOLATION)))
    known = judged.where(F.col("__why").isNull()).select(*requests.columns)
    rejected = judged.where(F.col("__why").isNotNull()).select("seq", "id", F.col("__why").alias("reason"))
    parsed = known.withColumn("status", task_status("status")) \
                     .withColumn("priority", task_priority("priority"))
    done = F.max(F.coalesce(F.col("status") == "Completed", F.lit(False))).alias("__done")
    folded = fold_latest(parsed, "id", PATCH_FIELDS, extra_aggs=[done])
    f = folded.select(F.col("id").alias("__fk"), *[F.col(c).alias(f"__new_{c}")
                                                   for c in PATCH_FIELDS], "__done")
    j = tasks.join(f, tasks.id == f["__fk"], "left")
    touched = F.col("__fk").isNotNull()
    cols = []
    for c in tasks.columns:
        if c in PATCH_FIELDS:
            cols.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(touched, now).otherwise(F.col(c)).alias(c))
        elif c == "completed_at":
            cols.append(F.when(F.coalesce(F.col("__done"), F.lit(False)), now)
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    table = j.select(*cols)

    return ChangeSet(table=table, accepted=known, rejected=rejected,
                     audit=lambda: _request_audit(tasks, parsed, IMAGE_FIELDS, now))


def _request_audit(tasks: DataFrame, requests: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """One UPDATE row per request that hits a task, with the images before and
    after that request: per field the running last non-NULL value, up to the
    request and before it, on top of the stored row."""
    scanned = keyed_scan(requests.select("seq", "id", *fields), ["id"], ["seq"],
                         carry={f"__a_{c}": c for c in fields}, carry_before={f"__b_{c}": c for c in fields})
    stored = tasks.select(F.col("id").alias("__sid"), *[F.col(c).alias(f"__s_{c}") for c in IMAGE_FIELDS])
    images = scanned.join(stored, scanned.id == stored.__sid, "inner")

    def image(prefix: str) -> Column:
        return _update_json({c: F.coalesce(F.col(f"{prefix}{c}"), F.col(f"__s_{c}")) if c in fields else F.col(f"__s_{c}")
                             for c in IMAGE_FIELDS})

    return images.select(
        F.lit(S.AUDIT_ENTITY_TASK).alias("entity_name"), F.col("id").alias("entity_id"),
        F.lit(S.AUDIT_UPDATE).alias("action"), image("__b_").alias("old_values"), image("__a_").alias("new_values"),
        F.lit(None).cast("string").alias("performed_by"), now.alias("performed_at"), F.col("seq"))


def _update_json(values: dict[str, Column]) -> Column:
    return json_image(("Title", values["title"]), ("Status", values["status"]),
                      ("Priority", values["priority"]),
                      ("AssignedToId", values["assigned_to_id"]))


def set_task_status(tasks: DataFrame, requests: DataFrame, as_of: AsOf) -> ChangeSet:
    """C3 (procedure form): any status text that fits the column is accepted; a
    'Completed' request stamps completed_at; per request the affected-row count
    (0 or 1). A missing or too long status is a BAD_REQUEST and affects nothing."""
    now = as_ts(as_of)
    every = requests
    bad = F.col("status").isNull() | _too_long("tasks", ["status"])
    rejected = _reject(every.where(bad), S.BAD_REQUEST, ["seq", "id"])
    requests = every.where(~bad)
    per_id = requests.groupBy("id").agg(
        F.max(F.struct("seq", "status")).getField("status").alias("__st"),
        F.max(F.coalesce(F.col("status") == "Completed", F.lit(False))).alias("__done"))
    f = per_id.withColumnRenamed("id", "__fk")
    j = tasks.join(f, tasks.id == f["__fk"], "left")
    touched = F.col("__fk").isNotNull()
    cols = []
    for c in tasks.columns:
        if c == "status":
            cols.append(F.when(touched, F.col("__st")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(touched, now).otherwise(F.col(c)).alias(c))
        elif c == "completed_at":
            cols.append(F.when(F.coalesce(F.col("__done"), F.lit(False)), now)
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    ids = tasks.select(F.col("id").alias("__tid"))
    affected = (every.join(ids, every.id == F.col("__tid"), "left")
                .select("seq", "id", F.when(F.col("__tid").isNotNull() & ~bad, 1).otherwise(0)
                        .cast("long").alias("rows_affected")))
    # The update trigger fires per statement, also where nothing changes.
    return ChangeSet(table=j.select(*cols), accepted=affected, rejected=rejected,
                     audit=lambda: _request_audit(tasks, requests, ["status"], now))


def bulk_update_status(tasks: DataFrame, task_ids: DataFrame, status: str,
                       as_of: AsOf) -> ChangeSet:
    """C4: one status for many ids. An unparseable status rejects the whole
    call (ValueError = BAD_REQUEST); unknown ids are skipped. Returned rows
    carry '' as project name and NULL as assignee name (nothing is loaded)."""
    parsed = enum_literal(status, S.TASK_STATUSES)
    if parsed is None:
        raise ValueError(f"{S.BAD_REQUEST}: invalid status {status!r}")
    now = as_ts(as_of)
    ids = task_ids.select(F.col("id").alias("__bid"))
    hit = tasks.join(ids, tasks.id == F.col("__bid"), "left_semi")
    updated = hit.select(
        *[F.lit(parsed).alias(c) if c == "status"
          else now.alias(c) if c == "updated_at"
          else (now if parsed == "Completed" else F.col(c)).alias(c) if c == "completed_at"
          else F.col(c) for c in tasks.columns])
    touched = F.col("__bid").isNotNull()
    new = {"status": F.lit(parsed), "updated_at": now, **({"completed_at": now} if parsed == "Completed" else {})}
    table = tasks.join(ids.distinct(), tasks.id == F.col("__bid"), "left").select(
        *[F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])
    returned = updated.select(
        "id", "title", "description", "status", "priority", "due_date", "project_id",
        F.lit("").alias("project_name"), "assigned_to_id",
        F.lit(None).cast("string").alias("assigned_to_name"), "created_at", "completed_at")
    audit = hit.select(
        F.lit(S.AUDIT_ENTITY_TASK).alias("entity_name"), F.col("id").alias("entity_id"),
        F.lit(S.AUDIT_UPDATE).alias("action"), audit_update_image().alias("old_values"),
        _update_json({"title": F.col("title"), "status": F.lit(parsed),
                      "priority": F.col("priority"),
                      "assigned_to_id": F.col("assigned_to_id")}).alias("new_values"),
        F.lit(None).cast("string").alias("performed_by"), now.alias("performed_at"))
    return ChangeSet(table=table, accepted=returned, audit=audit)


def delete_tasks(tasks: DataFrame, task_ids: DataFrame, as_of: AsOf) -> ChangeSet:
    """Missing ids are NOT_FOUND, and so is an id asked for again; deleted
    rows produce audit DELETE rows."""
    ids = task_ids.select(F.col("id").alias("__did"))
    gone = tasks.join(ids, tasks.id == F.col("__did"), "left_semi")
    table = tasks.join(ids, tasks.id == F.col("__did"), "left_anti")
    tid = tasks.select(F.col("id").alias("__tid"))
    missing = task_ids.join(tid, task_ids.id == F.col("__tid"), "left_anti")
    return ChangeSet(table=table, accepted=gone,
                     rejected=_reject(missing.unionByName(_repeats(task_ids, tasks)), S.NOT_FOUND, ["id"]),
                     audit=audit_rows(deleted=gone, as_of=as_ts(as_of)))


# =================================================================== projects
def delete_projects(projects: DataFrame, tasks: DataFrame, project_ids: DataFrame,
                    as_of: AsOf) -> ChangeSet:
    """Tasks of a deleted project cascade and produce audit DELETE rows."""
    ids = project_ids.select(F.col("id").alias("__did"))
    existing = projects.join(ids, projects.id == F.col("__did"), "left_semi")
    new_projects = projects.join(ids, projects.id == F.col("__did"), "left_anti")
    # Stored, so that the join with the tasks is of two plain scans: a hot
    # project's partition can be split at run time.
    gone_ids = cache(lambda: stage(existing.select(F.col("id").alias("__gid")), "deleted-projects"))

    def of_gone(how: str) -> DataFrame:
        return tasks.join(gone_ids(), tasks.project_id == F.col("__gid"), how)

    pid = projects.select(F.col("id").alias("__pid"))
    missing = project_ids.join(pid, project_ids.id == F.col("__pid"), "left_anti")
    return ChangeSet(table=new_projects, accepted=existing,
                     rejected=_reject(missing.unionByName(_repeats(project_ids, projects)), S.NOT_FOUND, ["id"]),
                     audit=lambda: audit_rows(deleted=of_gone("left_semi"), as_of=as_ts(as_of)),
                     extra={"tasks": lambda: of_gone("left_anti")})


def create_projects(projects: DataFrame, users: DataFrame, requests: DataFrame,
                    as_of: AsOf, start: Column | None = None) -> ChangeSet:
    """C10 create: a name that is missing or a text that is too long is a
    BAD_REQUEST, an owner that is not a user an FK_VIOLATION; active; ids continue."""
    now = as_ts(as_of)
    judged = (requests.join(users.select(F.col("id").alias("__uid")), requests.owner_id == F.col("__uid"), "left")
              .withColumn("__why", F.when(F.col("name").isNull() | _too_long("projects", ["name", "description"]), S.BAD_REQUEST)
                          .when(F.col("__uid").isNull(), S.FK_VIOLATION)))
    good = judged.where(F.col("__why").isNull()).select(*requests.columns)

    @cache
    def created() -> DataFrame:
        return assign_ids(good, ["seq"], _start(projects, start), out="id").select(
            "id", "name", "description", "owner_id", now.alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(True).alias("is_active"))

    return ChangeSet(table=lambda: projects.unionByName(created()), accepted=created,
                     rejected=judged.where(F.col("__why").isNotNull()).select("seq", "owner_id", F.col("__why").alias("reason")))


def patch_projects(projects: DataFrame, requests: DataFrame, as_of: AsOf) -> ChangeSet:
    """C10 patch: name / description / is_active; NULL = unchanged. Unknown ids
    are NOT_FOUND, texts that are too long a BAD_REQUEST; such requests change nothing."""
    now = as_ts(as_of)
    judged = (requests.join(projects.select(F.col("id").alias("__pid")), requests.id == F.col("__pid"), "left")
              .withColumn("__why", F.when(F.col("__pid").isNull(), S.NOT_FOUND)
                          .when(_too_long("projects", ["name", "description"]), S.BAD_REQUEST)))
    known = judged.where(F.col("__why").isNull()).select(*requests.columns)
    fields = ["name", "description", "is_active"]
    table = _apply_fold(projects, fold_latest(known, "id", fields), "id", fields,
                        extra={"updated_at": now})
    return ChangeSet(table=table, accepted=known,
                     rejected=judged.where(F.col("__why").isNotNull()).select("seq", "id", F.col("__why").alias("reason")))


# ====================================================================== users
def create_users(users: DataFrame, user_roles: DataFrame, roles: DataFrame,
                 requests: DataFrame, as_of: AsOf, start: Column | None = None) -> ChangeSet:
    """A username OR email already taken (case-insensitive, trailing blanks
    ignored) is a CONFLICT, by the table or by an earlier accepted request; the
    outcome is that of handling the requests one by one in ``seq`` order
    (``_first_claims``). A missing or too long value is a BAD_REQUEST. A role id
    that names no role (FK_VIOLATION) or stands twice (CONFLICT) fails the link
    insert, as in the source: the user is made, its links are not. New users are
    Active."""
    now = as_ts(as_of)
    texts = ["username", "email", "password_hash", "first_name", "last_name"]
    bad = F.coalesce(F.greatest(*[F.col(c).isNull() for c in texts], _too_long("users", texts)), F.lit(False))
    r = requests.withColumn("__ku", text_key("username")).withColumn("__ke", text_key("email"))
    taken_u = users.select(text_key("username").alias("__tu"))
    taken_e = users.select(text_key("email").alias("__te"))
    free = (r.where(~bad).join(taken_u, r.__ku == F.col("__tu"), "left_anti")
            .join(taken_e, F.col("__ke") == F.col("__te"), "left_anti"))
    named = ["seq", "username", "email"]
    won = cache(lambda: _first_claims(free.select("seq", F.col("__ku").alias("a"), F.col("__ke").alias("b"))))
    good = cache(lambda: requests.join(won(), "seq", "left_semi").select(*requests.columns))

    @cache
    def failed_links() -> tuple[DataFrame, DataFrame]:
        """Requests of new users with a role that does not exist, and of others with one that stands twice."""
        asked = good().select(*named, F.explode(F.array_distinct("role_ids")).alias("role_id"))
        rid = roles.select(F.col("id").alias("__rid"))
        unknown = asked.join(rid, asked.role_id == F.col("__rid"), "left_anti").select(*named).distinct()
        twice = (good().where(F.size(F.array_distinct("role_ids")) < F.size("role_ids")).select(*named)
                 .join(unknown.select("seq"), "seq", "left_anti").select(*named))
        return unknown, twice

    def rejected() -> DataFrame:
        lost = requests.where(~bad).join(won(), "seq", "left_anti")
        unknown, twice = failed_links()
        return (_reject(requests.where(bad), S.BAD_REQUEST, named).unionByName(_reject(lost, S.CONFLICT, named))
                .unionByName(_reject(unknown, S.FK_VIOLATION, named)).unionByName(_reject(twice, S.CONFLICT, named)))

    @cache
    def created() -> DataFrame:
        return assign_ids(good(), ["seq"], _start(users, start), out="id").select(
            "id", "username", "email", "password_hash", "first_name", "last_name",
            F.lit("Active").alias("status"), now.alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"), "seq", "role_ids")

    @cache
    def links() -> DataFrame:
        unknown, twice = failed_links()
        return (created().select(F.col("id").alias("user_id"), F.explode(F.array_distinct("role_ids")).alias("role_id"), "seq")
                .join(unknown.unionByName(twice).select("seq"), "seq", "left_anti")
                .select("user_id", "role_id", now.alias("assigned_at")))

    new_users = cache(lambda: created().drop("seq", "role_ids"))
    return ChangeSet(table=lambda: users.unionByName(new_users()), accepted=new_users, rejected=rejected,
                     extra={"user_roles": lambda: user_roles.unionByName(links()), "new_links": links})


def _first_claims(claims: DataFrame) -> DataFrame:
    """``seq`` of the winning claims: ``seq, a, b`` claims two keys, and wins if
    no earlier winner has either.

    In a round every claim that is the first open one for both its keys wins, and
    all open claims that share a key with a winner are out, however many. From the
    second round on, claims with one earlier rival alone are decided with it,
    however long the chain: such a claim wins if its rival does not, so the outcome
    at the chain's end (``pointers.follow``) and the parity of the way decide it.
    The earliest open claim always wins, so the rounds end."""
    open_, won, chains = stage(claims, "claims"), claims.select("seq").limit(0), False
    while not open_.isEmpty():
        state = (open_.join(open_.groupBy("a").agg(F.min("seq").alias("ma")), "a")
                 .join(open_.groupBy("b").agg(F.min("seq").alias("mb")), "b"))
        first = (F.col("seq") == F.col("ma")) & (F.col("seq") == F.col("mb"))
        if not chains:
            now = stage(state.where(first).select("seq", "a", "b"), "winners")
        else:
            state = stage(state.select("seq", "a", "b", "ma", "mb"), "claims-round")
            second_a = state.where("seq > ma").groupBy("a").agg(F.min("seq").alias("sa"))
            second_b = state.where("seq > mb").groupBy("b").agg(F.min("seq").alias("sb"))
            one_a, one_b = F.col("seq") == F.col("sa"), F.col("seq") == F.col("sb")
            rival = (F.when(one_a & (F.col("seq") == F.col("mb")), F.col("ma"))
                     .when(one_b & (F.col("seq") == F.col("ma")), F.col("mb"))
                     .when(one_a & one_b & (F.col("ma") == F.col("mb")), F.col("ma")))
            links = (state.join(second_a, "a", "left").join(second_b, "b", "left")
                     .select("seq", rival.alias("to"), F.lit(True).alias("odd"), F.lit(True).alias("sure")).where("to is not null"))
            sure = state.where(first).select("seq")
            even = follow(links).where("not odd").join(sure.select(F.col("seq").alias("to")), "to", "left_semi").select("seq")
            now = stage(state.select("seq", "a", "b").join(sure.unionByName(even), "seq", "left_semi"), "winners")
        won, chains = won.unionByName(now.select("seq")), True
        open_ = stage(open_.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti")
                      .select("seq", "a", "b"), "claims")
    return won


def register_users(users: DataFrame, user_roles: DataFrame, roles: DataFrame,
                   requests: DataFrame, as_of: AsOf) -> ChangeSet:
    """C8, self-registration form: same checks as ``create_users``; every new
    user gets exactly the default User role, whatever the request lists."""
    own = requests.withColumn("role_ids", F.array(
        F.lit(S.SELF_REGISTRATION_ROLE_ID).cast("long")))
    return create_users(users, user_roles, roles, own, as_of)


def patch_users(users: DataFrame, requests: DataFrame, as_of: AsOf) -> ChangeSet:
    """Email / first / last name / status; NULL = unchanged; an
    unparseable status is ignored; unknown ids are NOT_FOUND, texts that are too
    long a BAD_REQUEST. An email that another user has when the request's turn
    comes (by ``seq``, after the accepted requests before it) is a CONFLICT: that
    request changes nothing, the user's other requests stand."""
    now = as_ts(as_of)
    fields = ["email", "first_name", "last_name", "status"]
    judged = requests.join(users.select(F.col("id").alias("__uid")), requests.id == F.col("__uid"), "left").withColumn(
        "__why", F.when(F.col("__uid").isNull(), S.NOT_FOUND)
        .when(_too_long("users", ["email", "first_name", "last_name"]), S.BAD_REQUEST))
    known = judged.where(F.col("__why").isNull()).select(*requests.columns)
    lost = cache(lambda: _email_conflicts(users, known))
    accepted = cache(lambda: known.join(lost(), "seq", "left_anti").select(*requests.columns))

    def table() -> DataFrame:
        folded = fold_latest(accepted().withColumn("status", user_status("status")), "id", fields)
        return _apply_fold(users, folded, "id", fields, extra={"updated_at": now})

    def rejected() -> DataFrame:
        return (judged.where(F.col("__why").isNotNull()).select("seq", "id", F.col("__why").alias("reason"))
                .unionByName(_reject(known.join(lost(), "seq", "left_semi"), S.CONFLICT, ["seq", "id"])))

    return ChangeSet(table=table, accepted=accepted, rejected=rejected)


def _email_conflicts(users: DataFrame, requests: DataFrame) -> DataFrame:
    """``seq`` of the requests whose email another user has at their turn.

    Rounds over the open requests with an email, against a table of who holds the
    emails asked for. All requests for a held email that come before the holder's
    next open request are out at once. A request wins if it is its user's first
    open one and the email is its user's own, or free and no earlier request asks
    for it; the user's old email is free from then on. The earliest open request
    is always decided, so the rounds end.

    From the second round on, requests that wait for one other are decided with it,
    however long the chain (``pointers.follow``): a user's first open request, the
    first for its email, wins if the holder's first open request stands before it
    and wins; it is out if that one is, and the holder has no other before it."""
    asked = requests.where(F.col("email").isNotNull()).select("seq", "id", text_key("email").alias("k"))
    open_ = stage(asked, "email-requests")
    held = stage(users.select(text_key("email").alias("k"), F.col("id").alias("holder"))
                 .join(open_.select("k").distinct(), "k", "left_semi"), "emails")
    lost, chains = open_.select("seq").limit(0), False
    while not open_.isEmpty():
        by_user = open_.groupBy("id").agg(F.min("seq").alias("own_next"))
        by_key = open_.groupBy("k").agg(F.min("seq").alias("key_next"))
        holders = held.join(by_user.select(F.col("id").alias("holder"), F.col("own_next").alias("holder_next")), "holder", "left")
        state = open_.join(holders, "k", "left").join(by_user, "id").join(by_key, "k")
        mine, free = F.col("holder") == F.col("id"), F.col("holder").isNull()
        out = ~mine & (F.col("holder_next").isNull() | (F.col("seq") < F.col("holder_next")))
        wins = (F.col("seq") == F.col("own_next")) & (mine | (free & (F.col("seq") == F.col("key_next"))))
        state = stage(state.select("seq", "id", "k", "holder", "holder_next", "own_next", "key_next",
                                   F.coalesce(wins, F.lit(False)).alias("wins"),
                                   F.coalesce(out, F.lit(False)).alias("out")), "email-round")
        if chains:
            waits = ((F.col("seq") == F.col("own_next")) & (F.col("seq") == F.col("key_next")) & (F.col("holder") != F.col("id"))
                     & (F.col("holder_next") < F.col("seq")))
            second = state.where("seq > own_next").groupBy(F.col("id").alias("holder")).agg(F.min("seq").alias("after"))
            alone = F.coalesce(F.col("after") > F.col("seq"), F.lit(True))
            ends = follow(state.where(waits).join(second, "holder", "left").select(
                "seq", F.col("holder_next").alias("to"), F.lit(False).alias("odd"), alone.alias("sure")))
            end = state.select(F.col("seq").alias("to"), F.col("wins").alias("__w"), F.col("out").alias("__o"))
            told = ends.join(end, "to").select("seq", F.col("__w").alias("also_wins"), (F.col("__o") & F.col("sure")).alias("also_out"))
            state = stage(state.join(told, "seq", "left").select(
                "seq", "id", "k", (F.col("wins") | F.coalesce("also_wins", F.lit(False))).alias("wins"),
                (F.col("out") | F.coalesce("also_out", F.lit(False))).alias("out")), "email-round")
        chains = True
        won = state.where("wins").select("id", "k")
        lost = lost.unionByName(state.where("out").select("seq"))
        held = stage(held.join(won.select(F.col("id").alias("holder")), "holder", "left_anti").select("k", "holder")
                     .unionByName(won.select("k", F.col("id").alias("holder"))), "emails")
        open_ = stage(state.where("not wins and not out").select("seq", "id", "k"), "email-requests")
    return lost


def delete_users(users: DataFrame, projects: DataFrame, user_roles: DataFrame,
                 refresh_tokens: DataFrame, tasks: DataFrame, user_ids: DataFrame,
                 as_of: AsOf) -> ChangeSet:
    """Unknown ids are NOT_FOUND; a user who owns a project is blocked by
    the NO ACTION foreign key (FK_VIOLATION). Otherwise role links and tokens
    cascade and the user's tasks lose their assignee (SET NULL), which the
    update trigger records as audit UPDATE rows."""
    now = as_ts(as_of)
    req = user_ids.select(F.col("id").alias("__rid")).distinct()
    existing = users.join(req, users.id == F.col("__rid"), "left_semi").select("id")
    owners = projects.select(F.col("owner_id").alias("__own"))
    blocked = existing.join(owners, existing.id == F.col("__own"), "left_semi")
    free = existing.join(owners, existing.id == F.col("__own"), "left_anti").select(F.col("id").alias("__gid"))
    # Stored, so that the joins below are of two plain scans: a hot assignee's
    # partition can be split at run time.
    gone = cache(lambda: stage(free, "deleted-users"))
    uid = users.select(F.col("id").alias("__uid"))
    missing = user_ids.join(uid, user_ids.id == F.col("__uid"), "left_anti")

    def without(table: DataFrame, key: str) -> Callable[[], DataFrame]:
        return lambda: table.join(gone(), table[key] == F.col("__gid"), "left_anti")

    def new_tasks() -> DataFrame:
        return tasks.join(gone(), tasks.assigned_to_id == F.col("__gid"), "left").withColumn(
            "assigned_to_id", F.when(F.col("__gid").isNull(), F.col("assigned_to_id"))).select(*tasks.columns)

    def audit() -> DataFrame:
        assigned = tasks.where(F.col("assigned_to_id").isNotNull())
        hit = assigned.join(gone(), assigned.assigned_to_id == F.col("__gid"), "left_semi")
        return hit.select(
            F.lit(S.AUDIT_ENTITY_TASK).alias("entity_name"), F.col("id").alias("entity_id"),
            F.lit(S.AUDIT_UPDATE).alias("action"), audit_update_image().alias("old_values"),
            _update_json({"title": F.col("title"), "status": F.col("status"), "priority": F.col("priority"),
                          "assigned_to_id": F.lit(None).cast("long")}).alias("new_values"),
            F.lit(None).cast("string").alias("performed_by"), now.alias("performed_at"))

    again = _repeats(user_ids, free.select(F.col("__gid").alias("id")))
    rejected = (_reject(missing.unionByName(again), S.NOT_FOUND, ["id"])
                .unionByName(_reject(blocked, S.FK_VIOLATION, ["id"])))
    return ChangeSet(table=without(users, "id"), accepted=free.select(F.col("__gid").alias("id")),
                     rejected=rejected, audit=audit,
                     extra={"user_roles": without(user_roles, "user_id"),
                            "refresh_tokens": without(refresh_tokens, "user_id"), "tasks": new_tasks})


def assign_roles(user_roles: DataFrame, users: DataFrame, roles: DataFrame,
                 requests: DataFrame, as_of: AsOf) -> ChangeSet:
    """C11 assign: an existing link is a CONFLICT, so is a repeat of the same
    link later in the batch; a user or role that does not exist fails the
    foreign key (FK_VIOLATION)."""
    now = as_ts(as_of)
    ur = user_roles.select(F.col("user_id").alias("__u"), F.col("role_id").alias("__r"))
    cond = (requests.user_id == F.col("__u")) & (requests.role_id == F.col("__r"))
    fresh = requests.join(ur, cond, "left_anti")
    dup_existing = requests.join(ur, cond, "left_semi")
    uid = users.select(F.col("id").alias("__uid"))
    rid = roles.select(F.col("id").alias("__rid"))
    valid = (fresh.join(uid, fresh.user_id == F.col("__uid"), "left_semi")
             .join(rid, F.col("role_id") == F.col("__rid"), "left_semi"))
    fk_bad = fresh.join(valid.select(F.col("seq").alias("__v")), fresh.seq == F.col("__v"),
                        "left_anti")
    accepted = valid.groupBy("user_id", "role_id").agg(F.min("seq").alias("seq")).select("seq", "user_id", "role_id")
    repeats = valid.join(accepted.select("seq"), "seq", "left_anti").select("seq", "user_id", "role_id")
    links = accepted.select("user_id", "role_id", now.alias("assigned_at"))
    rejected = (_reject(dup_existing, S.CONFLICT, ["seq", "user_id", "role_id"])
                .unionByName(_reject(repeats, S.CONFLICT, ["seq", "user_id", "role_id"]))
                .unionByName(_reject(fk_bad, S.FK_VIOLATION, ["seq", "user_id", "role_id"])))
    return ChangeSet(table=user_roles.unionByName(links), accepted=links, rejected=rejected)


def remove_roles(user_roles: DataFrame, requests: DataFrame) -> ChangeSet:
    """C11 remove: a link that does not exist (or was already removed earlier
    in the batch) is NOT_FOUND."""
    ur = user_roles.select(F.col("user_id").alias("__u"), F.col("role_id").alias("__r"))
    cond = (requests.user_id == F.col("__u")) & (requests.role_id == F.col("__r"))
    hit = requests.join(ur, cond, "left_semi")
    absent = requests.join(ur, cond, "left_anti")
    removed = hit.groupBy("user_id", "role_id").agg(F.min("seq").alias("seq")).select("seq", "user_id", "role_id")
    repeats = hit.join(removed.select("seq"), "seq", "left_anti").select("seq", "user_id", "role_id")
    gone = removed.select(F.col("user_id").alias("__u2"), F.col("role_id").alias("__r2"))
    table = user_roles.join(gone, (user_roles.user_id == F.col("__u2"))
                            & (user_roles.role_id == F.col("__r2")), "left_anti")
    rejected = (_reject(absent, S.NOT_FOUND, ["seq", "user_id", "role_id"])
                .unionByName(_reject(repeats, S.NOT_FOUND, ["seq", "user_id", "role_id"])))
    return ChangeSet(table=table, accepted=removed, rejected=rejected)


# ===================================================================== tokens
def token_status(refresh_tokens: DataFrame, as_of: AsOf) -> DataFrame:
    """revoked = revoked_at set; expired = as_of >= expires_at; active =
    neither."""
    now = as_ts(as_of)
    revoked = F.col("revoked_at").isNotNull()
    expired = F.coalesce(now >= F.col("expires_at"), F.lit(False))
    return refresh_tokens.select("id", "token", "user_id", revoked.alias("is_revoked"),
                                 expired.alias("is_expired"),
                                 (~revoked & ~expired).alias("is_active"))


def active_tokens_per_user(refresh_tokens: DataFrame, as_of: AsOf) -> DataFrame:
    """Active tokens per user (partial aggregate; users with none are absent)."""
    st = token_status(refresh_tokens, as_of)
    return st.where("is_active").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("long").alias("active_tokens"))

