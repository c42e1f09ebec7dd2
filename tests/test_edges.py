"""Edge frames: empty tables, NULL assignees, invalid enums, repeated patches,
in-batch duplicates, JSON escaping, page input checks."""

import pytest
from pyspark.sql import functions as F

from seed import SEED_TIME, seed_frames
from workboard.functions.exprs import conform, parse_enum
from workboard.plans import changes, reports, views
from workboard.sources import schemas as S


def test_empty_tasks_give_zero_row(spark):
    empty = spark.createDataFrame([], S.TASKS)
    assert tuple(reports.task_summary(empty, SEED_TIME).collect()[0]) == (0, 0, 0, 0, 0)
    users, _, _, projects, _ = seed_frames(spark)
    assert tuple(reports.dashboard_stats(empty, projects, users).collect()[0]) == (0, 0, 1, 1, 2, 2)
    assert reports.project_task_report(empty, projects).count() == 0
    rows = reports.user_productivity(empty, users).collect()
    assert {(r.username, r.assigned_tasks, r.rank) for r in rows} == {("admin", 0, 1),
                                                                    ("johndoe", 0, 1)}


def test_all_null_assignees(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    t = tasks.withColumn("assigned_to_id", F.lit(None).cast("long"))
    rows = reports.tasks_with_details(t, projects, users).collect()
    assert len(rows) == 6 and {r.assigned_to_name for r in rows} == {" "}
    assert {r.assigned_to_name for r in views.task_details(t, projects, users).collect()} == {None}


def test_enum_parse(spark):
    df = spark.createDataFrame([(" High ",), ("high",), ("2",), ("9",), ("Low,High",), (None,)],
                               "p string")
    got = [r[0] for r in df.select(parse_enum("p", S.TASK_PRIORITIES)).collect()]
    assert got == ["High", None, "High", None, None, None]


def test_repeated_patches_fold_in_order(spark):
    users, _, _, _, tasks = seed_frames(spark)
    reqs = spark.createDataFrame([
        (1, 4, "T-a", None, "Completed", None, None, None),
        (2, 4, None, None, "Bogus", "nope", None, None),
        (3, 4, None, None, "OnHold", "Low", None, 1),
        (4, 99, None, None, "Completed", None, None, None),
    ], S.TASK_PATCH_REQUESTS)
    cs = changes.patch_tasks(tasks, users, reqs, SEED_TIME)
    row = cs.table.where("id = 4").collect()[0]
    assert (row.title, row.status, row.priority, row.assigned_to_id) == ("T-a", "OnHold", "Low", 1)
    assert row.completed_at == SEED_TIME and row.updated_at == SEED_TIME  # not cleared
    assert [tuple(r) for r in cs.rejected.collect()] == [(4, 99, "NOT_FOUND")]
    audit = sorted(cs.audit.collect(), key=lambda r: r.seq)
    assert len(audit) == 3
    assert audit[0].old_values.startswith('{"Title":"Write API documentation","Status":"Pending"')
    assert audit[1].old_values == audit[1].new_values.replace("T-a", "T-a")  # no-op still audited
    assert audit[2].new_values == ('{"Title":"T-a","Status":"OnHold","Priority":"Low",'
                                   '"AssignedToId":1}')


def test_duplicate_usernames_in_batch_case_insensitive(spark):
    users, roles, user_roles, _, _ = seed_frames(spark)
    reqs = spark.createDataFrame([
        (1, "NewGuy", "a@x.test", "h", "A", "B", [2]),
        (2, "newguy ", "b@x.test", "h", "A", "B", [2]),
        (3, "other", "JOHN@example.test", "h", "A", "B", [1, 1, 7]),
        (4, "third", "c@x.test", "h", "A", "B", [1, 1, 7]),
    ], S.USER_CREATE_REQUESTS)
    cs = changes.create_users(users, user_roles, roles, reqs, SEED_TIME)
    assert sorted((r.id, r.username) for r in cs.accepted.collect()) == [(3, "NewGuy"), (4, "third")]
    # The links of "third" fail as one insert; the user is made.
    assert sorted((r.seq, r.reason) for r in cs.rejected.collect()) == [(2, "CONFLICT"), (3, "CONFLICT"), (4, "FK_VIOLATION")]
    assert sorted((r.user_id, r.role_id) for r in cs.extra["new_links"].collect()) == [(3, 2)]


def test_create_users_one_by_one(spark):
    import random
    users, roles, user_roles, _, _ = seed_frames(spark)
    rnd = random.Random(5)
    rows = [(1, "u1", "e1"), (2, "u1", "e2"), (3, "u3", "e2")]
    rows += [(k, f"n{rnd.randrange(25)}", f"m{rnd.randrange(25)}") for k in range(4, 120)]
    rows += [(k, "hot", f"h{k}") for k in range(200, 260)]
    reqs = spark.createDataFrame([(s, u, f"{e}@x", "h", "A", "B", [2]) for s, u, e in rows], S.USER_CREATE_REQUESTS)
    names, mails, want = set(), set(), set()
    for s, u, e in rows:
        if u not in names and e not in mails:
            names.add(u), mails.add(e), want.add(s)
    cs = changes.create_users(users, user_roles, roles, reqs, SEED_TIME)
    assert {r.seq for r in cs.rejected.collect()} == {s for s, *_ in rows} - want and {1, 3} <= want


def test_patch_users_one_by_one(spark):
    import random
    users, *_ = seed_frames(spark)
    base = users.first().asDict()
    rnd = random.Random(7)
    people = {i: f"p{i}@x" for i in range(1, 13)}
    frame = spark.createDataFrame([{**base, "id": i, "username": f"p{i}", "email": e} for i, e in people.items()], users.schema)
    rows = [(1, 1, "new@x"), (2, 2, "NEW@x "), (3, 3, "free@x"), (4, 4, "p3@x"), (5, 1, "new@X")]
    rows += [(10 + k, rnd.randrange(1, 13), rnd.choice([None, f"p{rnd.randrange(1, 13)}@x", f"q{rnd.randrange(5)}@x"])) for k in range(120)]
    rows += [(500 + k, 1 + k % 12, "hot@x") for k in range(40)]
    now, lost = dict(people), set()
    for s, i, e in rows:
        if e is not None:
            if any(j != i and now[j].rstrip().lower() == e.rstrip().lower() for j in now):
                lost.add(s)
            else:
                now[i] = e
    reqs = spark.createDataFrame([(s, i, e, f"f{s}", None, None) for s, i, e in rows], S.USER_PATCH_REQUESTS)
    cs = changes.patch_users(frame, reqs, SEED_TIME)
    rejected = {r.seq for r in cs.rejected.collect()}
    assert rejected == lost and {r.seq for r in cs.accepted.collect()} == {s for s, *_ in rows} - lost and {2} <= lost and 4 not in lost
    got = {r.id: r for r in cs.table.collect()}
    assert {i: r.email for i, r in got.items()} == now
    last = {i: max(s for s, j, _ in rows if j == i and s not in lost) for i in people}
    assert {i: r.first_name for i, r in got.items()} == {i: f"f{s}" for i, s in last.items()}


def test_patch_tasks_refuses_bad_rows(spark):
    users, _, _, _, tasks = seed_frames(spark)
    reqs = spark.createDataFrame([(1, 1, "x" * 201, None, None, None, None, None), (2, 1, None, None, None, None, None, 999),
                                  (3, 1, "fine", None, None, None, None, None), (4, 99, "y", None, None, None, None, None)], S.TASK_PATCH_REQUESTS)
    cs = changes.patch_tasks(tasks, users, reqs, SEED_TIME)
    assert sorted((r.seq, r.reason) for r in cs.rejected.collect()) == [(1, "BAD_REQUEST"), (2, "FK_VIOLATION"), (4, "NOT_FOUND")]
    assert [r.seq for r in cs.accepted.collect()] == [3] and cs.audit.count() == 1
    assert cs.table.where("id = 1").first().title == "fine"


def test_missing_status_changes_nothing(spark):
    *_, tasks = seed_frames(spark)
    reqs = spark.createDataFrame([(1, 1, None), (2, 2, "z" * 21)], "seq long, id long, status string")
    cs = changes.set_task_status(tasks, reqs, SEED_TIME)
    assert sorted(cs.table.collect()) == sorted(tasks.collect()) and cs.audit.count() == 0
    assert sorted((r.seq, r.reason) for r in cs.rejected.collect()) == [(1, "BAD_REQUEST"), (2, "BAD_REQUEST")]
    assert {r.rows_affected for r in cs.accepted.collect()} == {0}


def test_repeated_delete_is_not_found(spark):
    *_, tasks = seed_frames(spark)
    ids = spark.createDataFrame([(1,), (1,), (1,), (77,)], "id long")
    cs = changes.delete_tasks(tasks, ids, SEED_TIME)
    assert sorted(r.id for r in cs.rejected.collect()) == [1, 1, 77] and cs.accepted.count() == 1


def test_enum_literals_use_ascii_digits():
    from workboard.functions.exprs import enum_literal
    assert enum_literal(" 2 ", S.TASK_STATUSES) == S.TASK_STATUSES[2]
    assert enum_literal("²", S.TASK_STATUSES) is None and enum_literal("99", S.TASK_STATUSES) is None
    assert enum_literal("\tPending", S.TASK_STATUSES) is None


def test_json_escapes_quotes(spark):
    _, _, _, _, tasks = seed_frames(spark)
    t = tasks.where("id = 1").withColumn("title", F.lit('say "hi"'))
    from workboard.plans import audit
    row = audit.audit_snapshot_diff(tasks.limit(0), t, SEED_TIME).collect()[0]
    assert row.new_values.startswith('{"Title":"say \\"hi\\""')


def test_page_inputs_checked(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    with pytest.raises(ValueError):
        views.task_page(tasks, projects, users, page=0, page_size=10)
    with pytest.raises(ValueError):
        views.task_page_info(tasks, page=1, page_size=0)
    info = views.task_page_info(tasks, page=2, page_size=4).collect()[0]
    assert tuple(info) == (6, 2, 4, 2, True, False)


def test_bulk_invalid_status_rejects_call(spark):
    _, _, _, _, tasks = seed_frames(spark)
    with pytest.raises(ValueError):
        changes.bulk_update_status(tasks, tasks.select("id"), "Done", SEED_TIME)


def test_delete_user_blocked_and_set_null(spark):
    users, _, user_roles, projects, tasks = seed_frames(spark)
    tokens = spark.createDataFrame([(1, "t1", 2, SEED_TIME, SEED_TIME, None)], S.REFRESH_TOKENS)
    ids = spark.createDataFrame([(1,), (2,), (42,)], "id long")
    cs = changes.delete_users(users, projects, user_roles, tokens, tasks, ids, SEED_TIME)
    assert sorted(tuple(r) for r in cs.rejected.collect()) == [(1, "FK_VIOLATION"),
                                                                (42, "NOT_FOUND")]
    assert [r.id for r in cs.table.collect()] == [1]
    assert cs.extra["refresh_tokens"].count() == 0
    assert cs.extra["tasks"].where("assigned_to_id IS NOT NULL").count() == 0
    assert cs.audit.count() == 4


def test_conform_defaults(spark):
    raw = spark.createDataFrame([(5, None, "x")], "TotalTasks int, pendingtasks long, junk string")
    got = conform(raw, S.TASK_SUMMARY_REPORT).collect()[0]
    assert tuple(got) == (5, 0, 0, 0, 0)


def test_token_status(spark):
    from datetime import timedelta
    t0 = SEED_TIME
    toks = spark.createDataFrame([
        (1, "a", 1, t0 + timedelta(days=1), t0, None),
        (2, "b", 1, t0 - timedelta(days=1), t0, None),
        (3, "c", 2, t0 + timedelta(days=1), t0, t0),
        (4, "d", 2, t0, t0, None),
    ], S.REFRESH_TOKENS)
    st = {r.id: (r.is_revoked, r.is_expired, r.is_active)
          for r in changes.token_status(toks, t0).collect()}
    assert st == {1: (False, False, True), 2: (False, True, False), 3: (True, False, False),
                  4: (False, True, False)}


def test_keyset_pages_chain_equals_offset_pages(spark):
    from workboard.operators import paging
    from workboard.sources.fixtures import Domain
    from conftest import SF_SMALL
    t = Domain(spark, SF_SMALL).tasks
    order = [F.col("created_at").desc(), F.col("id").desc()]
    after, seen = None, []
    for page in range(1, 4):
        rows = paging.keyset_page(t, ["created_at", "id"], after, 50).collect()
        off = paging.page(t, order, page, 50).collect()
        assert [r.id for r in rows] == [r.id for r in off]
        after = (rows[-1].created_at, rows[-1].id)
        seen += [r.id for r in rows]
    assert len(set(seen)) == 150


def test_audit_history_filters_and_trail(spark):
    from pyspark.sql import Window
    from conftest import SF_SMALL
    from workboard.plans import audit
    from workboard.sources.fixtures import Domain
    logs = Domain(spark, SF_SMALL).audit_logs
    got = audit.audit_history(logs, entity_name="TaskItem", entity_id=7,
                              since="2024-01-05 00:00:00", until="2024-01-25 00:00:00")
    w = Window.partitionBy("entity_name", "entity_id").orderBy(F.col("performed_at").desc(),
                                                              F.col("id").desc())
    exp = (logs.where((F.col("entity_id") == 7)
                      & (F.col("performed_at") >= F.lit("2024-01-05").cast("timestamp_ntz"))
                      & (F.col("performed_at") < F.lit("2024-01-25").cast("timestamp_ntz")))
           .withColumn("trail_position", F.row_number().over(w).cast("long")))
    rows = got.collect()
    assert rows == sorted(rows, key=lambda r: (r.performed_at, r.id), reverse=True)
    assert sorted(rows) == sorted(exp.collect()) and len(rows) > 0


def test_audit_line_format_and_bad_rows(spark):
    from datetime import datetime
    from workboard.plans import audit
    rows = [(1, "TaskItem", 5, "UPDATE", None, None, "user-3", datetime(2024, 1, 2, 3, 4, 5, 600000)),
            (2, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, S.AUDIT_LOGS)
    got = {r.id: r.line for r in audit.audit_lines(df).collect()}
    assert got[1] == "[AUDIT] UPDATE on TaskItem#5 by user-3 at 2024-01-02T03:04:05.600000"
    assert got[2].startswith("[AUDIT] null on null#null by (null) at")  # formatted, not dropped
