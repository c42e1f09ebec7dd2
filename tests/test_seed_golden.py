"""Golden answers on the source system's own seed rows (hand-checked)."""

from datetime import timedelta

from pyspark.sql import functions as F

from seed import SEED_TIME, seed_frames
from workboard.plans import audit, changes, reports, views


def test_task_summary_at_seed_time(spark):
    _, _, _, _, tasks = seed_frames(spark)
    r = reports.task_summary(tasks, SEED_TIME).collect()[0]
    assert tuple(r) == (6, 3, 1, 2, 0)


def test_task_summary_ten_days_later(spark):
    _, _, _, _, tasks = seed_frames(spark)
    r = reports.task_summary(tasks, SEED_TIME + timedelta(days=10)).collect()[0]
    assert r.overdue_tasks == 1


def test_project_report(spark):
    _, _, _, projects, tasks = seed_frames(spark)
    rows = reports.project_task_report(tasks, projects).collect()
    assert [tuple(r) for r in rows] == [(1, "Project Alpha", 6, 2, 33.33)]


def test_user_productivity(spark):
    users, _, _, _, tasks = seed_frames(spark)
    rows = reports.user_productivity(tasks, users).collect()
    assert [(r.username, r.assigned_tasks, r.completed_tasks, r.rank) for r in rows] == [
        ("johndoe", 4, 2, 1), ("admin", 0, 0, 2)]


def test_overdue_tasks(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    assert reports.overdue_tasks(tasks, projects, users, SEED_TIME).count() == 0
    later = reports.overdue_tasks(tasks, projects, users, SEED_TIME + timedelta(days=10))
    rows = later.collect()
    assert [(r.title, r.days_overdue, r.assigned_to) for r in rows] == [
        ("Implement user authentication", 3, "John Doe")]


def test_dashboard(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    r = reports.dashboard_stats(tasks, projects, users).collect()[0]
    assert tuple(r) == (6, 2, 1, 1, 2, 2)


def test_tasks_with_details_numbering_and_names(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    rows = reports.tasks_with_details(tasks, projects, users).collect()
    # Same created_at everywhere: the id tie-break numbers newest id first.
    assert {r.id: r.task_row_num for r in rows} == {6: 1, 5: 2, 4: 3, 3: 4, 2: 5, 1: 6}
    # Procedure text: unassigned -> ' '; text priority order Medium, Low, High, Critical.
    assert {r.id: r.assigned_to_name for r in rows}[5] == " "
    assert [r.priority for r in rows] == ["Medium", "Low", "High", "High", "Critical", "Critical"]


def test_bulk_update_then_summary(spark):
    _, _, _, _, tasks = seed_frames(spark)
    ids = spark.createDataFrame([(4,), (5,), (6,)], "id long")
    cs = changes.bulk_update_status(tasks, ids, "InProgress", SEED_TIME)
    assert tuple(reports.task_summary(cs.table, SEED_TIME).collect()[0]) == (6, 0, 4, 2, 0)
    returned = cs.accepted.collect()
    assert {r.project_name for r in returned} == {""}
    assert {r.assigned_to_name for r in returned} == {None}


def test_seed_load_gives_six_insert_audit_rows(spark):
    _, _, _, _, tasks = seed_frames(spark)
    empty = tasks.limit(0)
    rows = audit.audit_snapshot_diff(empty, tasks, SEED_TIME).collect()
    assert len(rows) == 6 and {r.action for r in rows} == {"INSERT"}
    one = [r for r in rows if r.entity_id == 5][0]
    assert one.new_values == ('{"Title":"Performance testing","Status":"Pending",'
                              '"Priority":"High","ProjectId":1,"AssignedToId":null}')


def test_user_overview_roles(spark):
    users, roles, user_roles, _, _ = seed_frames(spark)
    rows = {r.username: r.roles for r in views.user_overview(users, user_roles, roles).collect()}
    assert rows == {"admin": ["Admin"], "johndoe": ["User"]}
    assert "password_hash" not in views.user_overview(users, user_roles, roles).columns


def test_task_view_names(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    rows = {r.id: r for r in views.task_details(tasks, projects, users).collect()}
    assert rows[1].assigned_to_name == "John Doe" and rows[5].assigned_to_name is None
    assert rows[1].project_name == "Project Alpha"
    orphan = tasks.where("id = 1").withColumn("project_id", F.lit(99).cast("long"))
    r = views.task_details(orphan, projects, users).collect()[0]
    assert r.project_name == ""


def test_severity_priority_order_option(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    rows = reports.tasks_with_details(tasks, projects, users, priority_order="severity").collect()
    assert [r.priority for r in rows] == ["Critical", "Critical", "High", "High", "Medium", "Low"]
    # Ties on priority fall back to due date ascending, then id.
    assert [r.id for r in rows[:2]] == [2, 3]
