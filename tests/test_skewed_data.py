"""Real tables made skewed (one project and one assignee each hold a third of
all tasks): the skew-safe plans equal the naive window / join formulations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from workboard.plans import reports, views
from workboard.sources.fixtures import TASKS_AS_OF, Domain


def _skewed(spark):
    d = Domain(spark, SF_SMALL)
    t = (d.tasks
         .withColumn("project_id", F.when(F.col("id") % 3 == 0, F.lit(0).cast("long"))
                     .otherwise(F.col("project_id")))
         .withColumn("assigned_to_id", F.when(F.col("id") % 3 == 1, F.lit(0).cast("long"))
                     .otherwise(F.col("assigned_to_id"))))
    return d, t


def test_row_numbers_on_hot_project(spark):
    d, t = _skewed(spark)
    got = reports.tasks_with_details(t, d.projects, d.users).select("id", "task_row_num")
    p = d.projects.select(F.col("id").alias("pid"))
    base = t.join(p, t.project_id == p.pid)
    w = Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    exp = base.select("id", F.row_number().over(w).cast("long").alias("task_row_num"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_task_view_and_productivity_on_hot_keys(spark):
    d, t = _skewed(spark)
    got = views.task_details(t, d.projects, d.users).select("id", "project_name", "assigned_to_name")
    p = d.projects.select(F.col("id").alias("pid"), F.col("name").alias("pn"))
    u = d.users.select(F.col("id").alias("uid"), "first_name", "last_name")
    naive = (t.join(p, t.project_id == p.pid, "left").join(u, t.assigned_to_id == u.uid, "left")
             .select("id", F.coalesce("pn", F.lit("")).alias("project_name"),
                     F.when(F.col("uid").isNotNull(),
                            F.concat("first_name", F.lit(" "), "last_name")).alias("assigned_to_name")))
    assert sorted(got.collect()) == sorted(naive.collect())
    prod = reports.user_productivity(t, d.users).select("user_id", "completed_tasks", "rank")
    j = (d.users.where("status = 'Active'")
         .join(t, d.users.id == t.assigned_to_id, "left")
         .groupBy(d.users.id.alias("user_id"))
         .agg(F.sum(F.when(t.status == "Completed", 1).otherwise(0)).cast("long").alias("completed_tasks")))
    exp = j.select("user_id", "completed_tasks",
                   F.rank().over(Window.orderBy(F.col("completed_tasks").desc())).cast("long")
                   .alias("rank"))
    assert sorted(prod.collect()) == sorted(exp.collect())


def test_overdue_on_hot_keys(spark):
    d, t = _skewed(spark)
    got = reports.overdue_tasks(t, d.projects, d.users, TASKS_AS_OF).select("task_id")
    p = d.projects.select(F.col("id").alias("pid"))
    exp = (t.join(p, t.project_id == p.pid)
           .where((F.col("due_date") < F.lit("2000-01-01").cast("timestamp_ntz"))
                  & ~F.col("status").isin("Completed", "Cancelled"))
           .select(F.col("id").alias("task_id")))
    assert sorted(got.collect()) == sorted(exp.collect())
