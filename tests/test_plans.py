"""Physical-plan checks over every registered query."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from workboard.oracle import SQL
from workboard.plans import audit
from workboard.registry import QUERIES
from workboard.session import stage
from workboard.sources.fixtures import Domain

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF"]


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(fn(spark, SF_SMALL)) for name, fn in QUERIES.items()}


def test_no_python_and_no_cartesian(plans):
    bad = [(name, node) for name, plan in plans.items()
           for node in PYTHON_NODES + ["CartesianProduct", "BroadcastNestedLoopJoin"]
           if node in plan]
    assert not bad, bad


def test_productivity_rank_is_not_a_global_window(plans):
    assert "rank(" not in plans["user_productivity"]


def test_unused_columns_are_pruned(plans):
    for name, plan in plans.items():
        for line in plan.splitlines():
            if line.strip().startswith("ReadSchema") and "o_orderkey" in line:
                assert "o_totalprice" not in line, name
            if line.strip().startswith("ReadSchema") and "l_orderkey" in line:
                assert "l_extendedprice" not in line and "l_quantity" not in line, name


@pytest.fixture()
def unstaged(monkeypatch):
    """The keyed scan's input stays part of the plan, to be looked at."""
    from workboard.operators import keyed_scan
    monkeypatch.setattr(keyed_scan, "stage", lambda df, tag: df)


def test_time_filter_reaches_the_scan(spark, unstaged):
    d = Domain(spark, SF_SMALL)
    plan = plan_of(audit.audit_history(d.audit_logs, since="2024-01-10 00:00:00",
                                       until="2024-01-12 00:00:00"))
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln]
    assert any("GreaterThanOrEqual(ts" in ln and "LessThan(ts" in ln for ln in pushed), pushed


def test_skew_safe_numbering_has_no_single_partition_data_exchange(spark, unstaged):
    d = Domain(spark, SF_SMALL)
    from workboard.plans import reports
    plan = plan_of(reports.tasks_with_details(d.tasks, d.projects, d.users))
    # The only single-partition exchange is over the per-partition summary,
    # which sits under the broadcast of the offsets.
    assert "rangepartitioning(__ks_key" not in plan
    assert "row_number()" in plan


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["project_id", "project_name", "total_tasks", "completed_tasks",
                          "completion_percentage"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) <= set(entry.oracle_sql())


@pytest.fixture()
def shuffled(spark):
    """Shuffle joins only, and a low bar for what counts as a skewed partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            # A partition is split between map outputs: keep several of them here.
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df)


@pytest.mark.parametrize("key", ["project_id", "assigned_to_id"])
def test_hot_lookup_keys_are_split_at_run_time(shuffled, key):
    """A project or an assignee with a third of all tasks: the join's partition is split."""
    from workboard.plans import views
    d = Domain(shuffled, SF_SMALL)
    tasks = d.tasks.withColumn(key, F.when(F.col("id") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col(key)))
    tasks = stage(tasks.crossJoin(shuffled.range(8).select(F.col("id").alias("r")))
                  .withColumn("id", F.col("id") * 8 + F.col("r")).drop("r"), "hot-tasks")
    out = views.task_details(tasks, d.projects, d.users)
    assert "skew=true" in executed(out)


def test_task_view_reads_tasks_once(spark):
    from workboard.plans import views
    d = Domain(spark, SF_SMALL)
    tasks = stage(d.tasks, "tasks-once")
    plan = plan_of(views.task_details(tasks, d.projects, d.users))
    assert sum("tasks-once" in ln for ln in plan.splitlines() if ln.startswith("Location")) == 1


def test_null_keys_do_not_meet_in_one_partition(shuffled):
    from workboard.operators.joins import lookup_join
    fact = shuffled.range(4000).select("id", F.lit(None).cast("long").alias("k"))
    dim = shuffled.range(10).select(F.col("id").alias("dk"), F.lit("x").alias("v"))
    out = lookup_join(fact, dim, "k", "dk", "left", "id")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 2000 and out.where("v is not null").count() == 0
