"""End-to-end change-set jobs over stored tables."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from workboard.plans import changes, jobs
from workboard.session import checkpoint_dir, run_scope, stage
from workboard.sources import sinks
from workboard.sources.fixtures import TASKS_AS_OF, Domain, materialize


def test_patch_then_delete_runs(spark, scratch):
    d = Domain(spark, SF_SMALL)
    root = os.path.join(scratch, "domain")
    materialize(d, root)
    files = sorted(os.listdir(os.path.join(root, "tasks")))
    cs = changes.patch_tasks(d.tasks, d.users, d.task_patches, TASKS_AS_OF)
    expected = sorted(cs.table.collect())
    base = jobs.audit_after(spark, root)
    top = base.agg(F.max("id")).first()[0]
    for _ in range(2):  # a repeated run gives the same
        jobs.run_task_patches(spark, root, d.task_patches, d.users, TASKS_AS_OF, run_id="r1")
        assert sorted(jobs.tasks_after(spark, root, ["r1"]).collect()) == expected
        audit = jobs.audit_after(spark, root, ["r1"])
        assert audit.count() == base.count() + cs.audit.count() == audit.select("id").distinct().count()
        assert audit.agg(F.max("id")).first()[0] == top + cs.audit.count()
        n_rejected = spark.read.parquet(f"{jobs.run_folder(root, 'r1')}/rejected").count()
        assert n_rejected == cs.rejected.count() > 1
    # What was stored stays as it was.
    assert sorted(os.listdir(os.path.join(root, "tasks"))) == files
    assert sorted(jobs.tasks_after(spark, root).collect()) == sorted(d.tasks.collect())

    patched = jobs.tasks_after(spark, root, ["r1"])
    dels = spark.createDataFrame(patched.where(F.col("status") == "Cancelled").select("id").collect(), "id long")
    expected = sorted(changes.delete_tasks(patched, dels, TASKS_AS_OF).table.collect())
    jobs.run_task_deletes(spark, root, dels, TASKS_AS_OF, run_id="r2", after=["r1"])
    assert sorted(jobs.tasks_after(spark, root, ["r1", "r2"]).collect()) == expected
    audit = jobs.audit_after(spark, root, ["r1", "r2"])
    assert audit.select("id").distinct().count() == audit.count() == base.count() + cs.audit.count() + dels.count()
    with pytest.raises(ValueError):
        jobs.run_task_deletes(spark, root, dels, TASKS_AS_OF, run_id="r2", after=["r1", "r2"])


def test_emptied_buckets_and_stopped_runs(spark, scratch, monkeypatch):
    d = Domain(spark, SF_SMALL)
    root = os.path.join(scratch, "domain")
    materialize(d, root)
    every = d.tasks.select("id")

    def stop(*a):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(sinks, "write_touched", stop)
        with pytest.raises(RuntimeError):
            jobs.run_task_deletes(spark, root, every, TASKS_AS_OF, run_id="r1")
    assert jobs.tasks_after(spark, root).count() == d.tasks.count()
    jobs.run_task_deletes(spark, root, every, TASKS_AS_OF, run_id="r1")
    assert jobs.tasks_after(spark, root, ["r1"]).count() == 0
    assert jobs.tasks_after(spark, root, ["r1"], only_ids=every.limit(3)).count() == 0


def test_a_run_leaves_no_staged_tables(spark, scratch):
    d = Domain(spark, SF_SMALL)
    root = os.path.join(scratch, "domain")
    materialize(d, root)
    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    jobs.run_task_patches(spark, root, d.task_patches, d.users, TASKS_AS_OF, run_id="r1")
    assert set(os.listdir(base)) == before
    with run_scope(spark) as folder:
        kept = stage(d.users, "kept")
        assert kept.count() == d.users.count() and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_bucket_count_is_kept_with_the_table(spark, scratch):
    d = Domain(spark, SF_SMALL)
    path = os.path.join(scratch, "tasks")
    sinks.write_table(d.tasks, path, "tasks")
    n = d.tasks.count()
    one = d.task_patches.limit(1)
    for asked in ("128", "16"):
        spark.conf.set(sinks.BUCKETS_CONF, asked)
        try:
            with pytest.raises(ValueError):
                sinks.read_snapshot(spark, path, "tasks")
            with pytest.raises(ValueError):
                sinks.read_table(spark, path, "tasks", only_ids=one.select("id"))
        finally:
            spark.conf.unset(sinks.BUCKETS_CONF)
    assert sinks.read_table(spark, path, "tasks").count() == n
