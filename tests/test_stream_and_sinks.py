"""T1 stream = batch (and restart adds nothing); copy-on-write sink."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from seed import SEED_TIME
from workboard.operators import paging
from workboard.plans import audit, changes
from workboard.sources import sinks
from workboard.sources.fixtures import TASKS_AS_OF, Domain
from workboard.sources import schemas as S
from workboard.streaming.audit_stream import start_audit_drain, start_checked_drain, start_overdue_check


def test_audit_stream_equals_batch(spark, scratch):
    d = Domain(spark, SF_SMALL)
    logs = d.audit_logs
    src = os.path.join(scratch, "audit_in")
    # Several files: one per action.
    for action in ["INSERT", "UPDATE"]:
        logs.where(F.col("action") == action).write.mode("append").parquet(src)
    sink, ckpt = os.path.join(scratch, "lines"), os.path.join(scratch, "ckpt")
    q = start_audit_drain(spark, src, sink, checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    first = spark.read.parquet(sink)
    batch = audit.audit_lines(logs.where(F.col("action") != "DELETE"))
    assert sorted(first.collect()) == sorted(batch.collect())
    # Rerun with the same checkpoint: nothing new.
    q = start_audit_drain(spark, src, sink, checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    assert spark.read.parquet(sink).count() == first.count()
    # A new file is picked up.
    logs.where(F.col("action") == "DELETE").write.mode("append").parquet(src)
    q = start_audit_drain(spark, src, sink, checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    assert sorted(spark.read.parquet(sink).collect()) == sorted(audit.audit_lines(logs).collect())


def test_copy_on_write_writes_touched_buckets(spark, scratch):
    d = Domain(spark, SF_SMALL)
    path, out = os.path.join(scratch, "tasks"), os.path.join(scratch, "change")
    sinks.write_table(d.tasks, path, "tasks")
    stored = sinks.read_table(spark, path, "tasks")
    some = d.task_patches.where("id % 50 = 0")
    cs = changes.patch_tasks(stored, d.users, some, TASKS_AS_OF)
    sinks.write_touched(spark, "tasks", cs.table, some.select("id"), 64, out)
    assert sorted(sinks.read_snapshot(spark, path, "tasks", [out]).collect()) == sorted(cs.table.collect())
    written = {int(x.split("=")[1]) for x in os.listdir(os.path.join(out, "rows")) if "=" in x}
    assert written == set(sinks.touched_buckets(stored.join(some, "id", "left_semi"), 64)) and len(written) < 64
    assert sorted(sinks.read_table(spark, path, "tasks").collect()) == sorted(stored.collect())


def test_delete_can_empty_a_bucket(spark, scratch):
    d = Domain(spark, SF_SMALL)
    path, out = os.path.join(scratch, "tasks"), os.path.join(scratch, "change")
    sinks.write_table(d.tasks, path, "tasks")
    stored = sinks.read_table(spark, path, "tasks")
    victim = stored.select(sinks.bucket_of(F.col("id"), 64).alias("b")).first().b
    ids = stored.where(sinks.bucket_of(F.col("id"), 64) == victim).select("id")
    cs = changes.delete_tasks(stored, ids, TASKS_AS_OF)
    sinks.write_touched(spark, "tasks", cs.table, ids, 64, out)
    assert sorted(sinks.read_snapshot(spark, path, "tasks", [out]).collect()) == sorted(cs.table.collect())
    assert sinks.read_snapshot(spark, path, "tasks", [out], only_ids=ids).count() == 0


def test_bucket_pruned_read(spark, scratch):
    import contextlib
    import io
    d = Domain(spark, SF_SMALL)
    path = os.path.join(scratch, "tasks")
    sinks.write_table(d.tasks, path, "tasks")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pruned = sinks.read_table(spark, path, "tasks", only_ids=ids)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        pruned.explain(mode="formatted")
    part = [ln for ln in buf.getvalue().splitlines() if "PartitionFilters" in ln]
    assert part and "id_bucket" in part[0] and " IN " in part[0], part
    full = sinks.read_table(spark, path, "tasks")
    assert sorted(pruned.join(ids, "id", "left_semi").collect()) == sorted(
        full.join(ids, "id", "left_semi").collect())
    assert pruned.count() < full.count()


def _drained(spark, path, schema):
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def test_unfit_audit_entries_go_to_quarantine_once(spark, scratch):
    logs = Domain(spark, SF_SMALL).audit_logs
    good = logs.limit(50)
    bad = spark.createDataFrame([
        (900_001, "TaskItem", None, "INSERT", None, "{}", None, SEED_TIME),
        (900_002, "TaskItem", 4, "PATCH", None, "{}", None, SEED_TIME),
        (900_003, "TaskItem", 4, "UPDATE", "{\"a\":", "{}", None, SEED_TIME),
        (900_004, "TaskItem", 4, "UPDATE", "{}", None, None, None)], S.AUDIT_LOGS)
    src, sink, out, ckpt = (os.path.join(scratch, x) for x in ("in", "lines", "quarantine", "ckpt"))
    good.unionByName(bad).write.mode("append").parquet(src)

    def drain():
        start_checked_drain(spark, src, sink, out, checkpoint=ckpt, available_now=True).awaitTermination(300)
        held = _drained(spark, out, "id long, problem string")
        return sorted(map(tuple, held.collect())), _drained(spark, sink, "id long, line string")

    want = [(900_001, "MISSING_VALUE"), (900_002, "UNKNOWN_ACTION"), (900_003, "BROKEN_VALUES"), (900_004, "MISSING_VALUE")]
    held, lines = drain()
    assert held == want and lines.count() == 50
    # The first batch again, as after a crash before its commit: nothing stands twice.
    for name in os.listdir(os.path.join(ckpt, "commits")):
        os.remove(os.path.join(ckpt, "commits", name))
    held, lines = drain()
    assert held == want and lines.count() == 50
    bad.limit(1).withColumn("id", F.lit(900_009).cast("long")).write.mode("append").parquet(src)
    held, lines = drain()
    assert held == sorted([*want, (900_009, "MISSING_VALUE")]) and lines.count() == 50


def test_running_overdue_check_equals_batch(spark, scratch):
    tasks = Domain(spark, SF_SMALL).tasks
    src, out, ckpt = (os.path.join(scratch, x) for x in ("ticks", "overdue", "ckpt"))
    first, times = "1995-01-01 00:00:00", ["1996-01-01 00:00:00", "1997-06-01 00:00:00", "2000-01-01 00:00:00"]
    schema = "id long, title string, project_id long, assigned_to_id long, due_date timestamp_ntz, days_overdue long"
    for k, at in enumerate(times):
        spark.createDataFrame([(at,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("as_of")).write.mode("append").parquet(src)
        for _ in range(2):  # again: no new check time, no new report
            ticks = spark.readStream.schema("as_of timestamp_ntz").parquet(src)
            start_overdue_check(spark, ticks, lambda: tasks, out, first, checkpoint=ckpt, available_now=True).awaitTermination(300)
        got = _drained(spark, os.path.join(out, f"reports/batch={k}"), schema)
        want = audit.overdue_since(tasks, times[k - 1] if k else first, at)
        assert want.count() > 0 and sorted(got.collect()) == sorted(want.collect())
    every = _drained(spark, os.path.join(out, "reports"), schema)
    assert every.count() == every.select("id").distinct().count() == audit.overdue_since(tasks, first, times[-1]).count()


def _scanned_rows(df):
    """Rows that the file scan gave after row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_entity_and_time_filters_skip_row_groups(spark, scratch):
    path = os.path.join(scratch, "audit")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("parquet.block.size", "4096")
    try:
        n = 20_000
        rows = spark.range(n).select(
            "id", F.lit("TaskItem").alias("entity_name"), (F.col("id") * 7919 % 500).alias("entity_id"), F.lit("UPDATE").alias("action"),
            F.lit(None).cast("string").alias("old_values"), F.lit("{}").alias("new_values"), F.lit(None).cast("string").alias("performed_by"),
            F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 4_000_000).cast("timestamp_ntz").alias("performed_at"))
        sinks.write_table(rows, path, "audit_logs")
        entity = sinks.read_audit(spark, path, "TaskItem", 17)
        hours = sinks.read_audit(spark, path, since="2024-01-01 03:00:00", until="2024-01-01 05:00:00")
        assert entity.count() == rows.where("entity_id = 17").count() == n // 500
        assert hours.count() == 2 * 3600 // 4
        assert _scanned_rows(entity) < n / 4 and _scanned_rows(hours) < n / 3
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_of_an_absent_key_reads_no_row_group(spark, scratch):
    path = os.path.join(scratch, "users")
    users = spark.range(5000).select(
        "id", F.concat(F.lit("user-"), F.sha2(F.col("id").cast("string"), 256)).alias("username"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("@x")).alias("email"),
        *[F.lit("x").alias(c) for c in ("password_hash", "first_name", "last_name")], F.lit("Active").alias("status"),
        F.lit(SEED_TIME).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    sinks.write_table(users, path, "users")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = sinks.read_table(spark, path, "users")
        known = users.where("id = 77").first().username
        absent = known[:-1] + "_"  # inside the range of every file's statistics
        assert _scanned_rows(stored.where(F.col("username") == absent)) == 0
        assert stored.where(F.col("username") == known).count() == 1
        assert _scanned_rows(stored.where(F.col("username") == known)) > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_bucketed_task_table_joins_where_it_lies(spark, scratch):
    d = Domain(spark, SF_SMALL)
    spark.sql("drop table if exists bucketed_tasks")
    sinks.save_bucketed(d.tasks, "bucketed_tasks", 16)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "-1")
        cs = changes.patch_tasks(spark.table("bucketed_tasks"), d.users, d.task_patches, TASKS_AS_OF)
        plan = cs.table._jdf.queryExecution().executedPlan().initialPlan().toString()
        # The upper branch of the top join is the task table's.
        upper = plan[plan.index("SortMergeJoin"): plan.index("bucketed_tasks")]
        assert "Exchange" not in upper
        assert sorted(cs.table.collect()) == sorted(changes.patch_tasks(d.tasks, d.users, d.task_patches, TASKS_AS_OF).table.collect())
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
        spark.sql("drop table if exists bucketed_tasks")


def test_anchored_pages_equal_offset_pages(spark):
    tasks = Domain(spark, SF_SMALL).tasks.withColumn("created_at", F.when(F.col("id") % 11 > 0, F.date_trunc("month", "created_at").cast("timestamp_ntz")))
    for order, plain in (([("created_at", "desc"), ("id", "desc")], [F.col("created_at").desc(), F.col("id").desc()]),
                         (["created_at", "id"], [F.col("created_at"), F.col("id")])):
        anchors = paging.page_anchors(tasks, order, slice_rows=100)
        assert anchors.count() > 4
        for page in (1, 2, 37, 60, 75, 1000):
            want = paging.page(tasks, plain, page, 20).select("id").collect()
            assert paging.anchored_page(tasks, order, anchors, page, 20).select("id").collect() == want
