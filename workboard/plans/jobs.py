"""Change-set batch jobs over stored tables: requests + snapshot -> one folder.

A run reads the stored tasks (with the folders of the earlier runs that count laid
over them) and writes ``<root>/runs/<run_id>``: the new contents of the touched
buckets, the audit rows and the rejected requests. Only the buckets that hold
requested ids are read and written, so a batch costs O(touched buckets), not
O(table). Nothing stored before is changed and every part is written with
``overwrite``: repeating a run, whole or stopped half-way, gives the same folder.
Which runs count, and in which order, is the list that readers pass; a table format
keeps such a list as its log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.operators.keyed_scan import assign_ids
from workboard.plans import changes
from workboard.session import run_scope, stage
from workboard.sources import sinks


def run_folder(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/runs/{run_id}"


def tasks_after(spark: SparkSession, root: str, runs: Sequence[str] = (), only_ids: DataFrame | None = None) -> DataFrame:
    """The tasks after the given runs, in their order."""
    return sinks.read_snapshot(spark, f"{root.rstrip('/')}/tasks", "tasks",
                               [f"{run_folder(root, r)}/tasks" for r in runs], only_ids)


def audit_after(spark: SparkSession, root: str, runs: Sequence[str] = ()) -> DataFrame:
    """The audit rows of the stored table and of the given runs."""
    paths = [f"{root.rstrip('/')}/audit_logs", *(f"{run_folder(root, r)}/audit_logs" for r in runs)]
    out = sinks.read_table(spark, paths[0], "audit_logs")
    for path in paths[1:]:
        out = out.unionByName(spark.read.schema(out.schema).parquet(path).select(*out.columns))
    return out


def _run(spark: SparkSession, root: str, run_id: str, after: Sequence[str], ids: DataFrame,
         change: Callable[[DataFrame], changes.ChangeSet]) -> None:
    """One change set over the stored tasks. Every requested id lies in one bucket,
    so the touched buckets hold all rows that the change can read or write."""
    if run_id in after:
        raise ValueError(f"run {run_id!r} cannot come after itself")
    with run_scope(spark):  # what is staged on the way goes at the end
        out = run_folder(root, run_id)
        cs = change(tasks_after(spark, root, after, only_ids=ids))
        cs.rejected.write.mode("overwrite").parquet(f"{out}/rejected")
        # New identities follow those of the table and of the earlier runs, in request order.
        rows = cs.audit if "seq" in cs.audit.columns else cs.audit.withColumn("seq", F.lit(None).cast("long"))
        kind = F.when(F.col("action") == sinks.S.AUDIT_DELETE, 1).otherwise(0)
        rows = stage(rows.withColumn("kind", kind), "audit")
        top = F.lit(audit_after(spark, root, after).agg(F.max("id")).first()[0] or 0).cast("long")
        numbered = assign_ids(rows, ["seq", "entity_id", "kind"], top, out="id").select(*[f.name for f in sinks.S.AUDIT_LOGS.fields])
        sinks.write_table(numbered, f"{out}/audit_logs", "audit_logs", mode="overwrite")
        buckets = sinks.bucket_count(spark, "tasks", f"{root.rstrip('/')}/tasks")
        sinks.write_touched(spark, "tasks", cs.table, ids, buckets, f"{out}/tasks")


def run_task_patches(spark: SparkSession, root: str, requests: DataFrame, users: DataFrame,
                     as_of: str | datetime, run_id: str, after: Sequence[str] = ()) -> None:
    _run(spark, root, run_id, after, requests.select("id"),
         lambda tasks: changes.patch_tasks(tasks, users, requests, as_of))


def run_task_deletes(spark: SparkSession, root: str, task_ids: DataFrame,
                     as_of: str | datetime, run_id: str, after: Sequence[str] = ()) -> None:
    _run(spark, root, run_id, after, task_ids.select("id"),
         lambda tasks: changes.delete_tasks(tasks, task_ids, as_of))
