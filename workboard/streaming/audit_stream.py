"""The audit drain and the overdue check as Structured Streaming jobs.

The source drained an in-memory queue every 5 seconds and logged one line per
entry. Here the audit rows land as files in a directory; a file-stream source
picks up new files, ``audit_lines`` formats them (same expression as the batch
form, so stream output equals batch output), and a file sink with a
checkpoint makes the drain exactly-once and restartable: a rerun after a crash
or executor loss resumes from the checkpoint and never duplicates a line. No
state is kept between micro-batches, and a malformed row never stops the
drain (it formats with NULL parts).

``start_checked_drain`` has two sinks: entries that are unfit for the log (a missing
value, an unknown action, values that are no JSON) go to a quarantine with the
reason, all others become lines. Each micro-batch writes one folder per sink, named
by its batch id, and writes it anew if the batch is repeated after a failure: no
entry is lost or stands twice.

``start_overdue_check`` is the periodic check: every batch of a stream of check times
reports the tasks whose due time passed since the last check. The check times done
are kept per batch id beside the reports, so a repeated batch starts from the same
mark and writes the same report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from workboard.plans.audit import audit_lines, audit_problem, overdue_since
from workboard.session import checkpoint_dir
from workboard.sources import schemas as S

DRAIN_INTERVAL = "5 seconds"


def audit_line_stream(spark: SparkSession, source_dir: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.AUDIT_LOGS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return audit_lines(reader.parquet(source_dir))


def start_audit_drain(spark: SparkSession, source_dir: str, sink_dir: str,
                      checkpoint: str | None = None, available_now: bool = False,
                      interval: str = DRAIN_INTERVAL) -> StreamingQuery:
    """Start the drain. ``checkpoint`` defaults to a folder under the
    session's ``spark.checkpoint.dir`` (a shared folder on a cluster)."""
    if checkpoint is None:
        base = checkpoint_dir(spark)
        if not base:
            raise ValueError("no checkpoint location: set spark.checkpoint.dir")
        checkpoint = base.rstrip("/") + "/audit_drain"
    lines = audit_line_stream(spark, source_dir)
    writer = (lines.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=interval)
    return writer.start(sink_dir)


def _checkpoint(spark: SparkSession, checkpoint: str | None, name: str) -> str:
    if checkpoint is not None:
        return checkpoint
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("no checkpoint location: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}"


def _start(writer, available_now: bool, interval: str) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def _batch_folder(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def split_audit_batch(logs: DataFrame, sink_dir: str, quarantine_dir: str, batch_id: int) -> None:
    """One micro-batch into both sinks; repeating it replaces what it wrote."""
    judged = logs.withColumn("problem", audit_problem())
    good = judged.where("problem is null").drop("problem")
    audit_lines(good).write.mode("overwrite").parquet(_batch_folder(sink_dir, batch_id))
    judged.where("problem is not null").write.mode("overwrite").parquet(_batch_folder(quarantine_dir, batch_id))


def start_checked_drain(spark: SparkSession, source_dir: str, sink_dir: str, quarantine_dir: str,
                        checkpoint: str | None = None, available_now: bool = False,
                        interval: str = DRAIN_INTERVAL) -> StreamingQuery:
    """The drain with a quarantine for entries that are unfit for the log."""
    logs = spark.readStream.schema(S.AUDIT_LOGS).parquet(source_dir)
    writer = (logs.writeStream.option("checkpointLocation", _checkpoint(spark, checkpoint, "checked_drain"))
              .foreachBatch(lambda batch, i: split_audit_batch(batch, sink_dir, quarantine_dir, i)))
    return _start(writer, available_now, interval)


CHECK_INTERVAL = "60 seconds"


def report_overdue(tasks: DataFrame, ticks: DataFrame, report_dir: str, batch_id: int, first: str) -> None:
    """One check: tasks that fell due between the mark of earlier batches (``first``
    if there is none) and the latest check time of this one."""
    spark = tasks.sparkSession
    marks = f"{report_dir.rstrip('/')}/marks"
    now = ticks.agg(F.max("as_of").alias("as_of")).where("as_of is not null")
    now.write.mode("overwrite").parquet(_batch_folder(marks, batch_id))
    seen = spark.read.schema("as_of timestamp_ntz, batch long").parquet(marks)
    row = seen.agg(F.max(F.when(F.col("batch") < batch_id, F.col("as_of"))).alias("last"),
                   F.max(F.when(F.col("batch") == batch_id, F.col("as_of"))).alias("now")).first()
    last, upto = row["last"] or first, row["now"]
    due = overdue_since(tasks, last, upto) if upto is not None else overdue_since(tasks, last, last)
    due.write.mode("overwrite").parquet(_batch_folder(f"{report_dir.rstrip('/')}/reports", batch_id))


def start_overdue_check(spark: SparkSession, ticks: DataFrame, load_tasks, report_dir: str, first: str,
                        checkpoint: str | None = None, available_now: bool = False,
                        interval: str = CHECK_INTERVAL) -> StreamingQuery:
    """T2 as a running check. ``ticks`` is a stream with a column ``as_of``
    (timestamp_ntz): the check times, for instance of a rate source.
    ``load_tasks()`` gives the tasks as they are at a check; reports and marks go
    below ``report_dir``."""
    writer = (ticks.writeStream.option("checkpointLocation", _checkpoint(spark, checkpoint, "overdue_check"))
              .foreachBatch(lambda batch, i: report_overdue(load_tasks(), batch, report_dir, i, first)))
    return _start(writer, available_now, interval)
