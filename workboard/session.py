"""SparkSession settings the plans are written for.

AQE re-plans at run time (broadcast when a side turns out small, coalesced
partitions, skew-join splitting). The Spark UI stays off. The checkpoint
directory is read from ``spark.checkpoint.dir`` (a shared folder on a
cluster); a caller-given fallback is only used where it is unset, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Broadcast only when the optimizer's size estimate is below the bound;
    # otherwise a shuffle join (AQE may still switch once real sizes are known).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "workboard",
                  shuffle_partitions: int | None = None,
                  checkpoint_fallback: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_fallback)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or \
        spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; set ``fallback`` only where
    it is unset (local tests)."""
    current = checkpoint_dir(spark)
    chosen = current or fallback
    if chosen:
        spark.sparkContext.setCheckpointDir(chosen)
        if not current:
            spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


#: Folder of the run that is under way, below the checkpoint directory.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def _stage_root(spark: SparkSession) -> str:
    root = checkpoint_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        root = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="workboard-"))
    return root.rstrip("/")


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Everything that ``stage`` writes inside goes below one folder, which is
    removed at the end. Write or collect the results inside; a frame that was
    planned inside and is read later has lost its staged tables."""
    if _RUN.get() is not None:  # the outer run removes what is staged here
        yield _RUN.get()
        return
    folder = f"{_stage_root(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a folder of its own under ``spark.checkpoint.dir`` and
    read it back: the lineage ends there, on storage that all executors share.
    A local session without the setting gets a folder once. Inside a
    ``run_scope`` the folder goes with the run."""
    spark = df.sparkSession
    path = f"{_RUN.get() or _stage_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
