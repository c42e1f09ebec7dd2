"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; all executors share it.

    Only a local session (tests) may leave it unset; it then gets a folder of
    its own, once.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        path = tempfile.mkdtemp(prefix="workboard-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what came
    before) and gives the next join a plain scan with a known size, which
    adaptive execution can broadcast or split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`stored` gave, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, and faster, on pure ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def whole_text(text: Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; with the id they name a document row."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when a lambda inside uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different rows of ``df``, those with the smallest hash of all their columns.

    The same rows under any partitioning: equal hashes are ordered by the columns, and
    repeated rows count once. Rows with a null in some column are hashed by the
    others, so that nulls have no advantage. A filter on the hash leaves little more
    than ``rows`` before the ordering, so each task and the driver see a bounded number
    whatever the size of the table.
    """
    spot = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40))
    n = df.count()
    if n > rows:
        share = min(1.0, rows / n * 1.1 + 20 / n)
        df = df.filter(spot < int(share * (1 << 40)))
    return df.distinct().orderBy(spot, *df.columns).limit(rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
