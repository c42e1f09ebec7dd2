"""Table storage: scan with declared schemas, write with an access-path
layout, and copy-on-write updates that write only touched partitions.

Parquet has no MERGE / UPDATE, so a change set is applied copy-on-write: the new
contents of the partitions that hold touched keys (tasks are partitioned by a hash
bucket of ``id``) go to a folder of their own (``write_touched``), beside the list
of those partitions. Nothing that is stored already is written to, so a job that
stops half-way leaves only an unfinished folder that nobody names, and running it
again writes the same. ``read_snapshot`` reads a table with such folders laid over
it, in the order in which they are named; which of them count is the caller's (or a
table format's) decision.

The bucket count of a bucketed table is stored beside its data when the table is
first written (``_layout/buckets=N``, which readers of the data pass over). Every
later read and write takes it from there; a session that asks for another count
is refused.

Layouts (the source's secondary indexes re-aimed as write-time layout; parquet
min/max statistics then skip row groups):

* tasks: bucket of id as partition, rows sorted by (project_id, status,
  due_date) inside files;
* audit_logs: partitioned by day of performed_at; inside a day the rows follow a
  space-filling curve (interleaved bits of a hash of the entity and of the time of
  day), so that one order serves both indexes of the source: a filter on the entity
  and one on the time each skip row groups (``read_audit``);
* users / projects / tokens: sorted by their lookup keys, with Parquet bloom filters
  on the columns of point lookups (user name, email, token);
* ``save_bucketed``: a catalog table in buckets of its id, which joins on the id
  without moving (change sets against the task table).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from workboard.sources import schemas as S

BUCKET_COL = "id_bucket"
DATE_COL = "performed_date"
ENTITY_COL = "entity_hash"
#: performed_at as an integer: filters on timestamps without a zone do not reach Parquet's statistics.
MICROS_COL = "performed_micros"
#: Bits per dimension of the space-filling curve.
CURVE_BITS = 16


@dataclass(frozen=True)
class Layout:
    partition_by: list[str] = field(default_factory=list)
    sort_by: list[str] = field(default_factory=list)
    buckets: int = 0  # > 0: partition by pmod(xxhash64(id), buckets)
    curve: bool = False  # rows follow the curve of entity and time
    blooms: list[str] = field(default_factory=list)  # columns with a bloom filter


LAYOUTS = {
    "tasks": Layout([BUCKET_COL], ["project_id", "status", "due_date"], buckets=64),
    "audit_logs": Layout([DATE_COL], [], curve=True),
    "users": Layout([], ["id"], blooms=["username", "email"]),
    "projects": Layout([], ["owner_id", "id"]),
    "user_roles": Layout([], ["user_id", "role_id"]),
    "refresh_tokens": Layout([], ["user_id", "id"], blooms=["token"]),
    "roles": Layout([], ["id"]),
}


BUCKETS_CONF = "spark.workboard.tasks.buckets"


def _fs(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it knows it."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hp = _fs(spark, path)
    return fs.exists(hp)


def make_mark(spark: SparkSession, path: str) -> None:
    """An empty folder whose being there is the message."""
    fs, hp = _fs(spark, path)
    fs.mkdirs(hp)


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count kept with a table, None if the folder has none."""
    fs, hp = _fs(spark, f"{path.rstrip('/')}/_layout")
    if not fs.exists(hp):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(hp)]
    return next((int(n.partition("=")[2]) for n in names if n.startswith("buckets=")), None)


def bucket_count(spark: SparkSession, table: str, path: str, new: bool = False) -> int:
    """Buckets of the bucketed table stored at ``path``; 0 for other tables.

    A ``new`` table takes ``spark.workboard.tasks.buckets`` if set (size it so
    one bucket holds about 1-2 GB at the target scale), else the layout default.
    An existing one keeps the count it was written with: a different setting,
    or a folder without the stored count, is an error."""
    lay = LAYOUTS[table]
    if not lay.buckets:
        return 0
    asked = spark.conf.get(BUCKETS_CONF, None)
    if new:
        return int(asked or lay.buckets)
    kept = stored_buckets(spark, path)
    if kept is None:
        raise ValueError(f"{path} holds no bucket count: it was not written by write_table")
    if asked is not None and int(asked) != kept:
        raise ValueError(f"{path} has {kept} buckets, but {BUCKETS_CONF} is {asked}")
    return kept


def bucket_of(id_col, buckets: int):
    return F.pmod(F.xxhash64(id_col.cast("long")), F.lit(buckets)).cast("int")


def with_layout_columns(df: DataFrame, table: str, buckets: int) -> DataFrame:
    lay = LAYOUTS[table]
    if buckets:
        df = df.withColumn(BUCKET_COL, bucket_of(F.col("id"), buckets))
    if DATE_COL in lay.partition_by:
        df = df.withColumn(DATE_COL, F.to_date("performed_at"))
    if lay.curve:
        df = df.withColumns({ENTITY_COL: entity_hash(F.col("entity_name"), F.col("entity_id")),
                             MICROS_COL: F.unix_micros(F.col("performed_at").cast("timestamp"))})
    return df


def entity_hash(name: Column, entity_id: Column) -> Column:
    return F.pmod(F.xxhash64(name, entity_id.cast("long")), F.lit(1 << CURVE_BITS)).cast("int")


def _spread(bits: Column) -> Column:
    """A 16-bit number with a zero between its bits."""
    out = bits.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def curve_place(entity: Column, micros: Column) -> Column:
    """Place on the curve: the bits of the entity's hash and of the time of day in turn."""
    day = 24 * 3600 * 1_000_000
    part = F.floor(F.pmod(micros, F.lit(day)) * (1 << CURVE_BITS) / day)
    return F.shiftleft(_spread(entity), 1).bitwiseOR(_spread(F.coalesce(part, F.lit(0))))


def touched_buckets(ids: DataFrame, buckets: int) -> list[int]:
    """Bucket numbers that hold the given ids (at most the bucket count, so a
    small list of metadata, not data)."""
    return sorted(r["b"] for r in ids.select(bucket_of(F.col("id"), buckets).alias("b")).distinct().collect())


def read_table(spark: SparkSession, path: str, table: str,
               only_ids: DataFrame | None = None) -> DataFrame:
    """Scan with the declared schema (no inference); layout columns are
    dropped so callers see the domain columns only. With ``only_ids`` on a
    bucketed table only the buckets holding those ids are read (partition
    pruning): a change set then reads O(touched buckets), not the table."""
    schema = S.DOMAIN_SCHEMAS[table]
    df = spark.read.parquet(path)
    if only_ids is not None and LAYOUTS[table].buckets:
        buckets = bucket_count(spark, table, path)
        df = df.where(F.col(BUCKET_COL).isin(touched_buckets(only_ids, buckets)))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_audit(spark: SparkSession, path: str, entity_name: str | None = None, entity_id: int | None = None,
               since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored audit rows of an entity and / or a time range. The day prunes
    folders, the entity's hash and the time skip row groups."""
    df = spark.read.parquet(path)
    if entity_name is not None and entity_id is not None:
        df = df.where(F.col(ENTITY_COL) == entity_hash(F.lit(entity_name), F.lit(entity_id)))
    if entity_name is not None:
        df = df.where(F.col("entity_name") == entity_name)
    if entity_id is not None:
        df = df.where(F.col("entity_id") == entity_id)
    if since is not None:
        at = F.lit(since).cast("timestamp_ntz")
        df = df.where((F.col(DATE_COL) >= at.cast("date")) & (F.col(MICROS_COL) >= F.unix_micros(at.cast("timestamp"))))
    if until is not None:
        at = F.lit(until).cast("timestamp_ntz")
        df = df.where((F.col(DATE_COL) <= at.cast("date")) & (F.col(MICROS_COL) < F.unix_micros(at.cast("timestamp"))))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in S.AUDIT_LOGS.fields])


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "id") -> None:
    """A catalog table in ``buckets`` buckets of ``key``, sorted by it. A join on the
    key leaves the table where it is and shuffles the other side alone; size the
    buckets as for the copy-on-write layout."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def _clustered(d: DataFrame, lay: Layout) -> DataFrame:
    """Range-partition on (partition columns, sort columns), then sort within
    each task. A big partition value (a busy day, a large bucket) is cut
    across many write tasks instead of landing in one, each task writes few
    directories, and every file is sorted, which keeps parquet min/max
    statistics tight for skipping."""
    cols = [*lay.partition_by, *lay.sort_by]
    if lay.curve:
        place = "__place"
        d = d.withColumn(place, curve_place(F.col(ENTITY_COL), F.col(MICROS_COL)))
        cols = [*cols, place]
        return d.repartitionByRange(*[F.col(c) for c in cols]).sortWithinPartitions(*cols).drop(place)
    if not cols:
        return d
    return d.repartitionByRange(*[F.col(c) for c in cols]).sortWithinPartitions(*cols)


def write_table(df: DataFrame, path: str, table: str, mode: str = "errorifexists") -> None:
    """Write a whole snapshot with the table's layout."""
    lay, spark = LAYOUTS[table], df.sparkSession
    new = mode != "append" or not path_exists(spark, path)
    buckets = bucket_count(spark, table, path, new)
    w = _clustered(with_layout_columns(df, table, buckets), lay).write.mode(mode)
    for column in lay.blooms:
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if lay.partition_by:
        w = w.partitionBy(*lay.partition_by)
    w.parquet(path)
    if new and buckets:
        make_mark(spark, f"{path.rstrip('/')}/_layout/buckets={buckets}")


def append_rows(df: DataFrame, path: str, table: str) -> None:
    """Insert sink: new rows (created entities, audit rows) are appended."""
    write_table(df, path, table, mode="append")


def write_touched(spark: SparkSession, table: str, new_table: DataFrame, touched_ids: DataFrame, buckets: int,
                  out: str) -> None:
    """Update / delete sink: the new contents of the touched buckets to
    ``out/rows`` and the numbers of all touched buckets, also emptied ones, to
    ``out/buckets``. ``new_table`` is the new snapshot as a lazy plan; ``touched_ids``
    has one ``id`` column."""
    if not LAYOUTS[table].buckets:
        raise ValueError(f"{table} is not bucketed; write a new snapshot instead")
    touched = touched_ids.select(bucket_of(F.col("id"), buckets).alias("bucket")).distinct()
    rows = with_layout_columns(new_table, table, buckets)
    rows = rows.join(touched, rows[BUCKET_COL] == F.col("bucket"), "left_semi")
    _clustered(rows, LAYOUTS[table]).write.mode("overwrite").partitionBy(BUCKET_COL).parquet(f"{out.rstrip('/')}/rows")
    touched.write.mode("overwrite").parquet(f"{out.rstrip('/')}/buckets")


def read_snapshot(spark: SparkSession, path: str, table: str, changes: Sequence[str] = (),
                  only_ids: DataFrame | None = None) -> DataFrame:
    """The table at ``path`` with the folders of ``write_touched`` laid over it, in
    order: each bucket is read from the last folder that touched it. With ``only_ids``
    only the buckets holding those ids are read."""
    fields = S.DOMAIN_SCHEMAS[table].fields
    wanted = set(range(bucket_count(spark, table, path)))
    if only_ids is not None:
        wanted &= set(touched_buckets(only_ids, len(wanted)))
    parts = []
    for folder in reversed(changes):
        root = folder.rstrip("/")
        # At most one row per bucket: metadata, not data.
        own = wanted & {r["bucket"] for r in spark.read.schema("bucket int").parquet(f"{root}/buckets").collect()}
        wanted -= own
        # Known schema: there is no file at all where every touched bucket became empty.
        schema = StructType([*fields, StructField(BUCKET_COL, IntegerType())])
        parts.append(spark.read.schema(schema).parquet(f"{root}/rows").where(F.col(BUCKET_COL).isin(sorted(own))))
    parts.append(spark.read.parquet(path).where(F.col(BUCKET_COL).isin(sorted(wanted))))
    cut = [x.select(*[F.col(f.name).cast(f.dataType) for f in fields]) for x in parts]
    return reduce(DataFrame.unionByName, cut)
