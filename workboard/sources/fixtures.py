"""Map the driver's TPC-H-ish parquet tables onto the seven domain tables.

users <- supplier, projects <- customer, tasks <- orders (+ line items),
audit_logs and refresh_tokens <- events. Request tables of the change-set
jobs are derived from whole tables through attribute predicates (status,
balance, segment), never through id subsets, so every job grows with the
data. The DuckDB oracle (``workboard.oracle``) inlines the same definitions.
Every frame here is a lazy plan; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.functions.exprs import ts_lit
from workboard.sources import schemas as S

# Fixed as_of instants of the fixture (the "now" of each job).
TASKS_AS_OF = "2000-01-01 00:00:00"
TOKENS_AS_OF = "2024-01-15 00:00:00"
PREVIOUS_CHECK = "1999-12-01 00:00:00"
# One entity's audit trail over a time range.
AUDITED_ID = 41
AUDIT_SINCE, AUDIT_UNTIL = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


def _hours_after(base: str, n: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts_lit(base))


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


class Domain:
    """Lazily built domain tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ tables
    @cached_property
    def users(self) -> DataFrame:
        s = self.raw("supplier")
        bal = F.col("s_acctbal")
        return s.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("username"),
            F.concat(F.lower("s_name"), F.lit("@example.test")).alias("email"),
            F.concat(F.lit("hash-"), F.col("s_suppkey").cast("string")).alias("password_hash"),
            F.lit("Supplier").alias("first_name"),
            F.col("s_suppkey").cast("string").alias("last_name"),
            F.when(bal < 0, "Suspended").when(bal < 1000, "Inactive").otherwise("Active")
            .alias("status"),
            _hours_after("1994-01-01 00:00:00", F.col("s_suppkey")).alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"),
        )

    @cached_property
    def roles(self) -> DataFrame:
        rows = [(i, n, d) for i, n, d in S.SEED_ROLES]
        df = self.spark.createDataFrame(rows, "id long, name string, description string")
        return df.withColumn("created_at", ts_lit("1994-01-01 00:00:00"))

    @cached_property
    def user_roles(self) -> DataFrame:
        s = self.raw("supplier")
        at = _hours_after("1994-01-01 00:00:00", F.col("s_suppkey")).alias("assigned_at")
        admins = s.where(F.col("s_acctbal") >= 5000).select(
            F.col("s_suppkey").alias("user_id"), F.lit(1).cast("long").alias("role_id"), at)
        members = s.where(F.col("s_acctbal") >= 0).select(
            F.col("s_suppkey").alias("user_id"), F.lit(2).cast("long").alias("role_id"), at)
        return admins.unionByName(members)

    @cached_property
    def projects(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("description"),
            (F.col("c_custkey") % 10).alias("owner_id"),
            _hours_after("1995-01-01 00:00:00", F.col("c_custkey")).alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        o = self.raw("orders")
        # One row per order: partial + final hash aggregate, then a join on the
        # unique order key (no skew: both sides are unique per key).
        li = (self.raw("lineitem").groupBy("l_orderkey")
              .agg(F.min("l_suppkey").alias("assigned_to_id"),
                   F.max("l_shipdate").alias("due_date")))
        st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
        status = (F.when(st == "F", "Completed")
                  .when((st == "P") & (pr == "4-NOT SPECIFIED"), "OnHold")
                  .when((st == "O") & (pr == "5-LOW"), "Cancelled")
                  .when(st == "O", "InProgress").otherwise("Pending"))
        priority = (F.when(pr == "1-URGENT", "Critical").when(pr == "2-HIGH", "High")
                    .when(pr == "5-LOW", "Low").otherwise("Medium"))
        j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
        return j.select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Task-"), F.col("o_orderkey").cast("string")).alias("title"),
            _null("string").alias("description"),
            status.alias("status"),
            priority.alias("priority"),
            F.col("due_date"),
            F.col("o_custkey").alias("project_id"),
            F.col("assigned_to_id"),
            F.col("o_orderdate").alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"),
            F.when(st == "F", F.col("due_date")).alias("completed_at"),
        )

    @cached_property
    def audit_logs(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        return e.select(
            F.col("event_id").alias("id"),
            F.lit(S.AUDIT_ENTITY_TASK).alias("entity_name"),
            F.col("user_id").alias("entity_id"),
            F.when(et == "signup", "INSERT").when(et == "error", "DELETE").otherwise("UPDATE")
            .alias("action"),
            _null("string").alias("old_values"),
            F.col("props").alias("new_values"),
            F.when(et == "purchase", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
            .alias("performed_by"),
            F.col("ts").alias("performed_at"),
        )

    @cached_property
    def refresh_tokens(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("tok-"), F.col("event_id").cast("string")).alias("token"),
            F.col("user_id"),
            F.timestamp_add("DAY", F.lit(7), F.col("ts")).alias("expires_at"),
            F.col("ts").alias("created_at"),
            F.when(F.col("event_type") == "error", F.timestamp_add("HOUR", F.lit(1), F.col("ts")))
            .alias("revoked_at"),
        )

    # -------------------------------------------------------- request tables
    @cached_property
    def task_creates(self) -> DataFrame:
        c = self.raw("customer")
        seg, bal, key = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_custkey")
        return c.select(
            key.alias("seq"),
            F.when(bal.between(4000, 4200), F.repeat(F.lit("t"), 201))
            .when(~bal.between(4200, 4400), F.concat(F.lit("New-"), key.cast("string"))).alias("title"),
            seg.alias("description"),
            F.when(seg == "BUILDING", "High").when(seg == "AUTOMOBILE", "bogus")
            .when(seg == "MACHINERY", "Critical").when(seg == "HOUSEHOLD", " Low ")
            .otherwise("Low").alias("priority"),
            F.when(bal > 0, ts_lit("2000-06-01 00:00:00")).alias("due_date"),
            F.when(bal < 0, -1 - key).otherwise(key).alias("project_id"),
            F.when(bal > 9000, -1 - key).when(bal > 5000, key % 10).alias("assigned_to_id"),
        )

    @cached_property
    def task_patches(self) -> DataFrame:
        t = self.tasks
        st, pr = F.col("status"), F.col("priority")
        first = t.where(st.isin("Pending", "OnHold")).select(
            (F.col("id") * 2).alias("seq"), "id", _null("string").alias("title"),
            _null("string").alias("description"), _null("string").alias("status"),
            F.lit("High").alias("priority"), _null("timestamp_ntz").alias("due_date"),
            _null("long").alias("assigned_to_id"))
        second = t.where(st.isin("Pending", "OnHold", "InProgress")).select(
            (F.col("id") * 2 + 1).alias("seq"), "id",
            F.when(pr == "Critical", F.concat(F.col("title"), F.lit(" (urgent)"))).alias("title"),
            _null("string").alias("description"),
            F.when(st == "OnHold", "InProgress").when(pr == "Low", "Bogus")
            .when(pr == "Critical", "Completed").otherwise("OnHold").alias("status"),
            F.when(pr == "Low", "nope").alias("priority"),
            F.when(F.col("due_date").isNull(), ts_lit("2000-06-30 00:00:00")).alias("due_date"),
            F.when(F.col("assigned_to_id").isNull(), F.col("project_id") % 10)
            .alias("assigned_to_id"))
        unknown = self.spark.createDataFrame(
            [(-1, -1, None, None, "Completed", None, None, None)], S.TASK_PATCH_REQUESTS)
        refused = t.where((st == "Completed") & pr.isin("Critical", "High")).select(
            (F.col("id") * 2).alias("seq"), "id",
            F.when(pr == "Critical", F.repeat(F.lit("x"), 201)).alias("title"), _null("string").alias("description"),
            F.lit("OnHold").alias("status"), _null("string").alias("priority"), _null("timestamp_ntz").alias("due_date"),
            F.when(pr == "High", -2 - F.col("id")).alias("assigned_to_id"))
        return first.unionByName(second).unionByName(refused).unionByName(unknown)

    @cached_property
    def task_deletes(self) -> DataFrame:
        ids = self.tasks.where(F.col("status") == "Cancelled").select("id")
        ids = ids.unionByName(ids.where(F.col("id") % 50 == 0))  # asked for again
        return ids.unionByName(self.spark.createDataFrame([(-1,)], "id long"))

    @cached_property
    def task_status_sets(self) -> DataFrame:
        """Procedure-form status requests: any text is accepted."""
        t = self.tasks.where((F.col("priority") == "Low") & (F.col("status") == "Pending"))
        reqs = t.select(F.col("id").alias("seq"), "id", F.lit("Archived").alias("status"))
        missing = self.tasks.where((F.col("priority") == "Low") & (F.col("status") == "OnHold")).select(
            F.col("id").alias("seq"), "id", _null("string").alias("status"))
        return reqs.unionByName(missing).unionByName(
            self.spark.createDataFrame([(-1, -1, "Archived")], "seq long, id long, status string"))

    @cached_property
    def bulk_ids(self) -> DataFrame:
        ids = self.tasks.where(F.col("status") == "OnHold").select("id")
        return ids.unionByName(self.spark.createDataFrame([(-1,)], "id long"))

    @cached_property
    def project_deletes(self) -> DataFrame:
        ids = self.projects.where(~F.col("is_active")).select("id")
        return ids.unionByName(self.spark.createDataFrame([(-1,)], "id long"))

    @cached_property
    def user_deletes(self) -> DataFrame:
        ids = self.users.where(F.col("status") != "Active").select("id")
        return ids.unionByName(self.spark.createDataFrame([(-1,)], "id long"))

    @cached_property
    def user_creates(self) -> DataFrame:
        s = self.raw("supplier")
        bal, key = F.col("s_acctbal"), F.col("s_suppkey")
        return s.select(
            key.alias("seq"),
            F.when(bal < 0, F.col("s_name"))
            .otherwise(F.concat(F.lit("new_"), F.col("s_nationkey").cast("string")))
            .alias("username"),
            F.when(bal > 9000, F.concat(F.lower("s_name"), F.lit("@example.test")))
            .otherwise(F.concat(F.lit("u"), key.cast("string"), F.lit("@new.test")))
            .alias("email"),
            F.lit("hash").alias("password_hash"),
            F.lit("New").alias("first_name"),
            key.cast("string").alias("last_name"),
            F.when(bal >= 5000, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
            .otherwise(F.array(F.lit(2).cast("long"))).alias("role_ids"),
        )

    @cached_property
    def user_patches(self) -> DataFrame:
        s = self.raw("supplier")
        bal, key = F.col("s_acctbal"), F.col("s_suppkey")
        reqs = s.where((bal < 1000) | (bal > 9000)).select(
            key.alias("seq"), key.alias("id"),
            F.when(bal > 9000, F.concat(F.lit("vip"), key.cast("string"), F.lit("@example.test")))
            .alias("email"),
            F.when(bal < 0, "Blocked").alias("first_name"),
            _null("string").alias("last_name"),
            F.when(bal < 0, "Bogus").when(bal < 1000, "Active").otherwise("Suspended")
            .alias("status"))
        unknown = self.spark.createDataFrame([(-1, -1, None, "Ghost", None, "Active")],
                                             S.USER_PATCH_REQUESTS)
        # Claims for one new email, and for the emails of two users back (taken,
        # unless that user has left it before).
        claims = s.where(bal.between(1000, 4000)).select(
            (key + 1_000_000).alias("seq"), key.alias("id"),
            F.when(bal < 2500, F.lit("Shared@new.test "))
            .otherwise(F.concat(F.lit("supplier#"), F.lpad((key - 2).cast("string"), 9, "0"), F.lit("@example.test")))
            .alias("email"), F.lit("Claim").alias("first_name"), _null("string").alias("last_name"),
            _null("string").alias("status"))
        return reqs.unionByName(claims).unionByName(unknown)

    @cached_property
    def project_creates(self) -> DataFrame:
        s = self.raw("supplier").where(F.col("s_acctbal") >= 1000)
        return s.select(
            F.col("s_suppkey").alias("seq"),
            F.when(F.col("s_acctbal").between(4000, 4500), F.repeat(F.lit("n"), 101))
            .when(~F.col("s_acctbal").between(4500, 5000), F.concat(F.lit("Proj-"), F.col("s_suppkey").cast("string"))).alias("name"),
            F.when(F.col("s_acctbal").between(5000, 5500), F.repeat(F.lit("d"), 501)).otherwise(F.col("s_name")).alias("description"),
            F.when(F.col("s_acctbal").between(2000, 2500), -F.col("s_suppkey"))
            .otherwise(F.col("s_suppkey")).alias("owner_id"))

    @cached_property
    def project_patches(self) -> DataFrame:
        c = self.raw("customer")
        bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
        reqs = c.where((bal < 0) | (seg == "AUTOMOBILE")).select(
            F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("id"),
            F.when(bal >= 9000, F.repeat(F.lit("n"), 101)).when(bal >= 0, F.upper("c_name")).alias("name"),
            F.when(bal < -900, F.repeat(F.lit("d"), 501)).when(bal < 0, "reactivated").alias("description"),
            F.when(bal < 0, F.lit(True)).alias("is_active"))
        unknown = self.spark.createDataFrame([(-1, -1, "Ghost", None, None)],
                                             S.PROJECT_PATCH_REQUESTS)
        return reqs.unionByName(unknown)

    @cached_property
    def role_assignments(self) -> DataFrame:
        """Active users get Admin; those with a balance under 2000 ask for the
        User role they already hold (CONFLICT)."""
        s = self.raw("supplier").where(F.col("s_acctbal") >= 1000)
        return s.select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("user_id"),
                        F.when(F.col("s_acctbal") < 2000, 2).otherwise(1).cast("long")
                        .alias("role_id"))

    @cached_property
    def role_removals(self) -> DataFrame:
        """Inactive users drop the User role; suspended users ask to drop an
        Admin role they do not hold (NOT_FOUND)."""
        s = self.raw("supplier").where(F.col("s_acctbal") < 1000)
        return s.select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("user_id"),
                        F.when(F.col("s_acctbal") < 0, 1).otherwise(2).cast("long")
                        .alias("role_id"))

    # ----------------------------------------------- staged (unchecked) loads
    @cached_property
    def staged_users(self) -> DataFrame:
        """Users plus the create requests loaded as rows without any checks
        (what a raw bulk load would produce); input of the quality reports."""
        r = self.user_creates
        rows = r.select(
            (F.col("seq") + STAGED_ID_OFFSET).alias("id"), "username", "email", "password_hash",
            "first_name", "last_name", F.lit("Active").alias("status"),
            ts_lit(TASKS_AS_OF).alias("created_at"), _null("timestamp_ntz").alias("updated_at"))
        return self.users.unionByName(rows)

    @cached_property
    def staged_tasks(self) -> DataFrame:
        r = self.task_creates
        rows = r.select(
            (F.col("seq") + STAGED_ID_OFFSET).alias("id"), "title", "description",
            F.lit("Pending").alias("status"), "priority", "due_date", "project_id",
            "assigned_to_id", ts_lit(TASKS_AS_OF).alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"), _null("timestamp_ntz").alias("completed_at"))
        return self.tasks.unionByName(rows)


# Ids of staged rows start above every fixture id.
STAGED_ID_OFFSET = 1_000_000_000


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(spark, sf_dir)


DOMAIN_TABLES = ["users", "roles", "user_roles", "projects", "tasks", "audit_logs",
                 "refresh_tokens"]


def materialize(d: Domain, root: str, concurrency: int = 4) -> None:
    """Write the mapped domain tables with their storage layout (the load
    step of a deployment; queries then read stored tables). The seven writes
    are independent jobs, submitted from a few driver threads so that the
    cluster runs them side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from workboard.sources.sinks import write_table

    # Build the plans on this thread (lazy properties are not thread-safe).
    frames = {t: getattr(d, t) for t in DOMAIN_TABLES}

    def write(t: str) -> None:
        write_table(frames[t], f"{root.rstrip('/')}/{t}", t, mode="overwrite")

    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        list(pool.map(write, DOMAIN_TABLES))


class StoredDomain(Domain):
    """Domain tables read from a materialized root (declared schemas, pruned
    and filtered at the scan); request tables are still derived from the
    driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        super().__init__(spark, sf_dir)
        self.root = root.rstrip("/")
        from workboard.sources.sinks import read_table
        for t in DOMAIN_TABLES:
            self.__dict__[t] = read_table(spark, f"{self.root}/{t}", t)
