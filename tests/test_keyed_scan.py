"""The skew-safe keyed scan equals the plain window functions, also when one
key holds most rows and spans many range partitions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from workboard.operators.keyed_scan import assign_ids, keyed_scan
from workboard.operators.rank import count_rank


def _frame(spark, n=4000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.5 else rnd.randint(1, 40)  # key 0 is hot
        if rnd.random() < 0.05:
            key = None
        val = rnd.choice([None, None, "a", "b", "c"])
        rows.append((i, key, rnd.randint(0, 50), val))
    return spark.createDataFrame(rows, "id long, k long, o long, v string")


def test_row_number_and_carry_match_windows(spark):
    df = _frame(spark)
    order = [F.col("o").desc(), F.col("id").asc()]
    got = keyed_scan(df, ["k"], order, row_number="rn", carry={"last_v": "v"},
                     carry_before={"prev_v": "v"}, num_partitions=16)
    w = Window.partitionBy("k").orderBy(*order)
    exp = (df.withColumn("rn", F.row_number().over(w))
           .withColumn("last_v", F.last("v", True).over(
               w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("prev_v", F.last("v", True).over(
               w.rowsBetween(Window.unboundedPreceding, -1))))
    cols = ["id", "rn", "last_v", "prev_v"]
    assert sorted(got.select(cols).collect()) == sorted(exp.select(cols).collect())


def test_hot_key_spans_partitions(spark):
    df = _frame(spark)
    scanned = keyed_scan(df, ["k"], [F.col("o"), F.col("id")], row_number="rn",
                         num_partitions=16)
    # The hot key is cut across several range partitions...
    parts = (df.repartitionByRange(16, F.col("k").asc_nulls_first(), F.col("o"), F.col("id"))
             .where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 3
    # ...and still numbers densely.
    hot = scanned.where("k = 0").agg(F.min("rn"), F.max("rn"), F.count("*")).collect()[0]
    assert hot[0] == 1 and hot[1] == hot[2]


def test_global_ids_dense_in_order(spark):
    df = _frame(spark, n=1000)
    got = assign_ids(df, [F.col("id").desc()], F.lit(100).cast("long"), out="new_id",
                     num_partitions=8)
    rows = got.select("id", "new_id").collect()
    assert sorted(r.new_id for r in rows) == list(range(101, 1101))
    assert all(r.new_id == 100 + (1000 - r.id) for r in rows)


def test_histogram_rank_matches_rank(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 0, 1, 2, 2, 3, 5, 8, 8, 13])) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id long, c long")
    got = count_rank(df, "c", out="rk").select("user_id", "rk")
    exp = df.select("user_id", F.rank().over(Window.orderBy(F.col("c").desc())).alias("rk"))
    assert sorted(got.collect()) == sorted(exp.select("user_id", F.col("rk").cast("long")
                                                      .alias("rk")).collect())


def test_lookup_join_equals_plain_join(spark):
    from workboard.operators.joins import lookup_join
    rnd = random.Random(11)
    rows = [(i, 7 if i % 3 == 0 else rnd.choice([None, 1, 2, 3, 4, 5, 99, -3])) for i in range(3000)]
    fact = spark.createDataFrame(rows, "id long, k long")
    dim = spark.createDataFrame([(k, f"d{k}") for k in [1, 2, 3, 4, 5, 7, *range(-40, 0)]], "dk long, name string")
    for how in ["inner", "left"]:
        got = lookup_join(fact, dim, "k", "dk", how, "id").select("id", "name")
        exp = fact.join(dim, fact.k == dim.dk, how).select("id", "name")
        assert sorted(got.collect()) == sorted(exp.collect())


def test_scan_leaves_nothing_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    keyed_scan(_frame(spark), ["k"], [F.col("o"), F.col("id")], row_number="rn").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_slices_match_windows(spark):
    """Large groups cut by quantiles: by ties, by NULLs, falling orders, several passes."""
    df = _frame(spark).withColumn("t", F.timestamp_seconds(F.when(F.col("o") > 5, F.col("o") % 3)).cast("timestamp_ntz"))
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_last(), F.col("o"), F.col("id").desc())
    got = keyed_scan(df, ["k"], [("t", "desc"), "o", ("id", "desc")], row_number="rn", carry={"last_v": "v"},
                     carry_before={"prev_v": "v"}, num_partitions=64, slice_rows=20)
    exp = (df.withColumn("rn", F.row_number().over(w).cast("long"))
           .withColumn("last_v", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("prev_v", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    cols = ["id", "rn", "last_v", "prev_v"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got.select(cols).collect(), key=key) == sorted(exp.select(cols).collect(), key=key)


def test_slices_are_bounded_and_need_no_range_sampling(spark):
    from workboard.operators import keyed_scan as ks
    df = _frame(spark).withColumns({"i": F.col("id"), "o": F.col("o") % 3})
    cuts = ks._cut(df.select("k", "o", "i"), ["k"], ["o", "i"], 64, 50)
    assert len(cuts) >= 2  # o has three values, so ties are cut by i
    sizes = ks._sliced(df, ["k"], ["o", "i"], cuts).groupBy("k", ks._SLICE).count()
    assert sizes.agg({"count": "max"}).first()[0] <= max(50, -(-4000 // 64))
    got = keyed_scan(df, ["k"], ["o", "id"], row_number="rn", num_partitions=64, slice_rows=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" in plan


def test_global_ids_by_slices(spark):
    df = _frame(spark, n=1000)
    got = keyed_scan(df, [], [("id", "desc")], row_number="rn", num_partitions=100, slice_rows=10)
    assert sorted((r.id, r.rn) for r in got.select("id", "rn").collect()) == [(i, 1000 - i) for i in range(1000)]
