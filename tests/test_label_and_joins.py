"""Label rule, publication, skewed keys and plan shape."""

from pyspark.sql import functions as F

from prospectra import schema, standins
from prospectra.operators import features, label, publish
from prospectra.operators.joins import _grid, balanced_left_join, hot_keys


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_rule(spark):
    rows = [(1, "T"), (2, "A"), (2, "B"), (3, "T"), (3, "A"), (4, "T"), (4, None), (None, "T"), (None, "A")]
    df = spark.createDataFrame(rows, "accountid long, cnttype_desc string")
    assert [r.accountid for r in label.target_accounts(df, "T").collect()] == [3]
    assert [r.accountid for r in label.target_accounts_by_semi_join(df, "T").collect()] == [3]


def test_label_needs_one_scan(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("accountid"), F.col("o_orderpriority").alias("cnttype_desc"))
    one = plan_of(label.target_accounts(table, "5-LOW"))
    assert one.count("FileScan") == 1 and one.count("Exchange hashpartitioning") == 1
    two = plan_of(label.target_accounts_by_semi_join(table, "5-LOW"))
    assert two.count("FileScan") == 2 and "PushedFilters: [IsNotNull(o_orderpriority)" in two


def test_label_join_keeps_every_customer(spark):
    customers = spark.createDataFrame([(1,), (1,), (2,), (None,)], "client_id long")
    targets = spark.createDataFrame([(1,), (9,)], "accountid long")
    out = features.label_customers(customers, targets).collect()
    assert sorted((r.client_id or 0, r[schema.LABEL]) for r in out) == [(0, 0), (1, 1), (1, 1), (2, 0)]


def test_publication(spark):
    scored = spark.createDataFrame(
        [(1, 0.9, 1), (2, 0.1, 0), (3, 0.5, 1), (4, 0.3, 1), (None, 0.7, 1)], "client_id long, score double, flag int")
    customers = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e")], "client_id long, name string")
    out = publish.prospects(scored, customers)
    assert out.columns == ["client_id", "name", "score", "flag"]
    rows = sorted((r.client_id or 0, r.name or "", r.score) for r in out.collect())
    assert rows == [(0, "", 0.3), (0, "", 0.7), (1, "a", 0.9), (3, "c", 0.5), (3, "d", 0.5)]
    missing = publish.unmatched_prospects(scored, customers).first()
    assert (missing["rows"], missing.lowest, missing.highest) == (2, 0.3, 0.7)


def skewed(spark):
    """60,000 rows: a third NULL, a third one key, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    return spark.range(60_000).select(key.cast("long").alias("k"), F.col("id").alias("payload"))


def test_skewed_join_is_whole(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(7, "hot"), (7, "twice"), (11, "one"), (None, "never")], "rk long, tag string")
    got = balanced_left_join(left, right, "k", "rk").groupBy("tag").count().collect()
    plain = left.join(right, F.col("k") == F.col("rk"), "left").groupBy("tag").count().collect()
    assert sorted(map(str, got)) == sorted(map(str, plain))


def test_skewed_join_spreads_hot_and_null_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.createDataFrame([(7, "hot")], "rk long, tag string")
        sizes = (balanced_left_join(skewed(spark), right, "k", "rk")
                 .groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Eight partitions of 7,500 rows on average; unsalted, one would hold 20,000 or more.
    assert max(r["count"] for r in sizes) < 11_000


def sizes_of(spark, join):
    """Rows per partition of a join that neither broadcasts nor adapts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [r["count"] for r in join().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_identical_left_rows_are_spread(spark):
    left = spark.range(60_000).select(F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.createDataFrame([(7, "hot")], "rk long, tag string")
    sizes = sizes_of(spark, lambda: balanced_left_join(left, right, "k", "rk"))
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 8


def test_a_hot_right_key_is_spread(spark):
    left = spark.range(10_000).select((F.col("id") + 1).alias("k"))
    right = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).cast("long").alias("rk"), F.lit("t").alias("tag"))
    want = left.join(right, F.col("k") == F.col("rk"), "left").count()
    sizes = sizes_of(spark, lambda: balanced_left_join(left, right, "k", "rk"))
    assert sum(sizes) == want == 29_999 and max(sizes) < 2 * want / 8


def test_keys_hot_on_both_sides_give_the_plain_rows_without_many_copies(spark):
    left = spark.range(900).select(F.when(F.col("id") < 300, 7).when(F.col("id") < 500, 8).otherwise(F.col("id")).cast("long").alias("k"), "id")
    right = spark.range(600).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") + 400).cast("long").alias("rk"), F.col("id").alias("rid"))
    got = balanced_left_join(left, right, "k", "rk")
    plain = left.join(right, F.col("k") == F.col("rk"), "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert max(_grid(300, 200, 256)) < 32


def test_publication_filters_before_the_join(spark, sf_dir):
    scored = standins.scored(spark, sf_dir).select("client_id", "score", (F.col("score") > 0.5).cast("int").alias("flag"))
    plan = publish.prospects(scored, standins.customer_360(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "Filter" in plan.split("LeftOuter", 1)[1]


def test_unique_keys_are_not_hot(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    assert hot_keys(df, "k") == []
    hot = df.unionByName(spark.range(100).select(F.lit(7).cast("long").alias("k")))
    assert hot_keys(hot.unionByName(spark.range(50).select(F.lit(None).cast("long").alias("k"))), "k") == [7]
