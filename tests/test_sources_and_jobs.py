"""Files, tables, the whole job chain and streaming requests."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra import schema, session, standins
from prospectra.operators import explain
from prospectra.plans import scoring, tables as table_plans, training
from prospectra.sources import landing, model_store, tables
from prospectra.streaming import requests

CSV = ' Account ID ;CNTTYPE desc;Amount\n1;"say ""hi""";1,5\n2;"two\nlines";\nx;;7\n'


def test_csv_options(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    types = T.StructType().add("account_id", T.LongType()).add("amount", T.DoubleType())
    df = landing.read_csv(spark, str(path), ";", types, multi_line=True)
    assert df.columns == ["account_id", "cnttype_desc", "amount"]
    assert [tuple(r) for r in df.collect()] == [(1, 'say "hi"', None), (2, "two\nlines", None), (None, None, 7.0)]


def test_misfits_are_counted(spark):
    raw = spark.createDataFrame([("1", "2.5", "x"), ("a", None, "y"), ("", "1,5", "z")], "i string, d string, s string")
    types = T.StructType().add("i", T.LongType()).add("d", T.DoubleType()).add("absent", T.LongType())
    assert {r.column_name: r.misfits for r in landing.misfits(raw, types).collect()} == {"i": 2, "d": 1}


def test_csv_inference_and_comma(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Client ID,Name\n1,a\n2,b\n")
    df = landing.read_csv(spark, str(path), ",")
    assert df.schema["client_id"].dataType == T.IntegerType() and df.count() == 2


def test_normalised_names_must_stay_apart(spark):
    with pytest.raises(ValueError, match="a_b"):
        landing.normalize_columns(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))


def test_tables(spark):
    tables.create_schema(spark, "01_staging")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "`go-pay` int, `book_&_movie` string")
    tables.write_table(df, "`01_staging`.t")
    tables.write_table(df, "`01_staging`.t")
    tables.copy_table(spark, "`01_staging`.t", "`01_staging`.u")
    assert tables.preview(tables.read_table(spark, "`01_staging`.u"), "go-pay", 1).collect() == [(1, "a")]
    assert "spark_catalog" in tables.list_catalogs(spark)


def test_a_swapped_table_is_old_or_new(spark):
    spark.sql("create database if not exists swaps")
    first = tables.swap_table(spark.range(3).toDF("x"), "swaps.t")
    before = tables.read_table(spark, "swaps.t")
    assert before.count() == 3

    def fails(_):
        raise ValueError("lost")

    broken = spark.range(9).select(F.udf(fails, "long")("id").alias("x"))
    with pytest.raises(Exception, match="lost"):
        tables.swap_table(broken, "swaps.t")
    assert tables.read_table(spark, "swaps.t").count() == 3
    # New columns come with the new version; a reader of the old one still reads it.
    second = tables.swap_table(spark.range(5).selectExpr("id as x", "'a' as y"), "swaps.t")
    assert tables.read_table(spark, "swaps.t").columns == ["x", "y"] and before.count() == 3
    assert tables.read_table(spark, "swaps.t").count() == 5
    assert tables.swap_back(spark, "swaps.t") == first and tables.read_table(spark, "swaps.t").count() == 3
    with pytest.raises(ValueError, match="no version before"):
        tables.swap_back(spark, "swaps.t")
    third = tables.swap_table(spark.range(7).toDF("x"), "`swaps`.`t`")
    assert tables.versions(spark, "swaps.t") == [first, second, third]      # the first was shown until now
    assert tables.read_table(spark, "swaps.t").count() == 7
    fourth = tables.swap_table(spark.range(8).toDF("x"), "swaps.t")
    assert tables.versions(spark, "swaps.t") == [third, fourth]


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.sql("create database if not exists bucketed")
    a = spark.range(1000).withColumnRenamed("id", "client_id")
    tables.write_table(a.withColumn("x", F.lit(1)), "bucketed.a", bucket_by=(4, "client_id"))
    tables.write_table(a.withColumn("y", F.lit(2)), "bucketed.b", bucket_by=(4, "client_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed.a").join(spark.table("bucketed.b"), "client_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == (named.rstrip("/") if named else session.shared_folder(spark))


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """CSV files to prospects, through every job."""
    sf_dir = "/root/testdata/sf0.01"
    base = tmp_path_factory.mktemp("landing")
    (standins.transactions(spark, sf_dir).withColumnRenamed("cnttype_desc", "CNTTYPE desc")
     .write.option("header", True).option("sep", ";").csv(str(base / "transactions")))
    standins.customer_360(spark, sf_dir).write.option("header", True).csv(str(base / "customers"))
    spark.sql("create database if not exists job")
    names = table_plans.TableNames(*[f"job.{n}" for n in table_plans.TableNames._fields])
    table_plans.ingest(spark, str(base / "transactions"), str(base / "customers"), names)
    table_plans.build_stages(spark, names, standins.TARGET_PRODUCT)
    run_id = training.run_training_job(spark, names.stage2, str(base / "model"), "job.model_runs")
    scoring.run_scoring_job(spark, names, str(base / "model"))
    return names, base, run_id


def test_chain_builds_the_same_tables(spark, chain):
    names, _, _ = chain
    want = standins.stage1_table(spark, "/root/testdata/sf0.01")
    got = spark.table(names.stage1)
    assert got.columns == want.columns and got.count() == 1500
    assert got.agg(F.sum(schema.LABEL)).first()[0] == 331
    assert spark.table(names.stage2).columns == [c for c in want.columns if c not in schema.DROPPED_IN_CLEANING]
    same = got.drop("birth_date").exceptAll(want.drop("birth_date").select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in got.drop("birth_date").schema.fields]))
    assert same.count() == 0


def test_chain_publishes_the_flagged(spark, chain):
    names, _, run_id = chain
    scored = spark.table(names.scored)
    assert scored.columns == ["client_id", "score", "flag"] and scored.count() == 1500
    flagged = scored.where("flag = 1").count()
    published = spark.table(names.prospects)
    assert published.count() == flagged > 0 and published.where("score < 0.2").count() == 0
    assert published.columns == [*schema.CUSTOMER_COLUMNS, "score", "flag"]
    assert model_store.runs(spark, "job.model_runs").where(F.col("run_id") == run_id).count() == 1


def test_training_job_needs_the_label(spark, chain):
    names, base, _ = chain
    with pytest.raises(ValueError, match=schema.LABEL):
        training.run_training_job(spark, names.customers, str(base / "other"))


def test_requests_stream_gives_the_batch_result(spark, chain, tmp_path):
    _, base, _ = chain
    folder = tmp_path / "in"
    folder.mkdir()
    sent = [{"client_id": 1, "gender": "F", "ecomm_counts": 3.0, "travel": 1}, {"client_id": 2, "35-39": 0}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, sent)))
    shape = T.StructType([f for f in schema.customer_schema().fields if f.name in ("client_id", "gender",
                                                                                  "ecomm_counts", "travel", "35-39")])
    saved = model_store.load_model(spark, str(base / "model"))
    query = requests.score_requests(saved.model, requests.read_requests(spark, str(folder), shape),
                                    str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("client_id").collect()
    want = scoring.explain_requests(saved.model, spark.read.schema(shape).json(str(folder))).orderBy("client_id").collect()
    assert got == want and [r.client_id for r in got] == [1, 2]
    assert got[0].segment in ("High", "Medium", "Low") and got[0].explanations[0] == "Age band: 35–39 years."
    assert "Interested in travel & holidays, food & lifestyle." in got[0].explanations


def test_explanations_need_no_shuffle_and_no_python(spark, chain):
    _, base, _ = chain
    saved = model_store.load_model(spark, str(base / "model"))
    out = scoring.explain_requests(saved.model, standins.stage1_table(spark, "/root/testdata/sf0.01"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    last = [r.explanations[-1] for r in out.select("explanations").limit(20).collect()]
    assert all(text.endswith("potential.") for text in last)


def test_key_drivers_and_their_texts(spark):
    fitted = spark.createDataFrame([("Ecomm_Counts", 0.5), ("b", -0.9), ("a", 0.1), ("none", None)], "feature string, coefficient double")
    texts = spark.createDataFrame([("ECOMM_COUNTS", "Buys online."), ("unused", "x")], "feature string, text string")
    drivers = explain.key_drivers(fitted, k=3)
    assert [(r.feature, r["rank"]) for r in drivers.orderBy("rank").collect()] == [("b", 1), ("Ecomm_Counts", 2), ("a", 3)]
    found = {r.feature: r.text for r in explain.driver_texts(drivers, texts).collect()}
    assert found == {"Ecomm_Counts": "Buys online.", "b": "Driver 1: b lowers the score.", "a": "Driver 3: a raises the score."}
    assert explain.driver_texts(drivers).where("text is null").count() == 0
