"""Stand-in views over the test tables, shaped like the engine's own inputs.

``transactions`` plays the policy-transaction table, ``customer_360`` the wide
customer table and ``scored`` a table of labels and scores.  The column
expressions are plain SQL that Spark and DuckDB both read, so the same text
feeds the engine and the SQL check.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.operators import features, label
from prospectra.session import write_and_read_back

TARGET_PRODUCT = "Brand#11 PROMO"


def _flag(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def _count(condition: str) -> str:
    return f"cast(sum({_flag(condition)}) as double)"


def _any(condition: str) -> str:
    return f"max({_flag(condition)})"


_LOW = "o_orderpriority = '5-LOW' and o_orderstatus"

# Per customer key, over orders.  o_orderkey is the primary key of orders, so
# counting it equals counting distinct keys and keeps the one-pass partial
# aggregation; the SQL check counts distinct keys.
ORDER_AGGREGATES: dict[str, str] = {
    "policy_counts": "cast(count(o_orderkey) as double)",
    "customer_vintage_in_month":
        "cast((2002 - year(min(o_orderdate))) * 12 + 1 - month(min(o_orderdate)) as double)",
    "agency_counts": _count("o_orderpriority = '1-URGENT'"),
    "ecomm_counts": _count("o_orderpriority = '2-HIGH'"),
    "accident_counts": _count("o_orderpriority = '3-MEDIUM'"),
    "cl_counts": _count("o_orderpriority = '4-NOT SPECIFIED'"),
    "rpul_counts": _count(f"{_LOW} = 'O'"),
    "spul_counts": _count(f"{_LOW} = 'F'"),
    "traditional_counts": _count(f"{_LOW} = 'P'"),
    "credit_card_payment": _any("o_orderkey % 7 = 0"),
    "bank_transfer_payment": _any("o_orderkey % 11 = 0"),
    "auto_debet_payment": _any("o_orderkey % 13 = 0"),
    "yearly_payment": _any("month(o_orderdate) = 1"),
    "halfyearly_payment": _any("month(o_orderdate) = 6"),
    "quarterly_payment": _any("month(o_orderdate) = 3"),
    "monthly_payment": _any("month(o_orderdate) = 2"),
    "single_payment": _any("month(o_orderdate) = 12"),
    "ape_raw": "cast(sum(cast(o_totalprice as decimal(18,2))) as double)",
    "inforce_counts": _count("o_orderstatus = 'O'"),
    "lapse_counts": _count("o_orderstatus = 'F'"),
    "fwd_max_flag": _flag("count(o_orderkey) >= 12"),
    **{name: _any(f"o_orderkey % {prime} = 0") for name, prime in zip(
        ("automotive", "book_&_movie", "children", "culinary", "fashion", "gadget", "gasoline", "go-pay",
         "health", "home_expense", "music", "property", "shopping", "sport", "style", "travel"),
        (17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79))},
}


def _yes_no(divisor: int) -> str:
    return f"case when c_custkey % {divisor} = 0 then 'YES' else 'NO' end"


# Per customer row, after the aggregates are joined.
CUSTOMER_EXPRESSIONS: dict[str, str] = {
    "client_id": "c_custkey",
    "birth_date": "cast('1970-01-01' as date)",
    "insured_age": "cast(null as double)",
    "gender": "case when c_custkey % 2 = 0 then 'M' else 'F' end",
    "marital_status": "case when c_custkey % 17 = 0 then null else c_mktsegment end",
    "black_list": _yes_no(50),
    "occupancy": "concat('OC', cast(c_nationkey as string))",
    "fatca": _yes_no(40),
    "isfatcacrs": _yes_no(45),
    "fatca_indicia": _yes_no(60),
    "le17": _flag("c_acctbal < 0"),
    "18-21": _flag("c_acctbal >= 0 and c_acctbal < 1500"),
    "22-27": _flag("c_acctbal >= 1500 and c_acctbal < 3000"),
    "28-34": _flag("c_acctbal >= 3000 and c_acctbal < 4500"),
    "35-39": _flag("c_acctbal >= 4500 and c_acctbal < 6000"),
    "40-49": _flag("c_acctbal >= 6000 and c_acctbal < 8000"),
    "ge50": _flag("c_acctbal >= 8000"),
    "ape_sums": "case when c_custkey % 23 = 0 then null "
                "when c_custkey % 29 = 0 then cast('NaN' as double) "
                "when c_custkey % 31 = 0 then cast('Infinity' as double) else ape_raw end",
}

# One-variable linear score used where a check in SQL needs given weights.
LINEAR_WEIGHTS = {
    "ecomm_counts": 0.30,
    "yearly_payment": 0.25,
    "bank_transfer_payment": 0.10,
    "lapse_counts": -0.20,
}
LINEAR_INTERCEPT = -1.50
# Texts that a caller gives for some drivers; the rest get a sentence of their own.
DRIVER_TEXTS = {"ECOMM_counts": "Buys online.", "lapse_counts": "Let policies lapse."}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accountid, cnttype_desc, order_id), one row per order line."""
    part = _read(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_brand", F.lit(" "), "p_type").alias(schema.PRODUCT))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias(schema.ACCOUNT), schema.PRODUCT,
                    F.col("o_orderkey").alias("order_id")))


def customer_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 54-column customer table."""
    per_customer = (_read(spark, sf_dir, "orders").groupBy("o_custkey")
                    .agg(*[F.expr(sql).alias(name) for name, sql in ORDER_AGGREGATES.items()]))
    joined = _read(spark, sf_dir, "customer").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(*[
        F.expr(CUSTOMER_EXPRESSIONS[c]).alias(c) if c in CUSTOMER_EXPRESSIONS else F.col(c)
        for c in schema.CUSTOMER_COLUMNS])


def customer_360_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table as a stored one, as the joins expect it: they look at its keys first."""
    return _stored_customers(spark.sparkContext.applicationId, sf_dir)


@functools.cache
def _stored_customers(application: str, sf_dir: str) -> DataFrame:
    return write_and_read_back(customer_360(SparkSession.active(), sf_dir), "customer-360")


def stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table with the label."""
    targets = label.target_accounts(transactions(spark, sf_dir), TARGET_PRODUCT)
    return features.feature_table(customer_360_table(spark, sf_dir), targets)


def stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clean_features(stage1(spark, sf_dir))


def stage1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 as a stored table, which is what all later steps read.  Built
    once per application and test set."""
    return _stored(spark.sparkContext.applicationId, sf_dir)


def stage2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clean_features(stage1_table(spark, sf_dir))


@functools.cache
def _stored(application: str, sf_dir: str) -> DataFrame:
    return write_and_read_back(stage1(SparkSession.active(), sf_dir), "stage1")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, y, score_i, score): labels with a score of known quality and many ties."""
    label_col = F.col(schema.LABEL)
    score_i = ((F.col(schema.ID) * 37) % 101 + 30 * label_col).cast("bigint")
    return (stage1_table(spark, sf_dir)
            .select(schema.ID, label_col.alias("y"), score_i.alias("score_i"))
            .withColumn(schema.SCORE, F.col("score_i").cast("double") / F.lit(131.0)))
