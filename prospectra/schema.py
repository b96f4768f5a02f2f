"""Column names, kinds and defaults of the customer and transaction tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Feature(NamedTuple):
    name: str
    kind: str  # "id", "num", "cat" or "flag"
    default: object


# Names, order, kinds and defaults of the scoring input.  They
# must equal those of existing tables and saved scoring requests.
FEATURES: tuple[Feature, ...] = (
    Feature("client_id", "id", 1),
    Feature("gender", "cat", "M"),
    Feature("marital_status", "cat", "Single"),
    Feature("black_list", "cat", "NO"),
    Feature("occupancy", "cat", "IN24"),
    Feature("fatca", "cat", "NO"),
    Feature("isfatcacrs", "cat", "NO"),
    Feature("fatca_indicia", "cat", "NO"),
    Feature("le17", "flag", 0),
    Feature("18-21", "flag", 0),
    Feature("22-27", "flag", 0),
    Feature("28-34", "flag", 0),
    Feature("35-39", "flag", 1),
    Feature("40-49", "flag", 0),
    Feature("ge50", "flag", 0),
    Feature("customer_vintage_in_month", "num", 24.0),
    Feature("agency_counts", "num", 1.0),
    Feature("ecomm_counts", "num", 1.0),
    Feature("accident_counts", "num", 0.0),
    Feature("cl_counts", "num", 0.0),
    Feature("rpul_counts", "num", 0.0),
    Feature("spul_counts", "num", 0.0),
    Feature("traditional_counts", "num", 1.0),
    Feature("credit_card_payment", "flag", 0),
    Feature("bank_transfer_payment", "flag", 1),
    Feature("auto_debet_payment", "flag", 0),
    Feature("yearly_payment", "flag", 1),
    Feature("halfyearly_payment", "flag", 0),
    Feature("quarterly_payment", "flag", 0),
    Feature("monthly_payment", "flag", 0),
    Feature("single_payment", "flag", 0),
    Feature("ape_sums", "num", 15000000.0),
    Feature("inforce_counts", "num", 2.0),
    Feature("lapse_counts", "num", 0.0),
    Feature("fwd_max_flag", "flag", 1),
    Feature("automotive", "flag", 0),
    Feature("book_&_movie", "flag", 0),
    Feature("children", "flag", 0),
    Feature("culinary", "flag", 1),
    Feature("fashion", "flag", 0),
    Feature("gadget", "flag", 0),
    Feature("gasoline", "flag", 0),
    Feature("go-pay", "flag", 0),
    Feature("health", "flag", 0),
    Feature("home_expense", "flag", 0),
    Feature("music", "flag", 0),
    Feature("property", "flag", 0),
    Feature("shopping", "flag", 0),
    Feature("sport", "flag", 0),
    Feature("style", "flag", 0),
    Feature("travel", "flag", 0),
)

# Column names that existing tables use.
ID = "client_id"
LABEL = "is_target_customer"
ACCOUNT = "accountid"
PRODUCT = "cnttype_desc"
SCORE = "score"
FLAG = "flag"
DROPPED_IN_CLEANING = ("birth_date", "insured_age", "policy_counts")
ID_CANDIDATES = ("client_id", "customer_id", "accountid", "customer_number")

# Cut-offs that scored tables and segments are built on.
FLAG_THRESHOLD = 0.2
HIGH_THRESHOLD = 0.5
CLASS_THRESHOLD = 0.5

FEATURE_NAMES = tuple(f.name for f in FEATURES)

_SPARK_TYPE = {"id": T.LongType(), "num": T.DoubleType(), "cat": T.StringType(), "flag": T.IntegerType()}

# Position, in the customer table, of the columns that cleaning drops.
_BEFORE = {"gender": (("birth_date", T.DateType()), ("insured_age", T.DoubleType())),
           "customer_vintage_in_month": (("policy_counts", T.DoubleType()),)}


def customer_schema() -> T.StructType:
    """The wide customer table: the scoring columns and the three dropped ones."""
    out = T.StructType()
    for feature in FEATURES:
        for name, dtype in _BEFORE.get(feature.name, ()):
            out = out.add(name, dtype)
        out = out.add(feature.name, _SPARK_TYPE[feature.kind])
    return out


def transaction_schema() -> T.StructType:
    """The two transaction columns that are ever read."""
    return T.StructType().add(ACCOUNT, T.LongType()).add(PRODUCT, T.StringType())


CUSTOMER_COLUMNS = tuple(customer_schema().fieldNames())
