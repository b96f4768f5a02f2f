"""Seeded splits and folds that do not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column
from prospectra.operators.ranks import stored, values_at_ranks

SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
# 8-digit hex cut points at one to four fifths of the hash range.
FIFTHS = ("33333333", "66666666", "99999999", "cccccccc")


def _digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), column(id_col).cast("string")))


def hash_of(id_col: str, seed: int) -> Column:
    """First 8 hex digits of a seeded digest of the id; NULL ids hash as ''."""
    return F.substring(F.coalesce(_digest(id_col, seed), F.md5(F.lit(f"{seed}:"))), 1, 8)


def split_by_hash(df: DataFrame, id_col: str = schema.ID, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: about a fifth of the ids, in one pass without a shuffle.

    All copies of an id land on the same side.
    """
    return df.withColumn("is_test", (hash_of(id_col, seed) < FIFTHS[0]).cast("int"))


def assign_folds(df: DataFrame, id_col: str = schema.ID, seed: int = SEED + 1) -> DataFrame:
    """Add ``fold`` 0..4 by hash, with another seed than the split's."""
    h = hash_of(id_col, seed)
    passed = sum(((h >= cut).cast("int") for cut in FIFTHS), start=F.lit(0))
    return df.withColumn("fold", passed)


def split_exact(df: DataFrame, label: str = schema.LABEL, id_col: str = schema.ID, share: float = TEST_SHARE,
                seed: int = SEED) -> DataFrame:
    """Add ``is_test`` so that each class has its share of test rows to one row.

    Rows are ordered by a 60-bit digest of the id; the digest at the wanted
    rank of each class is found in buckets and compared with in one pass, so
    the large class is never sorted in one task.  Copies of an id stay
    together, so an id at the cut brings all its copies.
    """
    return _with_cuts(df, label, id_col, (share,), seed, "is_test",
                      lambda h, cuts: F.coalesce(h <= cuts[0], F.lit(False)).cast("int"))


def folds_exact(df: DataFrame, label: str = schema.LABEL, id_col: str = schema.ID, folds: int = FOLDS,
                seed: int = SEED + 1, within: str | None = None) -> DataFrame:
    """Add ``fold`` so that each class is spread evenly over the folds.

    With ``within`` the rows are ranked inside each value of that column, as
    the folds of the training side are.
    """
    shares = [i / folds for i in range(1, folds)]

    def place(h: Column, cuts: Column) -> Column:
        return sum((F.coalesce(h > cuts[i], F.lit(True)).cast("int") for i in range(folds - 1)), start=F.lit(0))

    return _with_cuts(df, label, id_col, shares, seed, "fold", place, within)


def order_key(id_col: str, seed: int) -> Column:
    """First 15 hex digits of the digest as a bigint; NULL ids come first."""
    return F.coalesce(F.conv(F.substring(_digest(id_col, seed), 1, 15), 16, 10).cast("bigint"), F.lit(0))


def _with_cuts(df: DataFrame, label: str, id_col: str, shares: Sequence[float], seed: int, name: str, place,
               within: str | None = None) -> DataFrame:
    group = F.lit(0) if within is None else column(within)
    by = ("_class", "_group")
    keys = df.select(column(label).alias("_class"), group.alias("_group"), order_key(id_col, seed).alias("_key"))
    counts = stored(keys.groupBy(*by, "_key").agg(F.count("*").alias("_n")))
    ranks = (counts.groupBy(*by).agg(F.sum("_n").alias("_rows"))
             .select(*by, F.posexplode(F.array(*[F.lit(s) for s in shares])).alias("tag", "_share"), "_rows")
             .select(*by, "tag", F.round(F.col("_rows") * F.col("_share")).cast("bigint").alias("rank")))
    cuts = (values_at_ranks(counts, "_key", "_n", ranks, by).groupBy(*by)
            .agg(F.map_from_entries(F.collect_list(F.struct("tag", "_key"))).alias("_cuts")))
    # One row per class and group; the planner sends it to the rows where it is small.
    joined = df.join(cuts, (column(label) == F.col("_class")) & (group == F.col("_group")), "left")
    return joined.withColumn(name, place(order_key(id_col, seed), F.col("_cuts"))).drop("_class", "_group", "_cuts")


def class_cuts(marked: DataFrame, label: str = schema.LABEL, id_col: str = schema.ID, seed: int = SEED) -> dict[str, int]:
    """Class (as text) to the highest order key on the test side, of a table split by ``split_exact``."""
    rows = (marked.where(F.col("is_test") == 1).groupBy(column(label).cast("string").alias("c"))
            .agg(F.max(order_key(id_col, seed)).alias("k")))
    return {r["c"]: r["k"] for r in rows.collect()}


def in_training(split: dict, label: str, id_col: str) -> Column:
    """1 for rows that a saved split put on the training side, 0 for its test rows.

    ``split`` names its kind, seed and, where it is exact, the cuts of the classes.
    """
    if split["kind"] == "hash":
        return (hash_of(id_col, split["seed"]) >= FIFTHS[0]).cast("int")
    cut = F.lit(-1)
    for name, key in split["cuts"].items():
        cut = F.when(column(label).cast("string") == name, F.lit(key)).otherwise(cut)
    return (order_key(id_col, split["seed"]) > cut).cast("int")
