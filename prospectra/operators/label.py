"""Which accounts hold the target product together with another one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.schema import ACCOUNT, PRODUCT


def target_accounts(transactions: DataFrame, product: str,
                    account: str = ACCOUNT, description: str = PRODUCT) -> DataFrame:
    """Distinct accounts with the target product and at least one other.

    One scan and one shuffle: both conditions are boolean aggregates, combined
    map-side, so an account with a third of all rows sends one row per task.
    A missing description counts for neither condition.
    """
    is_target = F.col(description) == F.lit(product)
    is_other = F.col(description) != F.lit(product)
    return (transactions.groupBy(account)
            .agg(F.bool_or(is_target).alias("_holds"), F.bool_or(is_other).alias("_other"))
            .where(F.col("_holds") & F.col("_other") & F.col(account).isNotNull())
            .select(account))


def target_accounts_by_semi_join(transactions: DataFrame, product: str,
                                 account: str = ACCOUNT, description: str = PRODUCT) -> DataFrame:
    """The same accounts written as filter, left-semi join and distinct.

    Reads the transactions twice; kept for callers whose holder list comes
    from another table.  Both sides are made distinct before they meet, so no
    account is joined more than once.
    """
    holders = transactions.where(F.col(description) == F.lit(product)).select(account).distinct()
    others = transactions.where(F.col(description) != F.lit(product)).select(account).distinct()
    return others.join(holders, account, "left_semi")
