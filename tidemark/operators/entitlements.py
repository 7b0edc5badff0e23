"""What an account may do on a venue: three layers, each a table of permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(capability: Column) -> Column:
    return F.lower(F.trim(capability))


def effective(
    accounts: DataFrame, venue_layer: DataFrame, account_layer: DataFrame, legal_layer: DataFrame
) -> DataFrame:
    """(account, venue, capability) allowed by all three layers at once.

    ``accounts`` gives (account, venue, tier, jurisdiction); the layers are
    permission tables keyed by venue, by (tier, venue) and by jurisdiction.
    """
    return (
        accounts.join(account_layer, ["tier", "venue"])
        .join(venue_layer, ["venue", "capability"], "left_semi")
        .join(legal_layer, ["jurisdiction", "capability"], "left_semi")
        .select("account", "venue", "capability")
    )


def label_denials(
    activity: DataFrame, venue_layer: DataFrame, account_layer: DataFrame, legal_layer: DataFrame
) -> DataFrame:
    """Add ``denied_by``: the first layer, in precedence order, that says no."""
    flagged = lambda layer, name: layer.distinct().withColumn(name, F.lit(True))
    return (
        activity.join(flagged(venue_layer, "by_venue"), ["venue", "capability"], "left")
        .join(flagged(account_layer, "by_account"), ["tier", "venue", "capability"], "left")
        .join(flagged(legal_layer, "by_law"), ["jurisdiction", "capability"], "left")
        .withColumn(
            "denied_by",
            F.when(F.col("by_venue").isNull(), F.lit("venue"))
            .when(F.col("by_account").isNull(), F.lit("account"))
            .when(F.col("by_law").isNull(), F.lit("jurisdiction")),
        )
        .drop("by_venue", "by_account", "by_law")
    )
