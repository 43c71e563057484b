"""Surrogate ids of mention strings: dense, in the order of first appearance, stable when more mentions come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions.text import surrogate_id

#: Ranges of positions that are numbered each on its own.
RANGES = 64


def assign_ids(df: DataFrame, mention: str = "software", position: str = "pos") -> DataFrame:
    """(mention, ID) of the distinct non-null mentions, SM0 for the one that appears first. ``position`` has been
    captured when the rows were read (monotonically_increasing_id) or is a key of the source."""
    first = df.filter(F.col(mention).isNotNull()).groupBy(mention).agg(F.min(position).cast("long").alias("_first"))
    # mentions of one row share a position; their names break the tie
    return dense_named(first, mention).select(mention, surrogate_id(F.col("place")).alias("ID"))


def dense_named(first: DataFrame, mention: str) -> DataFrame:
    """Add ``place``: 0, 1, 2 ... by ``_first``, then name. Ranges of positions are counted first and numbered each on
    its own, so no task holds all mentions."""
    low, high = first.agg(F.min("_first"), F.max("_first")).first()
    if low is None:
        return first.withColumn("place", F.lit(None).cast("long"))
    width = (high - low) // RANGES + 1
    ranged = first.withColumn("_range", F.floor((F.col("_first") - low) / width))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = ranged.groupBy("_range").count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_first", mention)) - 1
    return ranged.join(offsets, "_range").withColumn("place", (inside + F.col("_offset")).cast("long")).drop("_range", "_offset")


def update_ids(known: DataFrame, df: DataFrame, mention: str = "software", position: str = "pos") -> DataFrame:
    """Known ids as they are; new mentions go on from the number of known ones."""
    new = df.join(known.select(mention), mention, "left_anti").filter(F.col(mention).isNotNull())
    count = known.count()
    numbered = dense_named(new.groupBy(mention).agg(F.min(position).cast("long").alias("_first")), mention)
    return known.select(mention, "ID").unionByName(numbered.select(mention, surrogate_id(F.col("place") + count).alias("ID")))


def with_ids(df: DataFrame, ids: DataFrame, mention: str = "software", strict: bool = False) -> DataFrame:
    """Rows with the ID of their mention: null if there is none, an error if ``strict``."""
    out = df.join(ids.select(mention, "ID"), mention, "left")
    return out.withColumn("ID", F.coalesce("ID", F.raise_error(F.lit("a mention has no id")))) if strict else out
