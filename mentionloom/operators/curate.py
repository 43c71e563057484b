"""Curation labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.functions.text import CURATION_LABELS


def label(mentions: DataFrame, terms: DataFrame, id_: str = "ID") -> DataFrame:
    """Every row with curation_label. An id with several labels takes the first of software, not_software, unclear."""
    place = F.coalesce(*[F.when(F.col("label") == x, i) for i, x in enumerate(CURATION_LABELS[:3])])
    one = terms.withColumn("_place", place).filter("_place is not null").groupBy(id_).agg(F.min("_place").alias("_place"))
    name = F.element_at(F.array(*[F.lit(x) for x in CURATION_LABELS]), F.coalesce("_place", F.lit(3)) + 1)
    return mentions.join(one, id_, "left").withColumn("curation_label", name).drop("_place")


def curated(mentions: DataFrame, terms: DataFrame, id_: str = "ID") -> DataFrame:
    """Rows whose id isn't labelled not_software, even if it has another label as well."""
    return mentions.join(terms.filter(F.col("label") == "not_software").select(id_).distinct(), id_, "left_anti")


def last_label(mentions: DataFrame, terms: DataFrame, order: str, id_: str = "ID") -> DataFrame:
    """Every row with the label that comes last for its id."""
    return mentions.join(terms.groupBy(id_).agg(F.max_by("label", order).alias("label")), id_, "left")
