"""Shares of labels in evaluation tables, in one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTI_LABELS = ("software", "algorithm", "hardware", "database", "web platform", "other", "unclear")
LINK_LABELS = ("correct", "incorrect", "unclear")
GITHUB = "Github API"


def shares(df: DataFrame, column: str, labels: tuple[str, ...], among_labels: bool = False) -> DataFrame:
    """label, n, percent of all rows, or of those with one of the labels. Labels without rows have 0."""
    counts = df.agg(*[F.count_if(F.col(column) == x).alias(f"l{i}") for i, x in enumerate(labels)], F.count("*").alias("all"))
    total = sum((F.col(f"l{i}") for i in range(1, len(labels))), F.col("l0")) if among_labels else F.col("all")
    rows = counts.withColumn("total", total).select("total", F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"l{i}").alias("n")) for i, x in enumerate(labels)])))
    return rows.select("label", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).alias("percent"))


def extraction(terms: DataFrame, multi: bool = False) -> DataFrame:
    return shares(terms, "multi_label", MULTI_LABELS) if multi else shares(terms, "label", ("software", "not_software", "unclear"))


def linking(links: DataFrame, without_github: bool = False) -> DataFrame:
    """Shares of judged links: of distinct (mention, label) rows, or of all rows from other sources than GitHub."""
    rows = links.filter(~F.col("source_y").eqNullSafe(GITHUB)) if without_github else links.select("software_mention", "link_label").distinct()
    return shares(rows, "link_label", LINK_LABELS, among_labels=True)


def disambiguation(pairs: DataFrame) -> DataFrame:
    """Shares of judged synonym pairs; exact and narrow ones are correct."""
    rows = pairs.select("software_mention", "synonym", "synonym_label").distinct()
    kind = F.when(F.col("synonym_label").isin("Exact", "Narrow"), "correct").when(F.col("synonym_label") == "Unclear", "unclear").when(F.col("synonym_label") == "Not synonym", "incorrect").when(F.col("synonym_label") == "Not software", "not_software")
    return shares(rows.withColumn("kind", kind), "kind", ("correct", "unclear", "incorrect", "not_software"), among_labels=True)
