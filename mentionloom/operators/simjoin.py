"""Similarity join of strings by Jaro-Winkler of q-grams, blocked without losing a pair.

For a threshold t the Jaro part is at least w = (t - 0.4) / 0.6, so of n1 and n2 grams at least B * n1 * n2 / (n1 + n2)
are common, B = 3 w - 1. Hence the sizes differ at most by B - 1 if that is positive, and with the grams of either string in a common order,
rare ones first, one of the first n1 - common + 1 grams of one is among the first n2 - common + 1 of the other. A string
is put down for every band of sizes that a partner may have, by as few grams as that band asks for, and the place of the
shared gram bounds what can follow it. Valid for t above 0.7."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions.similarity import jaro_winkler_column

#: Sizes of one band differ by less than this factor.
BAND = 1.15


def _grams(df: DataFrame, column: str, q: int) -> DataFrame:
    """(s, n, gram, occurrence) of the distinct strings of at least q characters."""
    s = df.select(F.col(column).alias("s")).filter(F.length("s") >= max(2, q)).distinct()
    cut = s.select("s", (F.length("s") - q + 1).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - q + 1), lambda i: F.substring(F.col("s"), i, F.lit(q)))).alias("gram"))
    counted = cut.groupBy("s", "n", "gram").count()
    return counted.select("s", "n", "gram", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("occurrence"))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / log(BAND) + 1e-9).cast("int")


def _common(b: float, n: Column, m: Column) -> Column:
    """Common grams that a pair of these sizes needs."""
    return F.ceil(b * n * m / (n + m) - 1e-9)


def similar_pairs(left: DataFrame, right: DataFrame, column: str = "software", threshold: float = 0.9, q: int = 2) -> DataFrame:
    """(software_mention, synonym, synonym_conf): every pair of left and right strings at the threshold, a string with
    itself included. Strings shorter than 2 characters match nothing."""
    if threshold <= 0.7:
        raise ValueError("the blocking needs a threshold above 0.7")
    b = 3 * (threshold - 0.4) / 0.6 - 1
    a, c = _grams(left, column, q), _grams(right, column, q)
    longest = a.unionByName(c).agg(F.max("n")).first()[0] or 1
    rarity = a.unionByName(c).groupBy("gram", "occurrence").count()

    def prefixes(t: DataFrame, name: str) -> DataFrame:
        n = F.col("n")
        place = F.row_number().over(Window.partitionBy("s").orderBy("count", "gram", "occurrence")) - 1
        least = F.greatest(F.lit(1), F.ceil((b - 1) * n - 1e-9))
        most = F.least(F.lit(longest), F.floor(n / (b - 1) + 1e-9)) if b > 1 else F.lit(longest)
        kept = t.join(rarity, ["gram", "occurrence"]).withColumn("place", place).filter(F.col("place") <= n - _common(b, n, least))
        kept = kept.withColumn("to", F.explode(F.sequence(_band(least), _band(most))))
        # a band's smallest sizes need the fewest common grams
        low = F.greatest(least, F.ceil(F.pow(F.lit(BAND), F.col("to")) - 1e-6))
        kept = kept.filter(F.col("place") <= n - _common(b, n, low))
        return kept.select(F.col("s").alias(name), n.alias(f"n_{name}"), F.col("place").alias(f"place_{name}"), _band(n).alias(f"band_{name}"), F.col("to").alias(f"to_{name}"), "gram", "occurrence")

    x, y = prefixes(a, "a"), prefixes(c, "b").withColumnsRenamed({"band_b": "to_a", "to_b": "band_a"})
    need = _common(b, F.col("n_a"), F.col("n_b"))
    met = x.join(y, ["gram", "occurrence", "band_a", "to_a"]).filter((F.least("n_a", "n_b") >= (b - 1) * F.greatest("n_a", "n_b") - 1e-9) & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need))
    scored = met.select("a", "b").distinct().withColumn("synonym_conf", jaro_winkler_column(F.col("a"), F.col("b"), q)).filter(F.col("synonym_conf") >= threshold)
    return scored.select(F.col("a").alias("software_mention"), F.col("b").alias("synonym"), "synonym_conf")
