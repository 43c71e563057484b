"""Links of mentions to catalogs, one 16-column schema for all, and their merge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.plans.schema import METADATA

GITHUB = "Github API"


@dataclass(frozen=True)
class Catalog:
    """How to get a catalog's raw table and how to bring it to the common schema."""

    name: str
    raw: Callable[[DataFrame], DataFrame]
    normalize: Callable[[DataFrame], DataFrame]


def common(df: DataFrame, **columns) -> DataFrame:
    """The common schema from some of its columns; the others are null."""
    return df.select(*[(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields])


def normalize_pypi(df: DataFrame) -> DataFrame:
    name = F.col("pypi package")
    return common(df, software_mention=name, mapped_to=name, source=F.lit("PyPI Index"), platform=F.lit("PyPI"), package_url=F.col("pypi_url"))


def normalize_cran(df: DataFrame) -> DataFrame:
    name = F.col("CRAN Package")
    return common(df, software_mention=name, mapped_to=name, source=F.lit("CRAN Index"), platform=F.lit("CRAN"), package_url=F.col("CRAN Link"), description=F.col("Title"))


def normalize_bioconductor(df: DataFrame) -> DataFrame:
    name = F.col("Bioconductor Package")
    return common(df, software_mention=name, mapped_to=name, source=F.lit("Bioconductor Index"), platform=F.lit("Bioconductor"), package_url=F.col("BioConductor Link"), description=F.col("Title"))


def normalize_github(df: DataFrame) -> DataFrame:
    exact = F.lower(F.col("exact_match").cast("string")) == "true"
    return common(df, software_mention=F.col("software_mention"), mapped_to=F.col("best_github_match"), source=F.lit(GITHUB), platform=F.lit("GitHub"), package_url=F.col("github_url"), description=F.col("description"), github_repo=F.col("github_url"), github_repo_license=F.col("license"), exact_match=exact)


def normalize_scicrunch(df: DataFrame) -> DataFrame:
    has = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None)
    return common(df, software_mention=F.col("software_name"), mapped_to=has("Resource Name"), source=F.lit("SciCrunch API"), platform=F.lit("SciCrunch"), package_url=has("Resource Name Link"), RRID=has("Resource ID"), reference=has("Reference"), scicrunch_synonyms=has("scicrunch_synonyms"))


def matched(catalog: DataFrame, mentions: DataFrame, name: str, mention: str = "software_mention") -> DataFrame:
    """Catalog rows whose name is a mention, by case; repeated rows stay."""
    known = mentions.select(F.col(mention).alias("_mention")).distinct()
    return catalog.join(known, catalog[name] == known["_mention"], "left_semi")


def best_hit(responses: DataFrame) -> DataFrame:
    """From mention and json (total_count, items): the item whose name is the mention, else the first. A response that
    can't be read, or without items, gives a row without a match."""
    kind = "total_count long, items array<struct<name:string,description:string,url:string,license:struct<name:string>>>"
    read = responses.withColumn("r", F.from_json("json", kind))
    items = F.filter("r.items", lambda x: x["name"].isNotNull())
    exact = F.get(F.filter(items, lambda x: x["name"] == F.col("mention")), F.lit(0))
    best = F.coalesce(exact, F.get(items, F.lit(0)))
    out = read.select(F.col("mention").alias("software_mention"), best.alias("b"), exact.isNotNull().alias("exact_match"))
    return out.select("software_mention", F.col("b.name").alias("best_github_match"), F.col("b.description").alias("description"), F.col("b.url").alias("github_url"), F.col("b.license.name").alias("license"), "exact_match")


def link(mentions: DataFrame, catalog: Catalog, ids: DataFrame) -> DataFrame:
    """A catalog's rows for the mentions, in the common schema, with their ids."""
    rows = catalog.normalize(catalog.raw(mentions)).drop("ID")
    named = ids.select(F.col("software").alias("software_mention"), "ID")
    return rows.join(named, "software_mention", "left").select(*METADATA.fieldNames())


def all_links(mentions: DataFrame, catalogs: list[Catalog], ids: DataFrame) -> dict[str, DataFrame]:
    """The link tables of several catalogs, by name."""
    return {c.name: link(mentions, c, ids) for c in catalogs}


def merge(tables: list[DataFrame]) -> DataFrame:
    """All link tables in one, without repeated rows and without inexact GitHub matches; null sources stay."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    github = F.col("source").eqNullSafe(GITHUB)
    return out.distinct().filter(~github | F.coalesce("exact_match", F.lit(False)))
