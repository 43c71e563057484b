"""Catalogs: their pages and responses as raw tables. Fetching and parsing are apart; parsing is pure DataFrame work."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from mentionloom.functions.text import ANCHOR, anchor

PYPI, CRAN, BIOCONDUCTOR = "https://pypi.org/project/", "https://cran.r-project.org/", "https://www.bioconductor.org/packages/release/"


def anchors(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """link and name of every anchor of every page."""
    found = F.explode(F.regexp_extract_all(html, F.lit(r"<a [^>]*" + ANCHOR), F.lit(0)))
    return pages.select(*(keep or []), found.alias("_a")).select(*(keep or []), anchor(F.col("_a")).alias("a")).select(*(keep or []), "a.link", "a.name")


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """row (from 0) and cells of the HTML table rows after the first of a page, those with more than one cell."""
    rows = pages.select(F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    return rows.filter("row > 0").select("row", cells.alias("cells")).filter(F.size("cells") > 1)


def _text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))


def pypi(pages: DataFrame) -> DataFrame:
    return anchors(pages).select(F.col("name").alias("pypi package"), F.concat(F.lit(PYPI), "name").alias("pypi_url"))


def cran(pages: DataFrame) -> DataFrame:
    cells = table_rows(pages)
    a = anchor(F.get("cells", F.lit(0)))
    return cells.select(a["name"].alias("CRAN Package"), F.concat(F.lit(CRAN), F.substring(a["link"], 7, 1000)).alias("CRAN Link"), _text(F.get("cells", F.lit(1))).alias("Title"))


def bioconductor(pages: DataFrame, lowercase: bool = True) -> DataFrame:
    """``lowercase``: names as the index lists them in lower case, so only lower-case mentions match."""
    cells = table_rows(pages)
    a = anchor(F.get("cells", F.lit(0)))
    name = F.lower(a["name"]) if lowercase else a["name"]
    return cells.select(name.alias("Bioconductor Package"), F.concat(F.lit(BIOCONDUCTOR), a["link"]).alias("BioConductor Link"), _text(F.get("cells", F.lit(1))).alias("Maintainer"), _text(F.get("cells", F.lit(2))).alias("Title"))


NAMED = ("Resource Name", "Resource ID", "Parent Organization", "Reference")


def scicrunch(responses: DataFrame) -> DataFrame:
    """From mention and xml: the rows of a response with a named link whose text is the mention or one of its
    expansions, by lower case. A response that can't be read gives none."""
    kind = "query struct<clauses: struct<clauses: array<struct<expansion: struct<expansion: array<string>>>>>>, result struct<results: struct<row: array<struct<data: array<struct<name: string, value: string>>>>>>"
    read = responses.withColumn("r", F.from_xml("xml", StructType.fromDDL(kind), {"rowTag": "response"}))
    first = F.get("r.query.clauses.clauses", F.lit(0))["expansion"]["expansion"]
    known = F.concat(F.transform(F.coalesce(first, F.array().cast("array<string>")), lambda x: F.lower(x)), F.array(F.lower("mention")))
    rows = read.select("mention", known.alias("scicrunch_synonyms"), F.explode("r.result.results.row").alias("row"))
    linked = F.transform(F.filter("row.data", lambda d: d["name"].isin(*NAMED) & d["value"].contains("href")), lambda d: F.struct(d["name"].alias("name"), anchor(d["value"]).alias("a")))
    rows = rows.withColumn("linked", linked).filter(F.exists("linked", lambda x: F.array_contains("scicrunch_synonyms", F.lower(x["a"]["name"]))))
    names = F.map_from_entries(F.transform("linked", lambda x: F.struct(x["name"], x["a"]["name"])))
    links = F.map_from_entries(F.transform("linked", lambda x: F.struct(x["name"], x["a"]["link"])))
    plain = F.map_from_entries(F.filter(F.transform("row.data", lambda d: F.struct(d["name"].alias("k"), d["value"].alias("v"))), lambda d: d["k"].isNotNull()))
    out = rows.select(F.col("mention").alias("software_name"), "scicrunch_synonyms", names.alias("n"), links.alias("l"), plain.alias("p"))
    columns = [F.coalesce(F.try_element_at("n", F.lit(c)), F.try_element_at("p", F.lit(c))).alias(c) for c in NAMED]
    return out.select("software_name", "scicrunch_synonyms", *columns, *[F.try_element_at("l", F.lit(c)).alias(f"{c} Link") for c in NAMED])


def fetched(mentions: DataFrame, fetch: Callable[[str], tuple[int, str]], mention: str = "software_mention", tries: int = 5, wait: float = 1.0, partitions: int = 8) -> DataFrame:
    """mention and body of one request for each distinct mention; null after ``tries`` answers other than 200."""

    def work(frames):
        for f in frames:
            bodies = []
            for m in f["mention"]:
                body = None
                for i in range(tries):
                    status, text = fetch(m)
                    if status == 200:
                        body = text
                        break
                    if i + 1 < tries:
                        time.sleep(wait * 2**i)
                bodies.append(body)
            yield f.assign(body=bodies)

    asked = mentions.select(F.col(mention).alias("mention")).filter("mention is not null").distinct().repartition(partitions)
    return asked.mapInPandas(work, "mention string, body string")


class _Part(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options["urls"])

    def partitions(self):
        return [_Part(u) for u in self.urls]

    def read(self, partition) -> Iterator[tuple]:
        from urllib.request import urlopen

        with urlopen(partition.url, timeout=60) as r:  # noqa: S310  only the given pages
            yield partition.url, r.read().decode("utf-8", "replace")


class PageSource(DataSource):
    """spark.read.format("page").option("urls", json list): url and html of each page. Land the result once and parse that."""

    @classmethod
    def name(cls) -> str:
        return "page"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)
