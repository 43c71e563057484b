"""python -m mentionloom: the steps of the mention pipeline from the command line, from files to files.

Runs in the session that spark-submit sets up, or in a local one."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import extract, graph, ids, link, simjoin, stats
from mentionloom.plans import catalogue
from mentionloom.sources import catalogs, nxml, tables


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table by its ending: .csv, .tsv (also gzipped), else Parquet."""
    plain = path.removesuffix(".gz")
    if plain.endswith((".csv", ".tsv")):
        return spark.read.options(header=True, sep="\t" if plain.endswith(".tsv") else ",", quote="" if plain.endswith(".tsv") else '"').csv(path)
    return spark.read.parquet(path)


def _write(df: DataFrame, path: str, kind: str) -> None:
    {"parquet": lambda: df.write.parquet(path), "csv": lambda: tables.write_csv(df, path), "tsv": lambda: tables.write_tsv(df, path)}[kind]()


def _extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    papers = nxml.objects(nxml.well_formed(nxml.read_papers(spark, a.input)))
    names = {r[0] for r in spark.read.text(a.names).collect()}
    return extract.mentions(extract.sentences(papers), extract.dictionary_tagger(names))


def _ids(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return ids.assign_ids(_read(spark, a.input).withColumn("pos", F.monotonically_increasing_id()), a.mention)


def _top(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return stats.top_k(stats.frequency(_read(spark, a.input), a.mention, {"num_papers": a.paper}), "num_papers", a.mention, a.top_k)


def _similar(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = _read(spark, a.input).select(a.mention)
    return simjoin.similar_pairs(rows, rows, a.mention, a.threshold)


def _link(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    parse, name, normalize = {"pypi": (catalogs.pypi, "pypi package", link.normalize_pypi), "cran": (catalogs.cran, "CRAN Package", link.normalize_cran), "bioconductor": (catalogs.bioconductor, "Bioconductor Package", link.normalize_bioconductor)}[a.catalog]
    return normalize(link.matched(parse(_read(spark, a.pages)), _read(spark, a.input), name, a.mention))


def _entities(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return graph.entities(_read(spark, a.input).withColumn("synonym_conf", F.col("synonym_conf").cast("double")), _read(spark, a.frequencies).withColumn("freq", F.col("freq").cast("long")))


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return catalogue.queries()[a.name](spark, a.input)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mentionloom", description=__doc__.splitlines()[0])
    steps = out.add_subparsers(required=True)

    def step(name: str, run, text: str, *arguments: tuple) -> None:
        p = steps.add_parser(name, help=text)
        p.set_defaults(run=run)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--format", choices=("parquet", "csv", "tsv"), default="parquet")
        for flag, options in arguments:
            p.add_argument(flag, **options)

    mention, paper = ("--mention", {"default": "software"}), ("--paper", {"default": "pmcid"})
    step("extract", _extract, "mentions of the papers below a directory", ("--names", {"required": True, "help": "file with a known name in each line"}))
    step("assign-ids", _ids, "ids of the mentions of a table, by first appearance", mention)
    step("top", _top, "mentions with most papers", mention, paper, ("--top-k", {"type": int, "default": 40}))
    step("similar", _similar, "pairs of similar mentions", mention, ("--threshold", {"type": float, "default": 0.9}))
    step("link", _link, "links of mentions to a catalog's pages", mention, ("--catalog", {"choices": ("pypi", "cran", "bioconductor"), "required": True}), ("--pages", {"required": True, "help": "table with the catalog's pages, column html"}))
    step("entities", _entities, "entities of synonym pairs", ("--frequencies", {"required": True, "help": "table of software and freq"}))
    step("query", _query, "a query of the catalogue over a folder of tables", ("--name", {"choices": sorted(catalogue.queries()), "required": True}))
    return out


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("mentionloom").getOrCreate()
    _write(a.run(spark, a), a.output, a.format)


if __name__ == "__main__":
    main()
