"""Table files: tolerant TSV, CSV, several files at once, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType, na_values: tuple[str, ...] = ("",), header: bool = True, rows: int | None = None, position: str | None = None) -> DataFrame:
    """Lines split at tabs; quotes are text. Short lines are filled with nulls, lines with too many fields left out,
    ``na_values`` become null, and each file's header is skipped. ``position`` adds a column that keeps the order of
    lines. A gzip file is read by one task: write it as Parquet once."""
    lines = spark.read.text(path)
    if position:
        lines = lines.withColumn(position, F.monotonically_increasing_id())
    parts = F.split("value", "\t", -1)
    names = schema.fieldNames()
    kept = lines.withColumn("_p", parts).filter(F.size("_p") <= len(names))
    if header:
        kept = kept.filter(F.col("value") != "\t".join(names))
    cell = [F.get("_p", F.lit(i)) for i in range(len(names))]
    typed = [F.when(~c.isin(*na_values), c).try_cast(f.dataType).alias(f.name) for c, f in zip(cell, schema.fields, strict=True)]
    out = kept.select(*typed, *([position] if position else []))
    return out if rows is None else out.limit(rows)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, index: bool = False) -> DataFrame:
    """CSV with a header and quoted line breaks; ``index`` drops a stored row number."""
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.drop(df.columns[0]) if index else df


def union_files(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Files (or globs) with differing columns as one table."""
    out = read(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(read(spark, p), allowMissingColumns=True)
    return out


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    """Tab-separated text without quotes; a tab or line break in a value becomes a space."""
    flat = [F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[\t\r\n]", " ").alias(c) for c in df.columns]
    df.select(*flat).write.options(sep="\t", header=True, quote="", emptyValue="", compression="gzip" if gzip else "none").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"').csv(path)


def write_batches(df: DataFrame, path: str, id_column: str = "ID", width: int = 10_000) -> None:
    """Parquet, a folder for each range of ids."""
    batch = F.floor(F.substring(id_column, 3, 20).cast("long") / width)
    df.withColumn("batch", batch).write.partitionBy("batch").parquet(path)


def output_name(directory: Column) -> Column:
    """f_ and the directory with its slashes as underscores."""
    return F.concat(F.lit("f_"), F.translate(F.rtrim(directory), "/", "_"))
