"""Incremental work with Structured Streaming: each file once, ids that go on from the known ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mentionloom.operators.ids import update_ids
from mentionloom.sources.tables import read_or_empty

IDS = T.StructType([T.StructField("software", T.StringType()), T.StructField("ID", T.StringType())])


def ingest(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, format: str = "parquet") -> None:
    """Append what new files below ``path`` give to ``out``. Files that an earlier run has finished are skipped."""
    stream = transform(spark.readStream.schema(schema).format(format).load(path))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def ingest_ids(spark: SparkSession, path: str, schema: T.StructType, table: str, checkpoint: str, mention: str = "software", position: str = "pos") -> DataFrame:
    """Keep the mention ids up to date with new files. Every batch has a folder of its own, written anew if it is run
    again, so a restart neither loses nor repeats ids."""

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = read_or_empty(session, table, IDS)
        if known.inputFiles():
            known = session.read.parquet(table).filter(f"batch < {number}").select("software", "ID")
        new = update_ids(known, batch.withColumnRenamed(mention, "software"), "software", position)
        new.join(known, "software", "left_anti").write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_or_empty(spark, table, IDS)
