"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The key alone decides the shard, without a ring table; with one more shard, rows move only into it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.llm.common import written


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets 0 to ``buckets`` - 1 of 64-bit keys. Every step handles all keys that still jump."""
    key, place, target = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while todo.size:
        place[todo] = target[todo]
        k = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        key[todo] = k
        ahead = (place[todo] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))
        target[todo] = np.minimum(ahead, float(1 << 62)).astype(np.int64)
        todo = todo[target[todo] < buckets]
    return place.astype(np.int32)


def assign_shards(df: DataFrame, key: str | Column = "doc_id", shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: the key) and shard, slot, grown_shard of every row of ``df``.

    slot numbers the rows of a shard from 0 without gaps. Rows are never shuffled: a task numbers its rows in
    each shard, the table is written once, and offsets come from the counts by task and shard. A hot key fills
    its shard (that is the law) but no single task. Null keys share a shard; equal rows have slots of their own;
    an empty table gives an empty one; columns of ``df`` that aren't in ``keep`` don't matter, whatever their names."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keep = [key] if keep is None and isinstance(key, str) else list(keep or [])
    rows = df.select(F.struct(*keep).alias("row"), F.xxhash64(F.col(key) if isinstance(key, str) else key).alias("hash"))

    def place(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            keys = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order, counts = np.argsort(shard, kind="stable"), np.bincount(shard, minlength=shards)
            local = np.empty(len(keys), np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            local += seen[shard]
            seen += counts
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard), pa.array(grown), pa.array(np.full(len(keys), task, np.int64)), pa.array(local)], names=["row", "shard", "grown_shard", "task", "local"])

    fields = rows.schema["row"].dataType.simpleString()
    placed = written(rows.mapInArrow(place, f"row {fields}, shard int, grown_shard int, task long, local long"), "shards")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "task").count().select("shard", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["shard", "task"]).select("row.*", "shard", (F.col("local") + F.col("offset")).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 8) -> None:
    """Write every row of ``df`` to ``path``/shard=<n>, as Parquet, straight from the tasks that read it."""
    if "shard" in df.columns:
        raise ValueError("df has a column named shard already")
    number = F.pandas_udf(lambda h: __import__("pandas").Series(jump_hash(h.to_numpy().view(np.uint64), shards)), "int")
    df.withColumn("shard", number(F.xxhash64(key))).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(sized, "doc_id", 8, keep=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
