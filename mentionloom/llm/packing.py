"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are kept in the order of their residual space and carry two bitmaps: the sources that have used up their
places in the bin, and the duplicate clusters that are in it. The successor search starts at the tightest bin that
has room and goes on until one is compatible; if none is, a bin is opened."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.llm.common import n_words, written

#: Words of a bin.
CAPACITY = 2048
#: Pieces that one source may have in a bin.
SOURCE_PLACES = 4
#: Pieces that are packed together, about.
GROUP_ROWS = 2048


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY, places: int = SOURCE_PLACES, order_in: np.ndarray | None = None) -> np.ndarray:
    """Bins of the pieces, which go in as ``order_in`` says, else largest pieces first, ties in the order given. Sources and clusters are numbers from 0;
    a cluster below 0 conflicts with nothing. Pieces of 0 words go to bin -1."""
    bins = np.full(len(sizes), -1, np.int64)
    order: list[tuple[int, int]] = []  # (residual, bin)
    in_bin: list[list[int]] = []  # cluster bitmap, then a source bitmap for each place taken
    for i in np.argsort(-sizes, kind="stable") if order_in is None else order_in:
        size = int(sizes[i])
        if size == 0:
            continue
        if size > capacity:
            raise ValueError("a piece is larger than a bin")
        source, cluster = 1 << int(sources[i]), 1 << int(clusters[i]) if clusters[i] >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (in_bin[order[at][1]][0] & cluster or in_bin[order[at][1]][places] & source):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(in_bin)
            in_bin.append([0] * (places + 1))
        marks = in_bin[b]
        marks[0] |= cluster
        for k in range(1, places + 1):  # unary count of the source's pieces
            if not marks[k] & source:
                marks[k] |= source
                break
        if left > size:
            insort(order, (left - size, b))
        bins[i] = b
    return bins


def pressed_first(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY, places: int = SOURCE_PLACES) -> np.ndarray:
    """The order in which pieces go in: largest first, but before all others those of sources and clusters that need over
    half of their places in as many bins as the words fill. Left to the end, their small pieces would open bins of their own."""
    some = sizes > 0
    bins = max(1, -(-int(sizes.sum()) // capacity))
    pressed = 2 * np.bincount(sources[some], minlength=sources.max(initial=0) + 1)[sources] > places * bins
    copied = some & (clusters >= 0)
    pressed |= (clusters >= 0) & (2 * np.bincount(clusters[copied], minlength=max(0, clusters.max(initial=0)) + 1)[np.maximum(clusters, 0)] > bins)
    return np.lexsort((-sizes, ~pressed))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, places: int = SOURCE_PLACES, group_rows: int = GROUP_ROWS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a piece: key, piece, first_word, n_words, bin (long, its group in the high bits), position, used.

    A document longer than a bin is cut into full bins and a rest; a document without words has one piece of no
    words in bin -1, as has a null text. Duplicate clusters are equal texts. Rows are dealt out by a hash of id,
    text and their number to groups of bounded size that are packed each on its own, so a hot source or a huge
    cluster is spread over all groups; a cluster's copies take as many bins. Null sources count as one source.
    Pieces go in as ``pressed_first`` says, those of one size by the hash that dealt them out; bins of one residual fill up in the order they were opened.
    Texts are read whole, however long. Equal rows are pieces of their own; an empty table gives an empty one; other columns
    don't matter, but the key can't have the name of one of the results."""
    if key in ("piece", "first_word", "n_words", "bin", "position", "used"):
        raise ValueError(f"the key can't be named {key}")
    rows = docs.select(F.col(key).alias("key"), n_words(text).alias("size"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("source"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("cluster"))
    # a number tells equal rows apart; it is written down so that a rerun deals them out alike
    rows = written(rows.withColumn("salt", F.monotonically_increasing_id()), "packing")
    n_pieces = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)))).first()[0] or 0
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("long"))))
    pieces = pieces.select("key", "piece", (F.col("piece") * capacity).alias("first_word"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_words"), "source", "cluster", F.xxhash64("key", "cluster", "salt", "piece").alias("deal"))
    groups = max(1, -(-int(n_pieces) // group_rows))
    pieces = pieces.withColumn("pack", F.pmod("deal", F.lit(groups)))

    def best_fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table["deal"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        sizes = table["n_words"].to_numpy()
        sources = np.unique(table["source"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        _, clusters, copies = np.unique(table["cluster"].to_numpy(), return_inverse=True, return_counts=True)
        shared = np.cumsum(copies > 1) - 1  # only clusters with several pieces can conflict
        shared[copies == 1] = -1
        group = table["pack"][0].as_py()
        came = pressed_first(sizes, sources, shared[clusters], capacity, places)
        bins = pack(sizes, sources, shared[clusters], capacity, places, came)
        count = max(0, bins.max() + 1)
        used = np.bincount(bins[bins >= 0], sizes[bins >= 0], count).astype(np.int64)
        # pieces of a bin in the order they went in
        by_bin = came[np.argsort(bins[came], kind="stable")]
        starts = np.searchsorted(bins[by_bin], bins[by_bin])
        position = np.empty(len(bins), np.int64)
        position[by_bin] = np.arange(len(bins)) - starts
        named = np.where(bins >= 0, (group << 32) | np.maximum(bins, 0), -1)
        return pa.table([table["key"].combine_chunks(), table["piece"].combine_chunks(), table["first_word"].combine_chunks(), table["n_words"].combine_chunks(), pa.array(named), pa.array(position), pa.array(np.where(bins >= 0, used[np.maximum(bins, 0)] if count else 0, 0))], names=["key", "piece", "first_word", "n_words", "bin", "position", "used"])

    kind = pieces.schema["key"].dataType.simpleString()
    out = pieces.groupBy("pack").applyInArrow(best_fit, f"key {kind}, piece long, first_word long, n_words long, bin long, position long, used long")
    return out.withColumnRenamed("key", key)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 2,048 words."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
