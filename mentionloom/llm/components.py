"""Connected components of an edge table, in rounds of joins whose tables are written down."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.llm.common import dropped, written

#: So many edges go through one task at most, in a few megabytes; more are joined round by round.
FEW = 1 << 17


def _forest(batches):
    """The stars of a few edges, in one pass."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for b in batches:
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long); component is the smallest node that it reaches.

    Large-star and small-star rounds by turns (Kiveris et al., 2014): every node links its larger neighbours to the
    smallest node around it, then itself and its smaller neighbours to the smallest of them. The number of edges
    doesn't grow, and stars are left after a number of rounds that grows as the logarithm of the input. FEW edges at most
    are no work for rounds and go through one task. Null nodes, loops and repeated edges don't matter; without edges the
    result is empty."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= FEW:
        out = written(now.coalesce(1).mapInArrow(_forest, "node long, component long"), "components")
        dropped(now)
        return out
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(floor, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").unionByName(floor.select("a", F.col("low").alias("b"))).distinct()
        after = written(small, "edges")
        # equal sums of hashes and counts: the edges have stayed as they are
        mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = mark(now) == mark(after)
        dropped(now)
        now = after
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
