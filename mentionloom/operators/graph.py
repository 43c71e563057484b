"""Entities from synonym edges: components, density clusters of the largest one, the silhouette gate, names.

Everything stays sparse: pairs without an edge are at distance 1 and are never written out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPS, MIN_SAMPLES = 0.1, 30
#: So many edges go through one task at most, in a few tens of megabytes; more are joined round by round.
FEW = 1 << 16


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: written as Parquet to the shared folder that the session names, and read from there. A folder of
    one machine will do only where everything runs on it."""
    spark: SparkSession = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="mentionloom-graph-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(df: DataFrame) -> None:
    """Delete a table made by ``checkpointed`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def edges(pairs: DataFrame, src: str = "software_mention", dst: str = "synonym", conf: str = "synonym_conf") -> DataFrame:
    """(src, dst, conf) with src < dst: the largest confidence in either direction."""
    rows = pairs.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), F.col(conf).alias("conf"))
    return rows.filter(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.max("conf").alias("conf"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "conf"))


def vertices(pairs: DataFrame, src: str = "software_mention", dst: str = "synonym") -> DataFrame:
    return pairs.select(F.col(src).alias("v")).union(pairs.select(F.col(dst))).filter("v is not null").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a few edges, in one pass."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for b in batches:
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            low, high = sorted((find(x), find(y)), key=lambda s: s.encode("utf-8", "surrogatepass"))
            root[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.string()), pa.array([find(x) for x in list(root)], pa.string())], names=["v", "component"])


def components(v: DataFrame, e: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that edges reach.

    Large-star and small-star rounds by turns (Kiveris et al., 2014): every vertex links its larger neighbours to the
    smallest one around, then itself and its smaller neighbours to the smallest of these. The edges never grow in number,
    a component's edges stay spread over its vertices until it is a star, and the rounds grow as the logarithm of the input.
    FEW edges at most are no work for rounds and go through one task."""
    now = checkpointed(e.filter("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    of = lambda found: v.select("v").join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
    if now.count() <= FEW:
        return of(now.coalesce(1).mapInArrow(_forest, "v string, component string"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        after = checkpointed(small.unionByName(floor.select("a", F.col("low").alias("b"))).distinct())
        # equal counts and sums of hashes: the edges have stayed as they are
        mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = mark(now) == mark(after)
        _dropped(now)
        now = after
        if same:
            return of(now.select(F.col("a").alias("v"), F.col("b").alias("component")))


def dbscan(v: DataFrame, e: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(v, cluster): the smallest core vertex of the cluster, null for noise. A vertex's neighbours are itself and what
    has an edge with 1 - conf <= eps; border vertices go to the smallest cluster around."""
    near = both_ways(e).filter(1 - F.col("conf") <= eps + 1e-12)
    degree = near.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"))
    core = v.join(degree, "v", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("v")
    core = checkpointed(core)
    inner = e.filter(1 - F.col("conf") <= eps + 1e-12).join(core.select(F.col("v").alias("src")), "src", "left_semi").join(core.select(F.col("v").alias("dst")), "dst", "left_semi")
    clusters = components(core, inner)
    border = near.join(clusters.select(F.col("v").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("component").alias("border"))
    return v.select("v").join(clusters, "v", "left").join(border, "v", "left").select("v", F.coalesce("component", "border").alias("cluster"))


def silhouette(labels: DataFrame, e: DataFrame) -> DataFrame:
    """One row, silhouette: the mean over all vertices; null labels (noise) are a label as well. With one label, null."""
    given = labels.select("v", F.coalesce("cluster", F.lit("")).alias("cluster"), F.col("cluster").isNull().alias("noise"))
    sizes = given.groupBy("cluster", "noise").agg(F.count("*").alias("size"))
    links = both_ways(e).join(given.select(F.col("v").alias("dst"), F.col("cluster").alias("to"), F.col("noise").alias("to_noise")), "dst")
    sums = links.groupBy(F.col("src").alias("v"), "to", "to_noise").agg(F.sum("conf").alias("sim"), F.count("*").alias("linked"))
    own = F.col("cluster").eqNullSafe(F.col("to")) & (F.col("noise") == F.col("to_noise"))
    met = given.join(sums, "v", "left").join(sizes.select(F.col("cluster").alias("to"), F.col("noise").alias("to_noise"), F.col("size").alias("to_size")), ["to", "to_noise"], "left")
    best = met.groupBy("v", "cluster", "noise").agg(F.coalesce(F.sum(F.when(own, F.col("sim"))), F.lit(0.0)).alias("own_sim"), F.min(F.when(~own & F.col("to").isNotNull(), 1 - F.col("sim") / F.col("to_size"))).alias("b"))
    # a label without an edge is at mean distance 1, the most there is, so only labels with edges can be nearer
    s = best.join(sizes, ["cluster", "noise"]).withColumn("a", F.when(F.col("size") > 1, ((F.col("size") - 1) - F.col("own_sim")) / (F.col("size") - 1)))
    s = s.withColumn("b", F.coalesce("b", F.lit(1.0)))
    width = F.greatest("a", "b")
    s = s.withColumn("s", F.when(F.col("size") == 1, 0.0).when(width > 0, (F.col("b") - F.col("a")) / width).otherwise(0.0))
    out = s.agg(F.avg("s").alias("silhouette"), F.max(F.struct("cluster", "noise")).alias("hi"), F.min(F.struct("cluster", "noise")).alias("lo"))
    return out.select(F.when(F.col("hi") != F.col("lo"), F.col("silhouette")).alias("silhouette"))


def names(clusters: DataFrame, freq: DataFrame, mention: str = "software") -> DataFrame:
    """(cluster, name): the member with most papers, ties by name; without any, the smallest member."""
    f = freq.select(F.col(mention).alias("v"), "freq")
    used = F.when(F.col("freq") > 0, F.col("v"))
    best = F.min_by(used, F.when(F.col("freq") > 0, F.struct(-F.col("freq"), F.col("v"))))
    rows = clusters.filter("cluster is not null").join(f, "v", "left")
    return rows.groupBy("cluster").agg(F.coalesce(best, F.min("v")).alias("name"))


def entities(pairs: DataFrame, freq: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(v, cluster, name). Components are entities, but the largest is split into its density clusters if these have a
    positive silhouette; noise is then on its own. A single cluster stays one; noise alone leaves all on their own."""
    e, v = checkpointed(edges(pairs)), vertices(pairs)
    parts = components(v, e)
    largest = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    inside = checkpointed(parts.join(largest, "component", "left_semi").select("v"))
    # both ends of an edge are in one component
    inner = e.join(inside.select(F.col("v").alias("src")), "src", "left_semi")
    split = checkpointed(dbscan(inside, inner, eps, min_samples))
    kinds = split.agg(F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("noise")).first()
    score = silhouette(split, inner).first()[0]
    take = (score is not None and score > 0) or kinds["clusters"] + (kinds["noise"] > 0) <= 1
    big = split.select("v", F.when(F.lit(take), F.col("cluster")).otherwise(F.lit("*")).alias("cluster"))
    rest = parts.join(inside, "v", "left_anti").select("v", F.concat(F.lit("component:"), F.col("component")).alias("cluster"))
    clusters = rest.unionByName(big.filter("cluster is not null").select("v", F.concat(F.lit("cluster:"), F.col("cluster")).alias("cluster")))
    named = clusters.join(names(clusters, freq), "cluster")
    alone = big.filter("cluster is null").select("v", F.concat(F.lit("single:"), F.col("v")).alias("cluster"), F.col("v").alias("name"))
    return named.select("v", "cluster", "name").unionByName(alone)


def map_mentions(mentions: DataFrame, clusters: DataFrame, mention: str = "software") -> DataFrame:
    """Rows with mapped_to_software: the entity's name, or the mention itself."""
    named = clusters.select(F.col("v").alias(mention), F.col("name").alias("_name"))
    return mentions.join(named, mention, "left").withColumn("mapped_to_software", F.coalesce("_name", mention)).drop("_name")
