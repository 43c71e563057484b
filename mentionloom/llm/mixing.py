"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source's documents are shuffled by a hash and laid end to end; that stream is cut into blocks of equal
size. Slot n of the schedule is the golden-ratio point frac(n * phi), read off the cumulative target weights: the
interval that holds it names the slot's source. The k-th slot of a source takes its k-th block, and starts over
after the last one. So every prefix of the schedule has the target mix to within a few blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.llm.common import n_words, written

#: Points have 32 bits: n * GOLDEN mod 2^32, GOLDEN = round(2^32 / phi), odd.
GOLDEN, CIRCLE = 2654435769, 1 << 32
#: The circle is cut into so many cells; a slot meets the sources of its cell by an equi-join.
CELLS = 4096
#: Documents (or slots) of a source that one window orders.
CHUNK = 2048


def golden_point(n: Column) -> Column:
    """n * GOLDEN mod 2^32 without leaving 64 bits."""
    low = F.pmod(n, F.lit(CIRCLE))
    high = F.pmod(low * F.lit(GOLDEN >> 16), F.lit(CIRCLE)) * F.lit(1 << 16)
    return F.pmod(high + low * F.lit(GOLDEN & 0xFFFF), F.lit(CIRCLE))


def targets(sources: DataFrame, total_share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """From one row a source (src, no_src, source_size): place by name, weight, target.

    Sharing again by weight what exceeds ``repeats`` times a source's size ends where every target is
    min(cap, level * weight): sources are capped in the order of cap / weight up to the first that isn't."""
    by_name, everything = Window.orderBy("no_src", "src"), Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    upto = by_need.rowsBetween(Window.unboundedPreceding, 0)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * repeats)
    s = s.withColumn("goal", F.sum("source_size").over(everything) * F.lit(total_share)).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("full", F.max((F.col("level") * F.col("weight") < F.col("cap")).cast("int")).over(upto) == 0)
    # the level at the first source that isn't capped holds for all that follow
    s = s.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")))
    return s.select("src", "no_src", "source_size", "rows", "place", "weight", target.alias("target"))


def prefix(df: DataFrame, group: list[str], order: list[str], chunk: str, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, in two steps: over chunks, then inside a chunk.
    ``chunk`` must not decrease in the given order. No window holds a whole group."""
    sums = df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, chunk, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*group, chunk]).withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_offset")).drop("_offset")


def mix(docs: DataFrame, total_share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", blocks: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule). documents: doc_id, size, source_size, target and taken for every
    row of ``docs``; schedule: slot, place (the source's), block.

    A block is 1/``blocks`` of all words, 64 at least and 65,536 at most. Null texts have size 0 and are never taken; null sources form one
    source, placed last; equal rows are rows of their own; an empty table gives empty ones."""
    sized = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(source).isNull().alias("no_src"), n_words(text).alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long").alias("h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    )
    sized = written(sized, "mix-sizes")
    sources = sized.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = targets(sources, total_share, repeats, weights)
    everything = Window.partitionBy()
    block = F.greatest(F.lit(64), F.least(F.lit(65_536), F.floor(F.sum("source_size").over(everything) / blocks))).cast("long")
    sources = sources.withColumn("block", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # a source's share of the slots: its target, in blocks of its own stream
    sources = sources.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n_blocks")).otherwise(0.0))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.withColumn("slots", F.sum("share").over(everything)).withColumn("high", F.sum("share").over(upto))
    edge = lambda c: F.least(F.lit(CIRCLE), F.greatest(F.lit(0), F.round(F.coalesce(F.try_divide(c, F.col("slots")), F.lit(0.0)) * CIRCLE).cast("long")))
    last = F.max(F.when(F.col("share") > 0, F.col("place"))).over(everything)
    sources = sources.withColumn("to", F.when(F.col("place") == last, F.lit(CIRCLE)).otherwise(edge(F.col("high")))).withColumn("from", edge(F.col("high") - F.col("share")))
    sources = sources.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("place")), F.lit(0))).drop("high")
    sources = written(sources, "mix-sources")

    n_slots = int(sources.agg(F.max("slots")).first()[0] or 0)
    cells = sources.filter("to > from").select("place", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / (CIRCLE // CELLS)), F.floor((F.col("to") - 1) / (CIRCLE // CELLS)))).alias("cell"))
    points = docs.sparkSession.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x"))
    slots = points.withColumn("cell", F.floor(F.col("x") / (CIRCLE // CELLS))).join(cells, "cell").filter("x >= from and x < to")
    slots = slots.select("slot", "place", F.floor(F.col("slot") / (8 * CHUNK)).alias("run"))
    ranked = prefix(slots, ["place"], ["slot"], "run", F.lit(1), "rank")
    # what rounding adds beyond the cap isn't taken
    schedule = ranked.join(sources.select("place", "n_blocks"), "place").filter(F.col("rank") < F.col("n_blocks") * repeats)
    schedule = schedule.select("slot", "place", F.pmod("rank", "n_blocks").alias("block"))

    rows = sized.join(sources.select("src", "no_src", "place", F.col("rows").alias("n"), "block", "source_size", "target"), ["src", "no_src"])
    rows = rows.withColumn("chunk", F.floor(F.col("h") / CIRCLE * F.ceil(F.col("n") / CHUNK)))
    laid = prefix(rows, ["place"], ["h", "doc_id", "crc", "size"], "chunk", F.col("size"), "at")
    laid = laid.select("doc_id", "size", "source_size", "target", "place", "at", "block", "crc", "h")
    pieces = laid.filter("size > 0").select("doc_id", "size", "source_size", "target", "place", "at", "crc", F.col("block").alias("width"), F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))).alias("block"))
    inside = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("width")) - F.greatest(F.col("at"), F.col("block") * F.col("width"))
    takes = schedule.groupBy("place", "block").agg(F.count("*").alias("takes"))
    taken = pieces.withColumn("inside", inside).join(takes, ["place", "block"], "left").groupBy("doc_id", "size", "source_size", "target", "place", "at", "crc").agg(F.sum(F.col("inside") * F.coalesce("takes", F.lit(0))).alias("taken"))
    cols = ["doc_id", "size", "source_size", "target", "taken", "crc", "place"]
    return taken.select(*cols).unionByName(laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols)), schedule


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (its taken words over its size, rounded); all columns.

    A source's stream is passed whole times and then up to one cut, so few documents are taken in part. Rows that
    share id and text are taken equally often."""
    taken = mix(docs, key=key, text=text, **options)[0]
    copies = F.round(F.avg(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    copies = taken.groupBy(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc")).agg(copies.alias("_copies")).filter("_copies > 0")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    crc = F.crc32(F.coalesce(F.col(names[text]), F.lit("")).cast("binary"))
    joined = plain.join(copies, F.col(names[key]).eqNullSafe(F.col("_id")) & (crc == F.col("_crc")))
    return joined.withColumn("_again", F.explode(F.sequence(F.lit(1), "_copies"))).select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2 by turns."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].select("doc_id", "size", "source_size", "target", "taken")
