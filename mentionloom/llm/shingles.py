"""Exact Jaccard self-join of documents by their 5-word shingles, as a metric-space join.

The Jaccard distance 1 - |x & y| / |x | y| is a metric, and unrelated documents are at distance 1 from each other, so
documents make poor pivots for a whole corpus. The first level therefore takes single shingles as pivots: a document
belongs to the regions of its rarest shingles, as many as a partner at distance 1/4 can't all lack. Where a pair's first
common shingle stands bounds its intersection, so most members of a region rule each other out by two numbers each.

Small regions join directly. In larger ones documents are the pivots: whatever may be near the pivot is measured, what is
within 1/4 of it forms its Voronoi cell together with all that links there, and cells are joined again. A region is done
when it is one cell. Otherwise few pairs of different cells pass the triangle-inequality windows |d(x, p) - d(y, p)| <= 1/4
and the windows of size, and are measured, or every cell gets a pivot of its own, four times as many a round."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.llm.common import Vocabulary, buckets_for, dropped, freed, lower_ascii, mix64, small_batches, written
from mentionloom.llm.components import components

WORDS = 5
#: Regions of up to so many documents join directly.
LEAF = 8
#: Members of a region that a task holds at once; of a larger one each is passed on as it comes.
HELD = 1 << 16
#: Pairs of a region's cells that are measured without another pivot, a member.
PAIRS_EACH = 16
#: Rounds of more pivots; from then on what the windows leave is measured.
ROUNDS = 4
#: Sizes of one band differ by less than this factor.
BAND = 1.05
#: Shingles whose counts order the pivots; all others count as rare. Only speed depends on it, and 4 MB are broadcast.
FREQUENT = 1 << 18
#: Shingles that a task sorts at once, and how many of their documents have one that is counted.
FLUSH, SEEN = 2_000_000, 3
#: So many names of documents are broadcast at most, in a few megabytes; the texts of more are dealt out by name.
NAMED = 1 << 17
#: Rows of the regions that are handled at once.
ROWS = 1 << 17
#: Bits of a hash that a sketch counts by.
SKETCH = 9
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: Vocabulary) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; with fewer words, of its words as one."""
    w = lower_ascii(text).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = words.hashed(w)
    n = min(WORDS, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        out = out * GOLD + h[i : len(w) - n + 1 + i]
    words.trim()
    return np.unique(mix64(out + np.uint64(n)))


def print_of(shingles: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def sketch_of(shingles: np.ndarray) -> bytes:
    """Numbers of shingles by the top bits of their hashes. The distance of two sketches, term by term, is at most the
    size of the sets' symmetric difference, which a link allows to be (na + nb) / 7."""
    counts = np.bincount((shingles >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
    return zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, 255).astype(np.uint8).tobytes())


def prefix_length(n: int) -> int:
    """So many shingles in the common order hold one that any partner of a set of n has as well."""
    return n - (3 * n + 3) // 4 + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def summaries(rows: DataFrame) -> DataFrame:
    """From key, text, mark: one row a document (key, n, fp, sketch, mark), and rows of shingles that are frequent in a part
    of the documents (hash, count). A set counts once in a task, however often it comes."""

    def work(batches):
        words, held, seen, size = Vocabulary(), [], set(), 0
        kind = None

        def flush():
            if held:
                every = np.sort(np.concatenate(held))
                starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                count = np.diff(np.append(starts, len(every)))
                often = np.flatnonzero(count >= SEEN)
                none = lambda t: pa.nulls(len(often), t)
                yield pa.RecordBatch.from_arrays([none(kind), none(pa.int64()), none(pa.int64()), _signed(every[starts[often]]), pa.array(count[often]), none(pa.binary()), none(pa.int64())], names=names)

        names = ["key", "n", "fp", "hash", "count", "sketch", "mark"]
        for b in batches:
            kind = b.column(0).type
            ns, fps, sketches = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_set(t, words)
                ns.append(len(h)), fps.append(print_of(h) if len(h) else None), sketches.append(sketch_of(h) if len(h) else None)
                if len(h) and fps[-1] not in seen:
                    seen.add(fps[-1]), held.append(h)
                    size += len(h)
            rest = [pa.nulls(len(ns), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), *rest, pa.array(sketches, pa.binary()), b.column(2)], names=names)
            if size >= FLUSH:
                yield from flush()
                held, seen, size = [], set(), 0
        yield from flush()
        words, held, seen = None, [], set()
        freed()

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {key}, n long, fp long, hash long, count long, sketch binary, mark long")


class Order:
    """The common order of shingles: those that aren't frequent by hash, then the frequent ones by count and hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def prefix(self, h: np.ndarray) -> np.ndarray:
        count = np.zeros(len(h), np.int64)
        if len(self.hashes):
            row = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            count = np.where(self.hashes[row] == h, self.counts[row], 0)
        return h[np.lexsort((h, count))[: prefix_length(len(h))]]


def may_link(na, place_a, nb, place_b):
    """Whether sets may link whose first common shingle is at these places: no more than what follows can be shared. So
    the smaller one has it in its first seventh, and of two members of a region that haven't, none can link."""
    return (3 * (na + nb) <= 7 * (na - place_a)) & (3 * (na + nb) <= 7 * (nb - place_b))


def regions(rows: DataFrame, order, buckets: int) -> DataFrame:
    """Candidate pairs (a, b; s null) of small regions, and the members (s, a, n, place) of larger ones. Regions come sorted
    and pass through a task as a stream, so none has to fit into memory."""

    def spread(batches):
        words, seen, size, parts = Vocabulary(), set(), 0, []

        def flush():
            if parts:
                counts = np.array([len(p) for p, _, _ in parts])
                fp, n = (np.repeat(np.array([x[k] for x in parts], np.int64), counts) for k in (1, 2))
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate([p for p, _, _ in parts])), pa.array(fp), pa.array((n << 32) | place)], names=["s", "fp", "at"])

        for b in batches:
            for t in b.column(0).to_pylist():
                h = shingle_set(t, words)
                if len(h) and (fp := print_of(h)) not in seen:
                    seen.add(fp)
                    parts.append((order.value.prefix(h), fp, len(h)))
                    size += len(parts[-1][0])
            if size >= ROWS:
                yield from flush()
                parts, size = [], 0
                if len(seen) > 200_000:
                    seen = set()
        yield from flush()
        words, parts, seen = None, [], set()
        freed()

    def join(s, fp, n, place):
        """Pairs of whole regions that are small, and members of those that aren't."""
        if not len(s):
            return
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.append(starts, len(s)))
        # a link's smaller set has the shingle in its first seventh
        live = (sizes > 1) & (np.add.reduceat((7 * place <= n).astype(np.int64), starts) > 0)
        pairs = []
        for k in range(2, LEAF + 1):
            first = starts[live & (sizes == k)]
            for i in range(k):
                for j in range(i + 1, k):
                    a, b = first + i, first + j
                    ok = may_link(n[a], place[a], n[b], place[b])
                    pairs.append(np.sort(np.stack([fp[a[ok]], fp[b[ok]]]), axis=0))
        ab = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield out(*ab)
        of = np.repeat(live & (sizes > LEAF), sizes)
        yield out(fp[of], None, s[of], n[of], place[of])

    def out(a, *rest):
        return pa.RecordBatch.from_arrays([pa.array(a), *[pa.array(x) if x is not None else pa.nulls(len(a), pa.int64()) for x in (*rest, None, None, None)][:4]], names=["a", "b", "s", "n", "place"])

    def stream(batches):
        none = np.zeros(0, np.int64)
        held, size, left, passing = [], 0, (none, none, none), None

        def work():
            s, fp, at = (np.concatenate([x, *[c[k] for c in held]]) for k, x in enumerate(left))
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])]) if len(s) else np.zeros(0, bool)
            if passing is not None:
                new[0] = False  # its last row, which has been passed on
            return s[new], fp[new], at[new] >> 32, at[new] & 0xFFFFFFFF

        for b in batches:
            if not len(b):
                continue
            held.append([b.column(k).to_numpy() for k in range(3)])
            size += len(b)
            if size < ROWS:
                continue
            s, fp, n, place = work()
            last = held[-1][0][-1]
            if passing is not None:
                go = s == passing
                yield out(fp[go], None, s[go], n[go], place[go])
                s, fp, n, place = (x[~go] for x in (s, fp, n, place))
            end = np.searchsorted(s == last, True)  # regions but for the last one are whole
            yield from join(s[:end], fp[:end], n[:end], place[:end])
            s, fp, n, place = (x[end:] for x in (s, fp, n, place))
            if passing != last:
                passing = None
            if len(s) > HELD:
                passing = last
                yield out(fp, None, s, n, place)
            if passing is None:
                left = (s, fp, (n << 32) | place)
            else:
                left = tuple(x[-1:] for x in held[-1])
            held, size = [], 0
        s, fp, n, place = work()
        if passing is not None:
            go = s == passing
            yield out(fp[go], None, s[go], n[go], place[go])
            s, fp, n, place = (x[~go] for x in (s, fp, n, place))
        yield from join(s, fp, n, place)

    spread_out = rows.select("text").mapInArrow(spread, "s long, fp long, at long")
    dealt = spread_out.repartition(buckets, "s").sortWithinPartitions("s", "fp")
    return dealt.mapInArrow(stream, "a long, b long, s long, n long, place long")


def measured(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) with the exact size of the intersection, without pairs that their sketches rule out. Only
    documents that the other pairs name are read into sets."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in "ab":
        pairs = pairs.join(classes.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)

    def may(batches):
        read = zstandard.ZstdDecompressor().decompress
        for b in batches:
            n = b["n_a"].to_numpy() + b["n_b"].to_numpy()
            near = [7 * int(np.abs(np.frombuffer(read(x), np.uint8).astype(np.int16) - np.frombuffer(read(y), np.uint8)).sum()) <= m for x, y, m in zip(b["sketch_a"].to_pylist(), b["sketch_b"].to_pylist(), n, strict=True)]
            kept = pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"])
            yield kept.filter(pa.array(near, pa.bool_()))

    pairs = written(pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(may, "a long, b long"), "pairs")
    named = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    # written down and counted: all texts stay where they are for a few
    keys = written(named.join(classes.select("fp", "first"), "fp").select(F.col("first.key").alias("_key"), F.col("first.mark").alias("_mark"), "fp"), "named")

    def sets(batches):
        words, seen = Vocabulary(), set()
        for b in batches:
            kept = []
            for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f not in seen:
                    h = shingle_set(t, words)
                    if len(h) and print_of(h) == f:
                        seen.add(f), kept.append((f, h))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in kept], pa.int64()), pa.array([h.tobytes() for _, h in kept], pa.binary())], names=["fp", "shingles"])

    some = F.broadcast(keys) if keys.count() <= NAMED else keys
    texts = docs.join(some, docs.key.eqNullSafe(some._key) & (docs.mark == some._mark)).select("text", "fp")
    # rows with one id and one text may give a set more than once; the distances are made distinct below
    found = written(texts.mapInArrow(sets, "fp long, shingles binary"), "sets")

    def meet(batches):
        for b in batches:
            a, c = ([np.frombuffer(x, np.uint64) for x in b[k].to_pylist()] for k in ("sa", "sb"))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array([len(x) for x in a], pa.int64()), pa.array([len(x) for x in c], pa.int64()), pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])

    one = pairs.join(found.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(found.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    out = written(two.select("a", "b", "sa", "sb").mapInArrow(meet, "a long, b long, na long, nb long, both long").distinct(), "distances")
    dropped(pairs, keys, found)
    return out


LINKED = "100 * both >= 75 * (na + nb - both)"


def _fits(x: str, y: str) -> Column:
    """may_link for the members x and y of a join, of different cells, inside the windows of all pivots that both are measured from."""
    c = lambda name, k: F.col(f"{name}_{k}")
    fits = may_link(c("n", x), c("place", x), c("n", y), c("place", y)) & (c("cell", x) != c("cell", y))
    near = lambda p: F.coalesce(F.abs(c("d", x)[p] - c("d", y)[p]) <= 0.25 + 1e-9, F.lit(True))
    return fits & F.coalesce(F.forall(F.map_keys(c("d", x)), near), F.lit(True))


def _side(members: DataFrame, k: str, *more: str) -> DataFrame:
    return members.select("s", *more, *[F.col(c).alias(f"{c}_{k}") for c in ("fp", "n", "place", "cell", "d", "main")])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b"))


def pivots_of(members: DataFrame, most: int) -> DataFrame:
    """(s, p) of the ``most`` largest cells of each region: the member with the fewest rarer shingles, in its first seventh."""
    cells = members.groupBy("s", "cell").agg(F.count("*").alias("size"), F.min(F.when(F.expr("7 * place <= n"), F.struct("place", (-F.col("n")).alias("n"), "fp"))).alias("low")).filter("low is not null")
    if most == 1:
        return cells.groupBy("s").agg(F.max(F.struct("size", (-F.col("low.place")).alias("place"), "low"))["low"]["fp"].alias("p"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("size"), "low")))
    return ranked.filter(F.col("rank") <= most).select("s", F.col("low.fp").alias("p"))


def stars(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """(s, fp, p): every pivot with the members of its region that it may link with, but for those measured from it there."""
    centre = _side(members.join(pivots, (members.s == pivots.s) & (members.fp == pivots.p), "left_semi"), "y")
    new = ~F.coalesce(F.map_contains_key("d_x", F.col("fp_y")), F.lit(False))
    return _side(members, "x").join(centre, "s").filter(_fits("x", "y") & new).select("s", F.col("fp_x").alias("fp"), F.col("fp_y").alias("p"))


def star_pairs(star: DataFrame) -> DataFrame:
    return star.select(F.least("fp", "p").alias("a"), F.greatest("fp", "p").alias("b"))


def banded(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of cells, by region and the bands of both sizes. Each side, the larger and the smaller sets
    of links, has its own band and takes all bands that the places of the region's shingle leave to a partner."""
    band = lambda n: F.floor(F.log(n) / float(np.log(BAND)))
    n, most = F.col("n"), F.floor((7 * (F.col("n") - F.col("place")) - 3 * F.col("n")) / 3)
    bands = lambda low, high: F.explode(F.sequence(band(low), band(high)))
    least = F.ceil(0.75 * n)
    large = members.filter(most >= least).select("*", band(n).alias("band_x"), bands(least, F.least(n, most)).alias("band_y"))
    small = members.filter(most >= n).select("*", band(n).alias("band_y"), bands(n, F.least(F.floor(4 * n / 3), most)).alias("band_x"))
    return (_side(t, k, "band_x", "band_y") for t, k in ((large, "x"), (small, "y")))


def cell_pairs(large: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs of different cells that all windows leave; within the largest cell of a region nothing meets."""
    order = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("fp_y") < F.col("fp_x")))
    some = large.filter("not main_x").join(small, ["s", "band_x", "band_y"]).filter(order & _fits("x", "y"))
    rest = large.filter("main_x").join(small.filter("not main_y"), ["s", "band_x", "band_y"]).filter(order & _fits("x", "y"))
    return _ordered(some).unionByName(_ordered(rest))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key that links reach) and kept for every row.

    A null text, and one without words, has no shingles, links with nothing and is its own component. Equal sets are
    one class that joins once, so copies never multiply. Rows with a null key take part; their component is the smallest key
    that isn't null, null if there is none. Equal rows get equal results; other columns don't matter."""
    out = _components(docs, key, text)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark (a hash of the text), n, component (a label, null without shingles) and component_id of every row."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    first = written(summaries(rows), "shingle-sets")
    every = first.filter("hash is null").select("key", "n", "fp", "sketch", "mark")
    top = first.filter("hash is not null").groupBy("hash").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "hash").limit(FREQUENT).toArrow()
    order = spark.sparkContext.broadcast(Order(*(top[c].combine_chunks().to_numpy(zero_copy_only=False).view(kind).copy() for c, kind in (("hash", np.uint64), ("count", np.int64)))))
    classes = written(every.filter("n > 0").groupBy("fp").agg(F.min("key").alias("key"), F.min(F.struct("key", "mark")).alias("first"), F.min("n").alias("n"), F.any_value("sketch").alias("sketch")), "set-classes")

    met = written(regions(rows, order, buckets_for(docs)), "regions")
    # no two members are in one cell as yet, and none is measured
    members = met.filter("s is not null").select("s", F.col("a").alias("fp"), "n", "place", F.col("a").alias("cell"), F.lit(None).cast("map<long,double>").alias("d"), F.lit(False).alias("main"))
    star, last = stars(members, written(pivots_of(members, 1), "pivots")), False
    known = [measured(met.filter("s is null").select("a", "b").unionByName(star_pairs(star)), rows, classes)]
    for depth in range(1, ROUNDS + 1):
        # where more pivots have found nothing to measure, the windows alone leave few pairs
        last = last or depth == ROUNDS
        distances = reduce(DataFrame.unionByName, known)
        cells = written(components(distances.filter(LINKED).select("a", "b")), "cells")
        members = open_members(members, star, distances, cells)
        if members.isEmpty():
            break
        large, small = banded(members)
        if not last:
            few = _few(members, large, small)
            more = written(pivots_of(members.join(few, "s", "left_anti"), 4**depth), "pivots")
            star = stars(members, more)
            large, small = (t.join(few, "s", "left_semi") for t in (large, small))
            pairs = cell_pairs(large, small).unionByName(star_pairs(star))
        else:
            pairs = cell_pairs(large, small)
        new = pairs.distinct().join(distances.select("a", "b"), ["a", "b"], "left_anti")
        known.append(measured(new, rows, classes))
        if last:
            break
        # those whose pairs have all been measured are done
        members = members.join(few, "s", "left_anti")
        if members.isEmpty():
            break
        last = known[-1].isEmpty()
    links = reduce(DataFrame.unionByName, known).filter(LINKED).select("a", "b")
    found = components(links)
    named = classes.select("fp", "key").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("key").alias("component_id"))
    of_class = named.join(low, "component").select("fp", "component", "component_id")
    out = every.select("key", "mark", "n", "fp").join(of_class, "fp", "left")
    return out.select("key", "mark", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def open_members(members: DataFrame, star: DataFrame, distances: DataFrame, cells: DataFrame) -> DataFrame:
    """The members of regions that are more than one cell, with their cell, whether it is the region's largest, and their
    distances d from its pivots: those they had, and those that their ``star`` has found."""
    at = members.select("s", "fp", "n", "place", "d").join(cells.select(F.col("node").alias("fp"), F.col("component").alias("cell")), "fp", "left").withColumn("cell", F.coalesce("cell", "fp"))
    main = at.groupBy("s", "cell").count().groupBy("s").agg(F.max(F.struct("count", "cell"))["cell"].alias("main"), F.count("*").alias("cells")).filter("cells > 1").select("s", "main")
    at = at.join(main, "s").withColumn("main", F.col("main") == F.col("cell"))
    far = distances.select(F.col("a").alias("fp"), F.col("b").alias("p"), "na", "nb", "both").unionByName(distances.select(F.col("b").alias("fp"), F.col("a").alias("p"), "na", "nb", "both"))
    far = far.select("fp", "p", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("distance"))
    # pairs that may link, so far fewer than members times pivots
    told = star.join(far, ["fp", "p"]).groupBy("s", "fp").agg(F.map_from_entries(F.collect_set(F.struct("p", "distance"))).alias("told"))
    d = F.when(F.col("told").isNull(), F.col("d")).when(F.col("d").isNull(), F.col("told")).otherwise(F.map_concat("d", "told"))
    return written(at.join(told, ["s", "fp"], "left").withColumn("d", d).drop("told"), "members")


def _few(members: DataFrame, large: DataFrame, small: DataFrame) -> DataFrame:
    """Regions (s) whose cells make few pairs within the bands, for their members."""
    count = lambda t, k: t.groupBy("s", "band_x", "band_y").agg(F.count("*").alias(f"all_{k}"), F.count_if(~F.col(f"main_{k}")).alias(f"some_{k}"))
    met = count(large, "x").join(count(small, "y"), ["s", "band_x", "band_y"])
    met = met.groupBy("s").agg(F.sum(F.col("some_x") * F.col("all_y") + (F.col("all_x") - F.col("some_x")) * F.col("some_y")).alias("pairs"))
    size = members.groupBy("s").agg(F.count("*").alias("size"))
    return written(size.join(met, "s", "left").filter(F.coalesce("pairs", F.lit(0)) <= PAIRS_EACH * F.col("size")).select("s"), "few")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest key that isn't null, of rows with
    that key the one whose text has the smallest hash. Documents without shingles all stay."""
    rows = _components(docs, key, text).filter("n > 0")
    stay = rows.groupBy("component").agg(F.min(F.struct(F.isnull("key").alias("no"), "key", "mark")).alias("s")).select(F.col("s.key").alias("_key"), F.col("s.mark").alias("_stay")).distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("_mark", F.xxhash64(names[text]))
    # without words there are no shingles
    some = F.coalesce(F.col(names[text]).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = plain.filter(some).join(stay, F.col(names[key]).eqNullSafe(F.col("_key")) & (F.col("_mark") == F.col("_stay"))).dropDuplicates([names[key], "_mark"])
    out = kept.select(*names.values()).unionByName(plain.filter(~some).select(*names.values()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by Jaccard similarity of at least 0.75 of their 5-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
