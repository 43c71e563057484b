"""Near-duplicate vectors by spherical-cap filters (Becker, Ducas, Gama and Laarhoven, 2016).

Filter directions form a random product code: a random rotation, then blocks of coordinates with a codebook of random
unit vectors each; a direction is one code word of every block. A vector belongs to all filters whose direction it
exceeds by ALPHA; these are list-decoded from the sorted products by block, without visiting the others. One that
exceeds few directions belongs to its nearest FEWEST instead. Vectors that share a filter are compared in double precision."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.llm.common import small_batches, written
from mentionloom.llm.components import components

#: Vectors link from this cosine on.
LEAST_COSINE = 0.98
#: Code words of a block at least, and blocks. 2 blocks of 128 words are 16,384 filters.
WORDS, BLOCKS = 128, 2
#: Members that a filter has on average at most; with more vectors there are more words.
MEMBERS = 2048
#: Members of a filter that a task holds, twice at most; those of a fuller one are compared part by part.
PART = 8192
#: Filters that a random vector is in, expected; the threshold follows from the dimension. Of a pair with the least
#: cosine about three quarters of one's filters are the other's too, and some vectors are in far
#: fewer than others.
FILTERS_EACH = 40
#: Filters that any vector is in at least.
FEWEST = 32
#: Rows of a filter that are compared at once.
TILE = 1024


@dataclass
class ProductCode:
    """Filter directions for one dimension."""

    dim: int
    words: int = WORDS
    blocks: int = BLOCKS
    each: float = FILTERS_EACH

    def __post_init__(self) -> None:
        random = np.random.default_rng(1000 + self.dim)
        # in few dimensions filters would be few and alike; a rotation into 64 makes any vector a general one
        self.width = -(-max(64, self.dim) // self.blocks)
        padded = self.width * self.blocks
        self.rotation = np.linalg.qr(random.standard_normal((padded, padded)))[0][: self.dim]
        books = random.standard_normal((self.blocks, self.words, self.width))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True)
        # the threshold that a random unit vector exceeds in the wanted share of directions
        sample = random.standard_normal((2000, self.dim))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        codes = random.integers(0, self.words, (2000, self.blocks))
        products = self.products(sample)
        sums = sum(products[:, k][:, codes[:, k]] for k in range(self.blocks))
        self.alpha = float(np.quantile(sums, 1 - min(0.5, self.each / self.words**self.blocks)))

    def products(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, blocks, words): what each code word adds to the product with a direction, times sqrt(blocks)."""
        turned = (unit @ self.rotation).reshape(len(unit), self.blocks, self.width)
        return np.einsum("vbw,bcw->vbc", turned, self.books)

    def decode(self, products: np.ndarray) -> np.ndarray:
        """All filters of one vector, from its products by block: extend a list of partial sums block by block and
        drop those that the best words of the remaining blocks can't lift over the threshold."""
        best = products.max(1)
        rest = np.concatenate([np.cumsum(best[::-1])[::-1][1:], [0.0]])
        sums, codes = np.zeros(1), np.zeros(1, np.int64)
        for k in range(self.blocks):
            order = np.argsort(-products[k])
            down = -products[k][order]
            # words of this block that keep a partial sum alive are a prefix of the sorted ones
            take = np.searchsorted(down, sums + rest[k] - self.alpha, side="right")
            parent = np.repeat(np.arange(len(sums)), take)
            word = order[np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)]
            sums, codes = sums[parent] + products[k][word], codes[parent] * self.words + word
        return np.sort(codes)

    def nearest(self, products: np.ndarray, most: int) -> np.ndarray:
        """The filters of one vector with the greatest sums. What begins one of them is among the best of its length."""
        sums, codes = np.zeros(1), np.zeros(1, np.int64)
        for k in range(self.blocks):
            word = np.argsort(-products[k], kind="stable")[:most]
            sums, codes = (sums[:, None] + products[k][word]).ravel(), (codes[:, None] * self.words + word).ravel()
            best = np.argsort(-sums, kind="stable")[:most]
            sums, codes = sums[best], codes[best]
        return np.sort(codes)

    def filters(self, products: np.ndarray) -> np.ndarray:
        """All filters of one vector over the threshold, or its nearest FEWEST where these are more."""
        found = self.decode(products)
        return found if len(found) >= FEWEST else self.nearest(products, FEWEST)


def normalised(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares don't overflow."""
    unit = raw / np.abs(raw).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def link_tile(left: tuple, right: tuple, filter_: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two tiles that link and whose first common filter is this one. A tile: unit vectors, filters of each."""
    hit = left[0] @ right[0].T >= least
    if same:
        hit &= np.tri(len(hit), k=-1, dtype=bool)
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    # shared earlier filters, by a product of incidence matrices over the rows that link at all
    earlier_l, earlier_r = [left[1][i][left[1][i] < filter_] for i in rows], [right[1][j][right[1][j] < filter_] for j in cols]
    every, number = np.unique(np.concatenate([*earlier_l, *earlier_r]), return_inverse=True)
    if len(every):
        a, b = np.zeros((len(rows), len(every)), np.float32), np.zeros((len(cols), len(every)), np.float32)
        n = sum(map(len, earlier_l))
        a[np.repeat(np.arange(len(rows)), [len(x) for x in earlier_l]), number[:n]] = 1
        b[np.repeat(np.arange(len(cols)), [len(x) for x in earlier_r]), number[n:]] = 1
        hit[np.ix_(rows, cols)] &= a @ b.T == 0
    return np.nonzero(hit)


def _union(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that keep the components of the pairs: each member to the smallest."""
    root = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for a, b in pairs:
        for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def words_for(vectors: int, each: float = FILTERS_EACH, blocks: int = BLOCKS) -> int:
    """Code words of a block by which a filter has MEMBERS on average."""
    return max(WORDS, int(np.ceil((vectors * each / MEMBERS) ** (1 / blocks))))


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", words: int | None = None, blocks: int = BLOCKS, each: float = FILTERS_EACH) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    Only vectors of one label and one dimension are compared; null labels, and vectors that are null, empty, zero or
    have null or non-finite components, link with nothing. Equal vectors form a class that is compared once: its
    members link with each other and share all links, so copies never multiply. Classes have numbers of their own, so keys may
    have any type that has an order: rows with one key, or none, count as that many vectors, and null is no smallest key.
    ``words`` grows as the number of vectors to the power 1 / ``blocks``, so that a filter keeps its size; one with many
    members all the same is dealt out to tasks by pairs of its parts, and gives counts and spanning links only, never its pairs."""
    small_batches(vectors.sparkSession)
    # what moves is as narrow as it was given
    component = np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value, and so is a vector with either
    rows = rows.select("key", "label", F.when(fine, F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))).alias("v"))
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    size = words or words_for(classes.count(), each, blocks)

    def filters(batches):
        codes: dict[int, ProductCode] = {}
        for b in batches:
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            found, units = [None] * len(lengths), [None] * len(lengths)
            for dim in np.unique(lengths):
                code = codes.setdefault(int(dim), ProductCode(int(dim), size, blocks, each))
                of = np.flatnonzero(lengths == dim)
                raw = flat[at[of][:, None] + np.arange(dim)]
                products = code.products(normalised(raw))
                for i, row in enumerate(of):
                    found[row], units[row] = code.filters(products[i]), raw[i].astype(component).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(lengths.astype(np.int32)), pa.array(found, pa.list_(pa.int64())), pa.array(units, pa.binary())], names=["id", "label", "copies", "dim", "filters", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = written(classes.select("id", "v", "label", "copies").mapInArrow(filters, f"id long, label {kind}, copies long, dim int, filters array<long>, unit binary"), "filters")
    full = coded.select("label", "dim", F.explode("filters").alias("filter")).groupBy("label", "dim", "filter").count().filter(F.col("count") > PART)
    full = written(full.select("label", "dim", "filter", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "full-filters")
    spread = coded.select("*", F.explode("filters").alias("filter")).join(full, ["label", "dim", "filter"], "left")
    # every two parts of a filter meet in one group
    spread = spread.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), "parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    spread = spread.select("label", "dim", "filter", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "copies", "unit", "filters")
    group = ["label", "dim", "filter", "low", "high"]
    # rows of a group come together in one partition, one after the other
    dealt = spread.repartition(*group).sortWithinPartitions(*group, "part", "id")

    def compare(batches):
        held, held_key = [], None
        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in group), strict=True))
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for s, e in zip(starts, starts[1:], strict=False):
                if s == e:
                    continue
                if held and keys[s] != held_key:
                    yield from compared(held, held_key)
                    held = []
                held_key = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from compared(held, held_key)

    def compared(batches, of_key):
        n = sum(len(p) for p in batches)
        if n < 2:
            return
        table = pa.Table.from_batches(batches)
        ids, copies, part = table["id"].to_numpy(), table["copies"].to_numpy(), table["part"].to_numpy()
        unit = normalised(np.frombuffer(b"".join(table["unit"].to_pylist()), component).reshape(n, -1).astype(np.float64))
        lists = table["filters"].combine_chunks()
        of = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets.to_numpy()[0])
        # one part with itself, or the first one with the second
        whole, filter_ = of_key[3] == of_key[4], of_key[2]
        border = n if whole else int(np.searchsorted(part, of_key[4]))
        links, pairs = np.zeros(n, np.int64), []
        for i in range(0 if whole else border, n, TILE):
            for j in range(0, i + 1 if whole else border, TILE):
                left, right = slice(i, i + TILE), slice(j, j + TILE if whole else min(j + TILE, border))
                a, b = link_tile((unit[left], of[left]), (unit[right], of[right]), filter_, least, whole and i == j)
                a, b = a + i, b + j
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                pairs.append((a, b))
        touched = np.flatnonzero(links)
        if len(touched):
            tree = _union(ids, pairs)
            other = pa.array([None] * len(touched) + [y for _, y in tree], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[touched], np.array([x for x, _ in tree], np.int64)])), other, pa.array(np.concatenate([links[touched], np.zeros(len(tree), np.int64)]))], names=["id", "other", "links"])

    found = written(dealt.mapInArrow(compare, "id long, other long, links long"), "vector-links")
    joined = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    degree = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(degree, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = of_class.groupBy("component").agg(F.min("key").alias("low"))
    of_class = of_class.join(low, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "low", F.lit(True).alias("linked"))
    out = rows.join(of_class, (rows.label == of_class.label) & (rows.v == of_class.v), "left").select(rows.key.alias("key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("low")).otherwise(rows.key).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, by cosine in their label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("component_id", F.col("component_id").cast("long"))
