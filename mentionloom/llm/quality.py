"""Quality rules: text statistics, and a logistic regression over hashed word and character n-grams.

The model is trained on labelled rows, its logits are calibrated (Platt, 1999) on rows that it wasn't trained on,
and it scores whole texts in Arrow batches against a fixed threshold."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.llm.common import Vocabulary, freed, small_batches

#: Features are hashed into so many weights.
DIMENSIONS = 1 << 18
#: Byte n-grams and word n-grams; each family's shares sum to 1 in a text.
CHARS, WORDS = (3, 5), (1, 2)
#: A document stays if the calibrated probability of good quality is no less.
THRESHOLD = 0.5
#: Most labelled rows of each class that are taken for training.
TRAINING_ROWS = 2000
#: Parts of the labelled rows, one of which calibrates, and the fewest rows of a class that may do so alone.
FOLDS, FEWEST = 5, 50
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"


@dataclass
class Statistics:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() >> 21:
        # the vocabulary may number more words than three of which fit into a key; a text itself rarely has as many
        ids = np.unique(ids, return_inverse=True)[1]
    if ids.max() >> 21:
        order = np.lexsort((ids[2:], ids[1:-1], ids[:-2]))
        same = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (ids[:-2], ids[1:-1], ids[2:])])
    else:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
    at = np.union1d(order[1:][same], order[:-1][same])
    hit = np.zeros(len(ids), bool)
    for i in range(3):
        hit[at + i] = True
    return int(hit.sum())


def statistics(text: str | None, words: list[bytes], ids: np.ndarray) -> Statistics:
    """Counts over a whole text; ``ids`` number its words, equal for equal words only."""
    if not text:
        return Statistics()
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return Statistics(len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids))


def hashed_ngrams(raw: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of a text's n-grams, an array a family. 32-bit arithmetic that wraps keeps this vectorised."""
    prime, spread, shift = np.uint32(16777619), np.uint32(0x9E3779B1), np.uint32(14)
    out = []
    for units, sizes, start in ((np.frombuffer(raw, np.uint8).astype(np.uint32), CHARS, 0), ((hashes >> np.uint64(32)).astype(np.uint32), WORDS, 100)):
        for n in sizes:
            m = len(units) - n + 1
            if m > 0:
                h = units[:m] + np.uint32(start + n)
                for i in range(1, n):
                    h *= prime
                    h += units[i : m + i]
                h *= spread
                h ^= h >> np.uint32(15)
                h *= spread
                h >>= shift
                out.append(h)
    return out


def features(raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their shares, which sum to 1 in each family."""
    families = hashed_ngrams(raw, hashes)
    if not families:
        return np.zeros(0, np.int64), np.zeros(0)
    index = np.concatenate(families).astype(np.int64)
    value = np.concatenate([np.full(len(h), 1.0 / len(h)) for h in families])
    unique, inverse = np.unique(index, return_inverse=True)
    return unique.astype(np.int32), np.bincount(inverse, value).astype(np.float32)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: bytes, hashes: np.ndarray) -> float:
        """Calibrated probability of good quality; every n-gram of the text counts."""
        z = sum(float(self.weights.take(h).mean(dtype=np.float64)) for h in hashed_ngrams(raw, hashes))
        z = self.slope * (z + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed labels; a row counts as often as its weight."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w, g = weight * (p * (1 - p) + 1e-6), weight * (p - t)
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def train(rows: list[tuple[str, int, float]], epochs: int = 6, rate: float = 0.3) -> QualityModel | None:
    """A model from (text, quality, weight) rows; None unless both classes are there. One row in FOLDS calibrates, by weight.
    Where these are fewer than FEWEST of a class, all rows calibrate, each by a model of the folds that it isn't in, and
    the model is that of all rows: a handful would move the threshold by chance."""
    words = Vocabulary()
    # two long arrays, whose memory goes back when they do; that of many short ones would stay with the process
    every, shares, ends, known = array("i"), array("f"), [0], []
    for text, quality, weight in rows:
        raw = (text or "").encode("utf-8", "surrogatepass")
        w = raw.split()
        index, value = features(raw, words.hashed(w))
        words.trim()
        if len(index):
            every.frombytes(index.tobytes()), shares.frombytes(value.tobytes())
            ends.append(len(every)), known.append((int(quality), weight))
    every, shares = np.frombuffer(every, np.int32), np.frombuffer(shares, np.float32)
    parts = [(every[s:e], shares[s:e], *k) for s, e, k in zip(ends, ends[1:], known, strict=False)]
    folds = [[p for i, p in enumerate(parts) if i % FOLDS != k] for k in range(FOLDS)]
    if len({p[2] for p in folds[0]}) < 2:
        return None
    held = parts[::FOLDS]
    weights, bias = _fit(folds[0], epochs, rate)
    z = [_logit(weights, bias, p) for p in held]
    if min(sum(p[2] == k for p in held) for k in (0, 1)) < FEWEST and all(len({p[2] for p in fold}) == 2 for fold in folds):
        for k in range(1, FOLDS):
            other = _fit(folds[k], epochs, rate)
            z += [_logit(*other, p) for p in parts[k::FOLDS]]
            held = held + parts[k::FOLDS]
        weights, bias = _fit(parts, epochs, rate)
    y, weight = (np.array([p[k] for p in held], float) for k in (2, 3))
    slope, shift = _platt(np.array(z), y, weight) if len(set(y)) > 1 else (1.0, 0.0)
    return QualityModel(weights.astype(np.float32), bias, slope, shift)


def _logit(weights: np.ndarray, bias: float, row: tuple) -> float:
    return float(weights[row[0]] @ row[1]) + bias


def _fit(fit: list[tuple], epochs: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias from (features, shares, quality, weight) rows of both classes, which weigh the same in all."""
    weights, seen, bias, bias_seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8), 0.0, 1e-8
    random = np.random.default_rng(7)
    share = sum(p[2] for p in fit) / len(fit)
    for _ in range(epochs):
        for i in random.permutation(len(fit)):
            index, value, y, _ = fit[i]
            z = float(weights[index] @ value) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * (0.5 / share if y else 0.5 / (1 - share))
            step = g * value
            seen[index] += step * step
            weights[index] -= rate * step / np.sqrt(seen[index])
            bias_seen += g * g
            bias -= rate * g / np.sqrt(bias_seen)
    return weights, bias


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[str, int, float]]:
    """Up to ``most`` rows of each class, in hash order of their ids, each with the number of its class's ids that it
    stands for. Ids with both classes or none are left out."""
    one = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_top")).filter("_y = _top")
    order = [F.xxhash64(F.lit(11), "_id"), F.col("_id")]
    picked = one.filter("_y = 0").orderBy(*order).limit(most).unionByName(one.filter("_y = 1").orderBy(*order).limit(most)).select("_id", "_y")
    stands = {r["_y"]: max(1.0, r["count"] / most) for r in one.groupBy("_y").count().collect()}
    # at most 2 * most rows of two numbers are broadcast
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")
    rows = rows.orderBy(*order, "_text").limit(2 * most).collect()
    return [(r["_text"], r["_y"], stands[r["_y"]]) for r in rows]


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> QualityModel | None:
    """The model of the labelled rows. Nothing but it stays in the driver's memory, which all later stages need."""
    model = train(labelled_rows(docs, labels, key=key, text=text))
    freed()
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, the statistics, base_failed, probability and kept of every row.

    A null or empty text has no words and fails the base rules. Without a model, probability is null and the base
    rules alone decide. Rows are independent: repeated rows and ties get equal results, other columns don't matter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m, words = shared.value, Vocabulary()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                w = raw.split()
                ids = words.number(w)
                s = statistics(t, w, ids)
                p = None
                if m is not None:
                    p = m.probability(raw, words.hashed(w, ids))
                words.trim()
                out.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, p, not s.base_failed and (p is None or p >= threshold)))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(score, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")
    return out.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. The verdict is made beside the row."""
    model = trained(docs, labels, key=key, text=text)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("key"), F.col(text).alias("text"))
    return score_quality(packed, model, key="key", text="text").filter("kept").select(*[F.col(f"key.{n}").alias(c) for c, n in names.items()])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, with the model trained on the labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, trained(docs, labels))
