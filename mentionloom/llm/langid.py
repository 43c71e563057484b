"""Language identification by interpolated Kneser-Ney character models, one a language.

A text is read as its runs of letters, lower-cased, each between two boundary marks; a model gives the probability
of every letter and end mark from up to ORDER - 1 characters before it in the run. All models are stored in sorted
arrays of 64-bit n-gram hashes with one column a language. The language with the lowest length-normalised
cross-entropy wins; a logistic curve over its margin and level, fitted on training texts that the models haven't
seen, tells how far to trust it."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.llm.common import dropped, mix64, small_batches, written

ORDER = 5
#: Training texts a language, expected; picked by a hash, whole texts.
TRAINING_DOCS = 400
#: Below this calibrated probability a prediction is marked as rejected.
REJECT_BELOW = 0.5
#: Every model gives this share of its unigram mass to characters it hasn't seen, out of so many.
UNSEEN, ALPHABET = 1e-3, 50_000
LETTERS = regex.compile(r"\p{L}+")
START, END = 2, 3
PAD = "\0" * (ORDER - 1) + chr(START)


class Grams:
    """Hashes of the n-grams, and of their contexts, at every letter and end mark of many runs together."""

    def __init__(self, found: list[str]):
        text = "".join([f"{PAD}{run}{chr(END)}" for run in found])
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        starts = np.cumsum(self.lengths + ORDER) - self.lengths
        #: Where the letters and end marks are, and where each run's begin among them.
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(self.lengths.sum()) + np.repeat(starts - self.firsts, self.lengths)

    def _rolled(self, n: int, ends: np.ndarray, salt: int) -> np.ndarray:
        h = np.zeros(len(ends), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + self.codes[ends - (n - 1 - i)]
        return mix64(h + np.uint64(salt))

    def grams(self, n: int, only: np.ndarray | None = None) -> np.ndarray:
        return self._rolled(n, self.at if only is None else self.at[only], n)

    def contexts(self, n: int, only: np.ndarray | None = None) -> np.ndarray:
        """The n - 1 characters before."""
        return self._rolled(n - 1, (self.at if only is None else self.at[only]) - 1, 100 + n)


@dataclass
class Models:
    languages: list[str]
    #: For each length: sorted n-gram hashes, and log probability of the last character in each language.
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    #: For each length: sorted context hashes, and log back-off weight in each language (0 where it hasn't occurred).
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    seen: list[np.ndarray]
    unseen: float
    curve: tuple[float, float, float] = (0.0, 4.0, 0.0)

    def bits(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """-log2 probability of each run in each language, and the number of characters. The longest n-gram that a
        language has decides; the weights of the longer contexts that it has apply."""
        g, count = Grams(found), len(self.languages)
        total, done = np.zeros((len(g.at), count), np.float32), np.zeros((len(g.at), count), bool)
        todo = np.arange(len(g.at))
        for n in range(ORDER, 0, -1):
            open_ = ~done[todo]
            row, known = _found(self.hashes[n - 1], g.grams(n, todo))
            hit = known[:, None] & self.seen[n - 1][row] & open_
            total[todo] += np.where(hit, self.logs[n - 1][row], 0)
            done[todo] |= hit
            todo = todo[~done[todo].all(1)]
            if not len(todo):
                break
            if n > 1:
                row, known = _found(self.contexts[n - 1], g.contexts(n, todo))
                total[todo] += np.where(known[:, None] & ~done[todo], self.weights[n - 1][row], 0)
        total[~done] += np.float32(self.unseen)
        return -np.add.reduceat(total.astype(np.float64), g.firsts, axis=0), g.lengths


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return row, keys[row] == h


def runs(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def train(counts: dict[str, Counter]) -> Models | None:
    """Models from run counts by language: interpolated Kneser-Ney with one discount a length, n1 / (n1 + 2 n2)."""
    languages = sorted(k for k, c in counts.items() if c)
    if not languages:
        return None
    per: list[dict[int, tuple]] = []
    for lang in languages:
        g = Grams(list(counts[lang]))
        number = np.repeat(np.array(list(counts[lang].values()), np.float64), g.lengths)
        grams = {n: g.grams(n) for n in range(1, ORDER + 1)}
        context = {n: g.contexts(n) for n in range(2, ORDER + 1)}
        levels, lower = {}, None
        # counts: of occurrences at the top, of distinct left neighbours below
        unique, first, inverse = np.unique(grams[ORDER], return_index=True, return_inverse=True)
        amount = np.bincount(inverse, number)
        for n in range(ORDER, 0, -1):
            levels[n] = (unique, amount, context[n][first] if n > 1 else None, grams[n - 1][first] if n > 1 else None)
            if n > 1:
                parents = grams[n - 1][first]
                unique, inverse = np.unique(parents, return_inverse=True)
                amount = np.bincount(inverse).astype(np.float64)
                _, first_all = np.unique(grams[n - 1], return_index=True)
                first = first_all  # the same n-grams: every (n-1)-gram ends a longer one
        out = {}
        for n in range(1, ORDER + 1):
            unique, amount, ctx, parent = levels[n]
            if n == 1:
                p = (1 - UNSEEN) * amount / amount.sum()
                out[1] = (unique, p, None, None)
                lower = (unique, p)
                continue
            n1, n2 = (amount == 1).sum(), (amount == 2).sum()
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
            c_unique, c_inverse = np.unique(ctx, return_inverse=True)
            total = np.bincount(c_inverse, amount)
            kinds = np.bincount(c_inverse, np.minimum(amount, d))
            weight = kinds / total
            p = np.maximum(amount - d, 0) / total[c_inverse] + weight[c_inverse] * lower[1][np.searchsorted(lower[0], parent)]
            out[n] = (unique, p, c_unique, weight)
            lower = (unique, p)
        per.append(out)
    hashes, logs, seen, contexts, weights = [], [], [], [np.zeros(1, np.uint64)], [np.zeros((1, len(languages)))]
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([o[n][0] for o in per]))
        log, have = np.zeros((len(every), len(languages)), np.float32), np.zeros((len(every), len(languages)), bool)
        for j, o in enumerate(per):
            at = np.searchsorted(every, o[n][0])
            log[at, j], have[at, j] = np.log2(o[n][1]), True
        hashes.append(every), logs.append(log), seen.append(have)
        if n > 1:
            every = np.unique(np.concatenate([o[n][2] for o in per]))
            w = np.zeros((len(every), len(languages)), np.float32)
            for j, o in enumerate(per):
                w[np.searchsorted(every, o[n][2]), j] = np.log2(o[n][3])
            contexts.append(every), weights.append(w)
    return Models(languages, hashes, logs, contexts, weights, seen, float(np.log2(UNSEEN / ALPHABET)))


class Reader:
    """Scores texts; remembers the bits of the runs it has seen, up to a fixed number of characters of them."""

    def __init__(self, models: Models, most_chars: int = 2_000_000):
        self.models, self.most_chars = models, most_chars
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.chars, self.lengths, self.table = 0, np.zeros(0, np.int64), np.zeros((0, len(self.models.languages)))

    def entropies(self, texts: list[list[str]]) -> list[tuple[np.ndarray, int]]:
        """Of each list of runs: bits a character in each language, and the number of characters."""
        if self.chars > self.most_chars:
            self._clear()
        if new := list({run for found in texts for run in found if run not in self.row}):
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            tables, at, size = [self.table], 0, 0
            lengths = [self.lengths]
            for i, run in enumerate(new):  # in parts of bounded size
                size += len(run) + ORDER + 1
                if size > 500_000 or i == len(new) - 1:
                    bits, chars = self.models.bits(new[at : i + 1])
                    tables.append(bits), lengths.append(chars)
                    at, size = i + 1, 0
            self.table, self.lengths = np.concatenate(tables), np.concatenate(lengths)
            self.chars = int(self.lengths.sum())
        out = []
        for found in texts:
            ids = np.fromiter(map(self.row.__getitem__, found), np.int64, len(found))
            chars = int(self.lengths[ids].sum())
            out.append((self.table[ids].sum(0) / max(1, chars), chars))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Languages and calibrated probabilities; und and 0 without letters."""
        found = [runs(t) for t in texts]
        out = []
        for bits, chars in self.entropies(found):
            best = int(bits.argmin())
            out.append((self.models.languages[best], self.trust(bits, chars, best)) if chars else ("und", 0.0))
        return out

    def trust(self, bits: np.ndarray, chars: int, best: int) -> float:
        z = self.models.curve @ evidence(bits, chars, best)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def evidence(bits: np.ndarray, chars: int, best: int) -> np.ndarray:
    """What trust depends on: a constant, the total margin in bits to the second, and the level of the winner."""
    rest = np.delete(bits, best)
    margin = (rest.min() - bits[best]) * chars if len(rest) else 50.0
    return np.array([1.0, np.log1p(max(0.0, margin)), bits[best] / 8])


def calibrate(models: Models, rows: list[tuple[str, str]]) -> None:
    """Fit the curve to texts that the models weren't trained on, whole and cut to a few words; ridge keeps it finite."""
    reader, xs, ys = Reader(models), [], []
    for lang, text in rows:
        found = runs(text)
        for bits, chars in reader.entropies([found, found[:3], found[:1], found[5:7]]):
            if chars:
                best = int(bits.argmin())
                xs.append(evidence(bits, chars, best)), ys.append(models.languages[best] == lang)
    models.curve = np.array([0.0, 1.0, 0.0])
    if not xs:
        return
    x, y, w = np.array(xs), np.array(ys, float), np.array([0.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (w - np.array([0.0, 1.0, 0.0]))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), g)
    models.curve = w


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = TRAINING_DOCS) -> Models | None:
    """Models from about ``most`` different texts of every language, picked by a hash of the text, and a fifth as many for calibration.

    A text counts once, however many rows have it. Run counts are made on the executors; the driver gets counts of distinct
    runs, and the texts for calibration, of these bounded samples: never more than 1.5 times as many as expected."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    mark = F.xxhash64(F.lit(3), "text")
    # a share for each language, a number a language; texts are filtered where they are read
    shares = {r["lang"]: min(1.0, 1.2 * most / max(1, r["texts"])) for r in rows.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("texts")).collect()}
    if not shares:
        return None
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    draw = F.pmod(mark, F.lit(1_000_000)) / 1_000_000
    # five in six of the picked documents make the models, the rest the calibration
    some = rows.withColumn("draw", draw).withColumn("share", share).filter("draw < share").dropDuplicates(["lang", "text"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    picked = written(some.withColumn("rank", rank).filter(F.col("rank") <= int(1.8 * most)).drop("rank"), "language-sample")
    small_batches(docs.sparkSession)

    def count(batches):
        tally: dict[str, Counter] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tally.setdefault(name, Counter()).update(runs(t))
        for name, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "run", "n"])

    for_models = picked.filter("1.2 * draw < share")
    counted = for_models.select("lang", "text").mapInArrow(count, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for name, run, n in counted.toArrow().to_pandas().itertuples(index=False):
        counts.setdefault(name, Counter())[run] = int(n)
    models = train(counts)
    if models is not None:
        held = picked.filter("1.2 * draw >= share").select("lang", "text").collect()
        calibrate(models, [(r["lang"], r["text"]) for r in held])
    dropped(picked)
    return models


def predict_language(docs: DataFrame, models: Models | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and rejected of every row. Null texts and texts without letters are ``und`` with score 0,
    as is every text without models. Texts are read whole, however long; of languages that tie, the first by name wins. Rows
    are independent: repeated rows get equal results, other columns don't matter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def read(batches):
        reader = Reader(shared.value) if shared.value is not None else None
        for b in batches:
            texts = b.column(1).to_pylist()
            out = reader.predict(texts) if reader else [("und", 0.0)] * len(texts)
            scores = [s for _, s in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array(scores, pa.float64()), pa.array([s < REJECT_BELOW for s in scores], pa.bool_())], names=["key", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(read, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; the models know only documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    models = learn(docs.filter(~held_out))
    return predict_language(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
