"""Katz back-off trigram scores (Katz, 1987).

Counts of n-grams get Good-Turing discounts up to LARGE occurrences; what a context saves is spread over the words that it
hasn't been followed by, in the proportions that the shorter context gives them, with weights that make every context's
probabilities sum to exactly 1: pairs of words back off to one, and one to the smoothed word distribution
(c + 1/2) / (N + (V + 1) / 2), in which all unknown words share one place.

The model is never in one piece. Texts are turned once into batches of word numbers. Batches ask the shards of the
word table for their distinct words' counts and ids, then the shards of the table of two words, then of that of three, for
their distinct n-grams and contexts; a batch's training n-grams and its questions are one message, so shards count and
answer in one go. The n-grams of a context that
holds over 1/HOT of all tokens are dealt out by n-gram, their sums go by way of a table of at most HOT rows. Each token is
then evaluated from the longest n-gram down: what has been seen, else the context's weight times the shorter one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.llm.common import bucketed, buckets_for, dropped, mix64, small_batches, trimmed, written

#: Tokens of a batch, about; a text is never cut.
BATCH = 600_000
#: N-grams seen more often aren't discounted.
LARGE = 5
HOT = 1000
#: Columns of a message, and of an answer.
MESSAGE = ("u", "v", "of", "runs", "words", "lower", "trained")
ANSWER = ("counts", "kinds", "low")
#: Id of what is before the start of a text; no word has it.
NOWHERE = (1 << 62) - 1
#: Stand-ins for the end of a text and for what is before its first word; no word is empty or a space.
END, START = b"", b" "


#: Made once a process; each holds tables that take longer to make than most messages to code.
_WRITE, _READ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """How many bytes the numbers need, then these compressed, first bytes of all numbers first: high bytes are mostly zero,
    and cost next to nothing together; those that are zero in all numbers are left out."""
    x = np.ascontiguousarray(x).ravel()
    whole = x.view(f"u{x.itemsize}")
    width = max(1, -(-int(whole.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + _WRITE.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T))


def _unpack(x: bytes, kind) -> np.ndarray:
    """``kind`` may be narrower or wider than what was packed, as long as it holds the numbers."""
    raw, width = np.frombuffer(_READ.decompress(memoryview(x)[1:]), np.uint8), x[0]
    out = np.zeros((len(raw) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view(kind).ravel()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z lower-cased, and how many each text has. ASCII white space alone parts words, as in ``bytes.split``."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    found, edges = words.flatten(), np.asarray(words.offsets)
    # space at the ends of a text makes empty words
    some = pc.greater(pc.binary_length(found), 0)
    upto = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    return found.filter(some), np.diff(upto[edges])


def batches_of(rows: DataFrame) -> DataFrame:
    """From key, held_out, text: batches with their distinct words' hashes and training counts, and their documents as word numbers."""

    def work(batches):
        part, number = TaskContext.get().partitionId(), 0
        kind = None

        def row():
            coded = pa.concat_arrays(words).dictionary_encode()
            lengths = np.concatenate(sizes) + 1
            # the end of a text is 0, what is before its first word 1
            tokens = np.zeros(lengths.sum(), np.int64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(lengths) - 1] = False
            tokens[inner] = np.asarray(coded.indices).astype(np.int64) + 2
            distinct = [END, START, *coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
            # frequent words get small numbers; the two stand-ins keep theirs
            often = np.bincount(tokens, minlength=len(hashes))
            by = np.concatenate([[0, 1], 2 + np.argsort(-often[2:], kind="stable")])
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            tokens, hashes = place[tokens], hashes[by]
            seen = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(tokens[seen], minlength=len(hashes)).astype(np.uint32)
            starts = int((~np.array(held, bool)).sum())
            counts[1] = starts  # as a context, what is before the first word occurs once a training text
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) | number], pa.int64()), pa.array([_pack(hashes)], pa.binary()), pa.array([_pack(counts)], pa.binary()), pa.array([_pack(tokens.astype(np.uint32))], pa.binary()),
                pa.array([_pack(lengths)], pa.binary()), pa.array([keys], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())),
            ], names=["batch", "words", "counts", "tokens", "lengths", "keys", "held_out"])

        words, sizes, keys, held, size = [], [], [], [], 0
        for b in batches:
            kind = b.column(0).type
            found, n = words_of(b.column(2))
            ends, first, k, h = np.cumsum(n + 1), 0, b.column(0).to_pylist(), b.column(1).to_pylist()
            while first < len(n):
                # the text that reaches BATCH tokens is the last one of a batch
                done = int(ends[first - 1]) if first else 0
                last = min(len(n), int(np.searchsorted(ends, done + BATCH - size)) + 1)
                words.append(found.slice(done - first, int(ends[last - 1]) - last - (done - first)))
                sizes.append(n[first:last]), keys.extend(k[first:last]), held.extend(h[first:last])
                size, first = size + int(ends[last - 1]) - done, last
                if size >= BATCH:
                    yield row()
                    number += 1
                    words, sizes, keys, held, size = [], [], [], [], 0
        if keys:
            yield row()
        words = found = b = None
        trimmed()

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"batch long, words binary, counts binary, tokens binary, lengths binary, keys array<{key}>, held_out array<boolean>")


def word_shards(made: DataFrame, shards: int) -> DataFrame:
    """Answers (batch, numbers, counts, ids) to the batches' words, and sums (n, v) of each shard."""

    def ask(batches):
        for b in batches:
            for batch, words, counts in zip(b["batch"].to_pylist(), b["words"].to_pylist(), b["counts"].to_pylist(), strict=True):
                h, c = _unpack(words, np.uint64), _unpack(counts, np.uint32)
                to = h % np.uint64(shards)
                by = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[by], np.arange(shards + 1))
                at = [by[ends[i] : ends[i + 1]] for i in range(shards)]
                used = [i for i in range(shards) if len(at[i])]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([batch] * len(used), pa.int64()), pa.array([_pack(h[at[i]]) for i in used], pa.binary()), pa.array([_pack(c[at[i]]) for i in used], pa.binary()), pa.array([_pack(np.diff(at[i], prepend=0)) for i in used], pa.binary())], names=["shard", "batch", "words", "counts", "numbers"])

    start = np.uint64(xxhash.xxh3_64_intdigest(START))

    def answer(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        words = [_unpack(x, np.uint64) for x in table["words"].to_pylist()]
        h, c = np.concatenate(words), np.concatenate([_unpack(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        unique, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, c, len(unique)).astype(np.int64)
        # small ids for frequent words
        rank = np.empty(len(unique), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(unique))
        ids, counts = rank[inverse] * shards + shard, total[inverse]
        edges = np.cumsum([0, *map(len, words)])
        counted = total * (unique != start)
        n = table.num_rows
        none = pa.nulls(n, pa.int64())
        parts = [(_pack(counts[s:e].astype(np.uint64)), _pack(ids[s:e].astype(np.uint64))) for s, e in zip(edges, edges[1:], strict=False)]
        numbers = pa.concat_arrays([table["numbers"].combine_chunks(), pa.nulls(1, pa.binary())])
        return pa.table([pa.concat_arrays([table["batch"].combine_chunks(), pa.nulls(1, pa.int64())]), numbers, pa.array([x for x, _ in parts] + [None], pa.binary()), pa.array([x for _, x in parts] + [None], pa.binary()), pa.concat_arrays([none, pa.array([int(counted.sum())])]), pa.concat_arrays([none, pa.array([int((counted > 0).sum())])])], names=["batch", "numbers", "counts", "ids", "n", "v"])

    asked = made.select("batch", "words", "counts").mapInArrow(ask, "shard int, batch long, words binary, counts binary, numbers binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch long, numbers binary, counts binary, ids binary, n long, v long")


def word_answers(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids of a batch's words."""
    answers = [(np.cumsum(_unpack(a["numbers"], np.int64)), a) for a in row["answers"]]
    size = sum(len(n) for n, _ in answers)
    counts, ids = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for n, a in answers:
        counts[n], ids[n] = _unpack(a["counts"], np.uint64), _unpack(a["ids"], np.uint64)
    return counts, ids


class Grams:
    """Distinct n-grams of a batch, by the ids of their contexts and words: ids (u, v) and count of each context, which of
    them an n-gram has, its word's id, the count of the n-gram without its first word, and its training count here."""

    def __init__(self, u, v, of, context, word, lower, trained):
        self.u, self.v, self.of, self.context, self.word, self.lower, self.trained = u, v, of, context, word, lower, trained

    def complete(self, limit: float) -> np.ndarray:
        """Contexts of which every occurrence is in this batch, so that nobody has to be asked; hot ones aside."""
        return (np.bincount(self.context, self.trained, len(self.of)) == self.of) & (self.of <= limit)

    def dealt(self, shards: int, limit: float) -> list[np.ndarray]:
        """Places of the n-grams for each shard, in order: by context, or by n-gram where the context is hot. A context
        that no training text has goes to none."""
        key = mix64(self.u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.v.astype(np.uint64))
        hot = self.of > limit
        to = np.where(hot[self.context], mix64(key[self.context] + self.word.astype(np.uint64)), key[self.context]) % np.uint64(shards)
        # narrow numbers are sorted in linear time
        by = np.argsort(to.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")
        ends = np.cumsum(np.bincount(to.astype(np.int64), minlength=shards))
        ends = np.concatenate([[0], ends])
        some = self.of[self.context] > 0
        by, ends = by[some[by]], np.concatenate([[0], np.cumsum(some[by])])[ends]
        return [by[ends[i] : ends[i + 1]] for i in range(shards)]


class Batch:
    """A batch's documents: word counts and ids, tokens, distinct pairs and what is known of them."""

    def __init__(self, row: dict):
        self.counts, self.ids = _unpack(row["counts"], np.int64), _unpack(row["ids"], np.int64)
        self.tokens, self.lengths = _unpack(row["tokens"], np.uint32).astype(np.int64), _unpack(row["lengths"], np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.held = np.array(row["held_out"], bool)
        self.seen = np.repeat(~self.held, self.lengths)
        self.size = len(self.ids)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.firsts] = 1
        self.order = np.argsort(self.ids)
        self.place = np.empty(self.size, np.int64)
        self.place[self.order] = np.arange(self.size)
        pairs, self.pair_of = np.unique(self.place[before] * self.size + self.place[self.tokens], return_inverse=True)
        self.context, self.word = self.order[pairs // self.size], self.order[pairs % self.size]

    def pairs(self) -> Grams:
        trained = np.bincount(self.pair_of[self.seen], minlength=len(self.word))
        return Grams(np.zeros(self.size, np.int64), self.ids, self.counts, self.context, self.ids[self.word], self.counts[self.word], trained)

    def triples(self, counts: np.ndarray) -> Grams:
        """From the counts of all pairs. What is before a first word is a pair of its own, in place of the last one."""
        before = np.empty_like(self.pair_of)
        before[1:] = self.pair_of[:-1]
        before[self.firsts] = len(self.word)
        triples, self.triple_of = np.unique(before * self.size + self.place[self.tokens], return_inverse=True)
        # any occurrence tells the pair that ends a triple
        pair = np.empty(len(triples), np.int64)
        pair[self.triple_of] = self.pair_of
        trained = np.bincount(self.triple_of[self.seen], minlength=len(triples))
        u, v, of = np.append(self.ids[self.context], NOWHERE), np.append(self.ids[self.word], self.ids[1]), np.append(counts, self.counts[1])
        return Grams(u, v, of, triples // self.size, self.ids[self.order[triples % self.size]], counts[pair], trained)


def lows(context: np.ndarray, lower: np.ndarray, contexts: int, weigh) -> np.ndarray:
    """A column a context: the numbers of its words whose shorter n-grams have counts of 1 to LARGE, and the sum of what
    ``weigh`` makes of larger counts, which is whole. These are small numbers, and pack well; their sum is a fraction.
    Where it makes whole numbers of all counts, there is their sum alone."""
    alone = 0 if (weigh(np.arange(1, LARGE + 1)) % 1 == 0).all() else LARGE
    out = np.empty((alone + 1, contexts), np.uint64)
    if alone:
        out[:alone] = kinds_of(context, lower, contexts)
    more = lower > alone
    out[alone] = np.bincount(context[more], weigh(lower[more]), contexts)
    return out


def kinds_of(context: np.ndarray, counts: np.ndarray, contexts: int) -> np.ndarray:
    """A column a context: the numbers of its n-grams whose counts are 1 to LARGE."""
    out = np.empty((LARGE, contexts), np.uint32)
    for r in range(1, LARGE + 1):
        out[r - 1] = np.bincount(context[counts == r], minlength=contexts)
    return out


def low_sums(low: np.ndarray, weigh) -> np.ndarray:
    """By context, the sum of what ``weigh`` makes of the counts of all shorter n-grams, added up in one order everywhere."""
    out = low[-1].astype(np.float64)
    for n, w in zip(low[:-1], weigh(np.arange(1, LARGE + 1)), strict=False):
        out += n * w
    return out


def told_lows(packed: bytes, contexts: int, weigh) -> np.ndarray:
    low = _unpack(packed, np.uint64)
    return low_sums(low.reshape(-1, contexts), weigh) if contexts else np.zeros(0)


def by_two(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Order by two whole numbers, of which NOWHERE is the largest: by one number where both fit into it, which is faster."""
    bits = []
    for x in (u, v):
        top = int(x.max(initial=0, where=x != NOWHERE)) + 1
        bits.append(top.bit_length())
    if sum(bits) > 63:
        return np.lexsort((v, u))
    both = np.minimum(u, (1 << bits[0]) - 1)
    both <<= bits[1]
    both |= np.minimum(v, (1 << bits[1]) - 1)
    return np.argsort(both)


def gram_shards(asked: DataFrame, shards: int, limit: float, name: str, grams, weigh) -> DataFrame:
    """Answers (batch, shard, counts of n-grams, kinds and low of contexts) to ``grams`` of every batch, and the same by hot
    context (u, v); context (-1, -1) has the numbers of n-grams seen 1, 2, ... LARGE + 1 times. A context's kinds are the
    numbers of words seen after it, by count up to LARGE; its low is what ``lows`` has of them."""
    fields = [f"n{r}" for r in range(1, LARGE + 1)]

    def ask(batches):
        trimmed()
        for b in batches:
            for row in b.to_pylist():
                x, rows = grams(row), []
                for i, at in enumerate(x.dealt(shards, limit)):
                    if len(at):
                        c = x.context[at]
                        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                        runs, c = np.diff(np.append(first, len(c))), c[first]
                        rows.append((i, *[_pack(col.astype(np.int64)) for col in (x.u[c], x.v[c], x.of[c], runs, x.word[at], x.lower[at], x.trained[at])]))
                for k in range(0, len(rows), 64):
                    to, *columns = zip(*rows[k : k + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([row["batch"]] * len(to), pa.int64()), *[pa.array(col, pa.binary()) for col in columns]], names=["shard", "batch", *MESSAGE])

    def answer(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        sent = {c: table[c].to_pylist() for c in MESSAGE}

        def read(c: str, kind=np.int64) -> list[np.ndarray]:
            return [_unpack(x, kind) for x in sent[c]]

        # contexts come as runs, so they are told apart before their n-grams are; a column is unpacked when it is needed
        runs = read("runs", np.int32)
        sizes = [int(x.sum()) for x in runs]
        u, v = np.concatenate(read("u")), np.concatenate(read("v"))
        order = by_two(u, v)
        new = np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])])
        of_run = np.empty(len(u), np.int64)
        of_run[order] = np.cumsum(new) - 1
        cu, cv, contexts = u[order][new], v[order][new], int(new.sum())
        del u, v, order, new
        of, w = np.repeat(of_run, np.concatenate(runs)), np.concatenate(read("words"))
        del of_run
        order = by_two(of, w)
        new = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (w[order][1:] != w[order][:-1])])
        gram = np.empty(len(w), np.int32)
        gram[order] = np.cumsum(new, dtype=np.int32) - 1
        order = order[new]
        del new, w
        trained = read("trained", np.uint32)
        counts = np.bincount(gram, np.concatenate(trained)).astype(np.int64)
        which, lowers = of[order], np.concatenate(read("lower"))[order]
        del order
        kinds = kinds_of(which, counts, contexts)
        low = lows(which, np.where(counts > 0, lowers, 0), contexts, weigh)
        edges, packed, hot = np.cumsum([0, *sizes]), [], []
        for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            first = s + np.cumsum(runs[i]) - runs[i]
            # a batch that has a whole context knows as much
            occurs = _unpack(sent["of"][i], np.int64)
            asks = (np.add.reduceat(trained[i], first - s, dtype=np.int64) != occurs) | (occurs > limit)
            known = of[first[asks]]
            packed.append((_pack(counts[gram[s:e][np.repeat(asks, runs[i])]].astype(np.uint32)), _pack(kinds[:, known]), _pack(low[:, known])))
            hot.append(of[first[occurs > limit]])
        # what the workers keep between stages adds up
        del runs, trained, sent, of, gram
        trimmed()
        hot = np.unique(np.concatenate(hot))
        n, m = table.num_rows, len(hot) + 1
        none = pa.nulls(n, pa.int64())
        times = [int((counts == r).sum()) for r in range(1, LARGE + 2)]
        told = np.concatenate([np.concatenate([np.stack([cu[hot], cv[hot]]), kinds[:, hot]]), np.array([-1, -1, *times[:LARGE]])[:, None]], axis=1)
        columns = [pa.concat_arrays([none, pa.array(x)]) for x in told] + [pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(np.append(low_sums(low[:, hot], weigh), float(times[LARGE])))])]
        return pa.table([pa.concat_arrays([table["batch"].combine_chunks(), pa.nulls(m, pa.int64())]), pa.array([shard] * (n + m), pa.int32()), *[pa.array([x[i] for x in packed] + [None] * m, pa.binary()) for i in range(3)], *columns], names=["batch", "shard", *ANSWER, "u", "v", *fields, "sum"])

    sent = asked.mapInArrow(ask, "shard int, batch long, " + ", ".join(f"{c} binary" for c in MESSAGE))
    return written(sent.groupBy("shard").applyInArrow(answer, "batch long, shard int, counts binary, kinds binary, low binary, u long, v long, " + ", ".join(f"{f} long" for f in fields) + ", sum double"), name)


def of_batches(answers: DataFrame, name: str, buckets: int) -> DataFrame:
    return answers.filter("batch is not null").repartition(buckets, "batch").groupBy("batch").agg(F.collect_list(F.struct("shard", *ANSWER)).alias(name))


def hot_sums(answers: DataFrame) -> tuple[dict[tuple[int, int], tuple[list[int], float]], np.ndarray]:
    """Kinds and low by hot context, and discounts. At most HOT rows, and one."""
    fields = [f"n{r}" for r in range(1, LARGE + 1)]
    rows = answers.filter("u is not null").groupBy("u", "v").agg(*[F.sum(f).alias(f) for f in fields], F.sum("sum").alias("sum")).collect()
    found = {(r["u"], r["v"]): ([int(r[f]) for f in fields], r["sum"]) for r in rows}
    kinds, rest = found.pop((-1, -1), ([0] * LARGE, 0))
    return found, discounts([*kinds, rest])


def gram_answers(x: Grams, answers: list[dict] | None, shards: int, limit: float, hot: dict, weigh) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the n-grams, and kinds (a column a context) and low of the contexts of a batch: its own where it has a
    context's every occurrence, else those that it has been told."""
    whole, at = x.complete(limit), x.dealt(shards, limit)
    counts = np.where(whole[x.context], x.trained, 0).astype(np.uint32)
    kinds = kinds_of(x.context, x.trained, len(x.u))
    low = low_sums(lows(x.context, np.where(x.trained > 0, x.lower, 0), len(x.u), weigh), weigh)
    kinds[:, ~whole], low[~whole] = 0, 0
    for a in answers or ():  # none where no context is in a training text
        p = at[a["shard"]]
        p = p[~whole[x.context[p]]]
        counts[p] = _unpack(a["counts"], np.uint32)
        own = x.context[p]
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        kinds[:, own], low[own] = _unpack(a["kinds"], np.uint32).reshape(LARGE, -1), told_lows(a["low"], len(own), weigh)
    for i in np.flatnonzero(x.of > limit):
        if (told := hot.get((int(x.u[i]), int(x.v[i])))) is not None:
            kinds[:, i], low[i] = told
    return counts, kinds, low


def discounts(times: list[float]) -> np.ndarray:
    """Good-Turing discounts of counts 1 to LARGE, from the numbers of n-grams seen 1 to LARGE + 1 times.

    Groups of copies make bumps in these numbers. From the first count on whose discount, or whose place after the counts
    below it, a bump spoils, the numbers are taken from their log-linear fit (Gale and Sampson, 1995), which always gives
    rising counts and discounts between 0 and 1 if it falls fast enough; else absolute discounting takes the place of all."""
    n = np.array(times, float)
    r = np.arange(1, LARGE + 1)

    def turing(n: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (LARGE + 1) * n[LARGE] / n[0]
            return ((r + 1) * n[1:] / (n[:-1] * r) - cut) / (1 - cut) if cut < 1 else np.full(LARGE, np.nan)

    some = np.flatnonzero(n) + 1
    if len(some) > 1:
        # a number next to zeros stands for them too
        low, high = np.concatenate([[0], some[:-1]]), np.concatenate([some[1:], [2 * some[-1] - some[-2]]])
        slope, at_one = np.polyfit(np.log(some), np.log(2 * n[some - 1] / (high - low)), 1)
        if slope < -1:
            own, fit = turing(n), turing(np.exp(at_one) * np.arange(1, LARGE + 2) ** slope)
            for kept in range(LARGE, -1, -1):
                d = np.concatenate([own[:kept], fit[kept:]])
                if ((d > 0) & (d < 1)).all() and (np.diff(r * d) > 0).all():
                    return d
    less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - min(0.9, max(0.1, less))) / r


def twice(c: np.ndarray) -> np.ndarray:
    """Twice (c + 1/2), as a whole number."""
    return 2.0 * c + 1


def context_weights(of: np.ndarray, kinds: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts are divided by after each context, and what the context saves. One without discounted words gives half a count away."""
    saved = (1 - d) * np.arange(1, LARGE + 1) @ kinds
    extra = np.where(saved > 0, 0.0, 0.5)
    return np.maximum(of + extra, 1e-300), saved + extra


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], d, [1.0]])[np.minimum(c, LARGE + 1)] * c


def back_off(x: Grams, c: np.ndarray, whole: np.ndarray, saved: np.ndarray, share: np.ndarray, shorter: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(word | context) of n-grams from their counts; ``share``: of the words seen after a context, the sum of their
    probabilities after the shorter context; ``shorter``: that of the n-gram's own word."""
    kept = discounted(c, d)
    weight = saved / whole / np.maximum(1 - share, 1e-15)
    return np.where(x.of[x.context] == 0, shorter, np.where(c > 0, kept / whole[x.context], weight[x.context] * shorter))


def katz_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row; rows where ``held_out`` isn't true train.

    Null and empty texts are the end token alone; a text is never cut, however long. Without training rows all words are
    unknown. Equal rows get equal scores, and count as often as they come; an empty table gives an empty one; other columns don't matter."""
    small_batches(docs.sparkSession)
    shards = buckets_for(docs, mb=4)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    made = written(batches_of(rows), "lm-batches")
    words = written(word_shards(made, shards), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    told = words.filter("batch is not null").groupBy("batch").agg(F.collect_list(F.struct("numbers", "counts", "ids")).alias("answers"))
    # contexts that occur more often are hot
    limit = total / HOT
    kind = rows.schema["key"].dataType.simpleString()
    plain = f"batch long, tokens binary, lengths binary, keys array<{kind}>, held_out array<boolean>, counts binary, ids binary"

    def with_words(batches):
        for b in batches:
            for i, row in enumerate(b.select(["answers"]).to_pylist()):
                packed = [pa.array([_pack(x)], pa.binary()) for x in word_answers(row)]
                yield pa.RecordBatch.from_arrays([*[b[c].slice(i, 1) for c in ("batch", "tokens", "lengths", "keys", "held_out")], *packed], names=["batch", "tokens", "lengths", "keys", "held_out", "counts", "ids"])

    known = bucketed(made.drop("counts", "words").join(told, "batch").mapInArrow(with_words, plain), "lm-tokens", "batch", shards)
    dropped(made, words)
    two = gram_shards(known.drop("keys"), shards, limit, "lm-pairs", lambda row: Batch(row).pairs(), twice)
    hot2, d2 = hot_sums(two)

    def with_pairs(batches):
        trimmed()
        for b in batches:
            for i, row in enumerate(b.drop_columns(["keys"]).to_pylist()):
                packed = [pa.array([_pack(x)], pa.binary()) for x in gram_answers(Batch(row).pairs(), row["two"], shards, limit, hot2, twice)]
                yield pa.RecordBatch.from_arrays([*[b[c].slice(i, 1) for c in names], *packed], names=[*names, "pairs", "kinds", "low"])

    names = known.columns
    paired = bucketed(known.join(of_batches(two, "two", shards), "batch", "left").select(*names, "two").mapInArrow(with_pairs, f"{plain}, pairs binary, kinds binary, low binary"), "lm-paired", "batch", shards)
    dropped(known, two)
    three = gram_shards(paired.drop("keys", "kinds", "low"), shards, limit, "lm-triples", lambda row: Batch(row).triples(_unpack(row["pairs"], np.uint32).astype(np.int64)), lambda c: discounted(c, d2))
    hot3, d3 = hot_sums(three)

    def evaluate(batches):
        trimmed()
        for b in batches:
            for i, row in enumerate(b.drop_columns(["keys"]).to_pylist()):
                x = Batch(row)
                base = (x.counts + 0.5) / (total + 0.5 * (distinct + 1))
                pairs, c2, kinds2 = x.pairs(), _unpack(row["pairs"], np.uint32).astype(np.int64), _unpack(row["kinds"], np.uint32).reshape(LARGE, -1)
                # low: of the words seen after a context, twice all counts, and one for each
                share = _unpack(row["low"], np.float64) / 2 / (total + 0.5 * (distinct + 1))
                whole2, saved2 = context_weights(x.counts, kinds2, d2)
                p2 = back_off(pairs, c2, whole2, saved2, share, base[x.word], d2)
                triples = x.triples(c2)
                c3, kinds3, low3 = gram_answers(triples, row["three"], shards, limit, hot3, lambda c: discounted(c, d2))
                # every word seen after two has been seen after one, so its probability there is a discounted count
                last = np.append(x.word, 1)
                share = low3 / whole2[last]
                whole3, saved3 = context_weights(triples.of, kinds3, d3)
                shorter = np.zeros(len(triples.word))
                shorter[x.triple_of] = p2[x.pair_of]
                p3 = back_off(triples, c3, whole3, saved3, share, shorter, d3)
                scores = np.add.reduceat(np.log10(p3)[x.triple_of], x.firsts)
                bases = np.add.reduceat(np.log10(base)[x.tokens], x.firsts)
                seen = np.add.reduceat((x.counts[x.tokens] > 0).astype(np.int64), x.firsts)
                yield pa.RecordBatch.from_arrays([b["keys"].slice(i, 1).flatten(), pa.array(x.held), pa.array(x.lengths), pa.array(seen), pa.array(np.full(len(seen), total)), pa.array(bases), pa.array(scores)], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return paired.join(of_batches(three, "three", shards), "batch", "left").mapInArrow(evaluate, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those that aren't held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
