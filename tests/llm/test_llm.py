"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mentionloom.llm import embeddings, langid, lm, mixing, packing, pii, quality, sharding, shingles, tokenfiles
from mentionloom.llm.components import components
from mentionloom.llm.queries import queries
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a text of 120,000 words."""
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "One two three.", None, "b", 14), (4, "One two three.", None, "b", 14), (5, "ONE TWO THREE.", "en", "b", 14), (None, "no id here", "en", None, 10), (6, "long word " * 60_000, "en", "a", 600_000)]
    # columns that clash with those that operators make
    names = "shard int, slot long, key string, kept boolean, component int, size int, found int, fp long, place long"
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows], f"{SCHEMA}, {names}")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def words_of(text):
    return (text or "").encode().lower().split()


# ---- sharding


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    before = sharding.jump_hash(keys, 8)
    after = sharding.jump_hash(keys, 9)
    assert set(before) == set(range(8))
    assert (after[after != before] == 8).all()
    assert abs((after != before).mean() - 1 / 9) < 0.01
    assert np.bincount(before).std() < 0.1 * len(keys) / 8
    assert (sharding.jump_hash(keys, 1) == 0).all()


def test_jump_hash_is_the_published_loop():
    def jump(key, shards):
        at, to = -1, 0
        while to < shards:
            at = to
            key = (key * 2862933555777941757 + 1) % 2**64
            to = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
        return at

    keys = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [jump(int(k), shards) for k in keys]


def test_op1(spark, docs, texts):
    rows = queries()["op1_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_edges(spark, odd, empty, tmp_path):
    rows = sharding.assign_shards(odd.select("doc_id", "text", "shard", "slot"), shards=3).collect()
    assert len(rows) == 8
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert sharding.assign_shards(empty, shards=3).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(odd, str(tmp_path / "x"))
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 8


# ---- quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_op2(spark, texts):
    rows = queries()["op2_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(quality.labelled_rows(docs, labels.filter("doc_id % 3 != 0")))
    got = quality.score_quality(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1 and not r.base_failed], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_few_labels_calibrate_together(monkeypatch):
    """All rows where a fifth has only a handful of a class, each by a model that hasn't seen it; else a fifth."""
    random.seed(31)
    rows = [(" ".join(random.choices(("good fine word text" if i % 6 else "bad junk $$$ %%% word").split(), k=30)), int(i % 6 > 0), 1.0) for i in range(90)]
    asked = []
    platt = quality._platt
    monkeypatch.setattr(quality, "_platt", lambda z, y, weight: asked.append((len(z), int(sum(y)))) or platt(z, y, weight))
    assert quality.train(rows) is not None
    monkeypatch.setattr(quality, "FEWEST", 2)
    assert quality.train(rows) is not None
    assert asked == [(90, 75), (18, 15)]
    assert quality.train([r for r in rows if r[1]]) is None


def test_calibration_keeps_the_shares_of_the_classes(spark):
    """Texts that tell nothing, five of six good: the probability is near that share, however many rows a class may have."""
    random.seed(12)
    rows = [(i, " ".join(random.choice(["red", "blue", "green", "grey"]) for _ in range(60)), int(i % 6 > 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for most in (1000, 100):
        model = quality.train(quality.labelled_rows(df, df.drop("text"), most=most))
        told = [r.probability for r in quality.score_quality(df, model).collect()]
        assert 0.75 < np.mean(told) < 0.9


def test_training_leaves_no_memory_behind():
    """What training holds stays with the driver for all stages that follow, unless it goes back to the system."""

    def held():
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))

    random.seed(3)
    words = [f"w{random.getrandbits(40):x}" for _ in range(20_000)]
    rows = [(" ".join(random.choices(words, k=400)), i % 2, 1.0) for i in range(1500)]
    quality.train(rows[:50])
    before, tokens = held(), [len(quality.features(t.encode(), np.zeros(400, np.uint64))[0]) for t, _, _ in rows[:20]]
    features = sum(tokens) / 20 * 8 * len(rows) / 1024
    keep = quality.train(rows, epochs=1)
    assert held() - before < 0.5 * features
    assert keep is not None


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(quality.labelled_rows(odd, labels))
    assert model is None
    rows = quality.score_quality(odd, model).collect()
    assert [r.kept for r in rows] == [False] * 8
    assert rows[7].n_repeat_words == 120_000
    assert quality.score_quality(empty, model).count() == 0
    kept = quality.keep_good(odd.unionByName(odd.limit(1).selectExpr("7L doc_id", "array_join(transform(sequence(1, 60), x -> concat('w', x)), ' ') text", *odd.columns[2:])), labels)
    assert kept.columns == odd.columns
    assert [r.doc_id for r in kept.collect()] == [7]
    assert quality.repeated_words(np.array([1, 2, 3, 9, 1, 2, 3])) == 6


def test_repeated_words_of_many_distinct_words():
    # packed into 21 bits each, (0, 2^21, 5) and (1, 0, 5) are one key
    few = np.array([0, 1 << 21, 5, 9, 1, 0, 5])
    assert quality.repeated_words(few) == 0
    assert quality.repeated_words(np.concatenate([few, few[:3]])) == 6
    many = np.arange((1 << 21) + 8)
    assert quality.repeated_words(np.concatenate([many, few])) == 0
    assert quality.repeated_words(np.concatenate([many, few, few[:3]])) == 6


# ---- personal data


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_anchors_find_what_the_patterns_find():
    random.seed(3)
    anchors = pii.automaton()
    parts = ["a", "@", ".", "1", "2", "25", "0", ".", "-", " ", "+", "(", "é", "4539578763621486", "b.c", "%", "://"]
    for _ in range(20_000):
        t = "".join(random.choice(parts) for _ in range(random.randint(1, 22)))
        assert [s for s in pii.spans(t, anchors) if s[2] in pii.BASE] == brute_spans(t), t


def test_pii_added_spans_and_masks():
    anchors = pii.automaton()
    t = "go to ftp://bob:pw1@host/x, IBAN DE89370400440532013000, é a@b.co 1.2.3.4 +1 (259) 555-5738"
    found = pii.spans(t, anchors)
    assert [(t[s:e], k) for s, e, k in found] == [("bob:pw1", "login"), ("DE89370400440532013000", "account"), ("a@b.co", "email"), ("1.2.3.4", "ip"), ("+1 (259) 555-5738", "phone")]
    assert pii.redact(t, found) == "go to ftp://[LOGIN]@host/x, IBAN [ACCOUNT], é [EMAIL] [IP] [PHONE]"
    assert pii.spans("An account of events, ssn unknown, passport to 3 lands", anchors) == []


def test_accounts_in_groups_and_long_ones():
    anchors = pii.automaton()
    told = lambda t: [(t[s:e], k) for s, e, k in pii.spans(t, anchors)]
    for iban in ("DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "MT84MALT011000012345MTLCAST001S", "de89 3704 0044 0532 0130 00"):
        for before, behind in (("IBAN: ", " or pay 20 in cash"), ("iban ", ""), ("Account no. ", ". Then"), ("IBAN ", "\n1234 5678")):
            assert [x for x in told(before + iban + behind) if x[1] == "account"] == [(iban, "account")]
            assert pii.redact(before + iban + behind, pii.spans(before + iban + behind, anchors)) == f"{before}[ACCOUNT]{behind}"
    # a wrong check sum makes no IBAN
    assert told("IBAN: DE88 3704 0044 0532 0130 00") == []
    # the card that is a part of an IBAN doesn't uncover the rest
    for check in range(97):
        t = f"IBAN BE{check:02} 5390 0754 70"
        for tail in range(100):
            code = f"{t}{tail:02}"[5:].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                assert pii.redact(f"{t}{tail:02}!", pii.spans(f"{t}{tail:02}!", anchors)) == "IBAN [ACCOUNT]!"
    long = "AB12" + "3456-7890" * 8
    assert told(f"account {long}, and") == [(long, "account")]
    assert pii.spans("acct1" * 40_000 + "1", anchors)[-1][1] == 200_001


def test_op3(spark, texts):
    rows = queries()["op3_pii"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute_spans(texts[r.doc_id] or "")
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in want) for x in pii.BASE]


def test_pii_edges(odd, empty):
    out = pii.redacted(odd)
    assert out.columns == odd.columns
    assert out.count() == 8
    assert pii.redacted(empty).count() == 0


# ---- language


def after_(m, before, c):
    """Bits of a run without its step after ``before``."""
    g = langid.Grams([before + (c or "")])
    steps = [step_bits(m, before + (c or ""), i) for i in range(int(g.lengths[0]))]
    return sum(b for i, b in enumerate(steps) if i != len(before))


def step_bits(m, run, at):
    """-log2 probability of one step of a run, by the definition."""
    g, total, done = langid.Grams([run]), np.zeros(len(m.languages)), np.zeros(len(m.languages), bool)
    for n in range(langid.ORDER, 0, -1):
        row = np.flatnonzero(m.hashes[n - 1] == g.grams(n)[at])
        if len(row):
            hit = m.seen[n - 1][row[0]] & ~done
            total[hit] += m.logs[n - 1][row[0]][hit]
            done |= hit
        if n > 1:
            row = np.flatnonzero(m.contexts[n - 1] == g.contexts(n)[at])
            if len(row):
                total[~done] += m.weights[n - 1][row[0]][~done]
    return -(total + np.where(done, 0, m.unseen))


def test_language_models_are_normalised():
    counts = {"xx": Counter({"abab": 3, "ba": 2, "b": 1, "aab": 2}), "yy": Counter({"cc": 5, "abc": 1})}
    m = langid.train(counts)
    # every model's probabilities of what may follow a context sum to one, the unseen share included
    for before in ("", "a", "ab", "b", "zz"):
        p = np.zeros(2)
        for c in ("a", "b", "c", None):
            with_ = m.bits([before + c])[0][0] if c else m.bits([before])[0][0]
            p += 2.0 ** -(with_ - after_(m, before, c))
        assert (p < 1 + 1e-6).all() and (p > 0.9).all()
    g = langid.Grams(["ab"])
    assert g.lengths.tolist() == [3]
    for row in range(2):
        uni = 2.0 ** m.logs[0][m.seen[0][:, row], row].astype(float)
        assert uni.sum() == pytest.approx(1 - langid.UNSEEN, rel=1e-5)


def test_op4(spark, docs):
    rows = {r.doc_id: r for r in queries()["op4_language_id"](spark, f"{DATA}/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    assert rows.keys() == truth.keys()
    held = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.values())
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edges(odd, empty):
    models = langid.learn(odd)
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(odd, models).collect()}
    assert (got[1], got[2], got[3], got[6]) == ("und", "und", "und", "en")
    assert langid.learn(empty) is None
    assert [r.lang_pred for r in langid.predict_language(odd, None).collect()] == ["und"] * 8
    assert langid.predict_language(empty, models).count() == 0


# ---- packing


def check_packing(rows, sizes, capacity, places):
    bins = defaultdict(list)
    for r in rows:
        if r.bin >= 0:
            bins[r.bin].append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) == b[0].used <= capacity
        assert sorted(r.position for r in b) == list(range(len(b)))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.first_word, r.n_words))
    for key, n in sizes.items():
        at = 0
        for first, words in sorted(pieces[key]):
            assert first == at
            at += words
        assert at == n
    return bins


def test_op5(spark, docs, texts):
    rows = queries()["op5_best_fit_packing"](spark, SF).collect()
    bins = check_packing(rows, {k: len((t or "").encode().split()) for k, t in texts.items()}, packing.CAPACITY, packing.SOURCE_PLACES)
    source = {r.doc_id: r.source for r in docs.collect()}
    for b in bins.values():
        assert max(Counter(source[r.doc_id] for r in b).values()) <= packing.SOURCE_PLACES
        assert max(Counter(texts[r.doc_id] for r in b).values()) == 1


def brute_pack(sizes, sources, clusters, capacity, places):
    bins = []
    out = [-1] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i]:
            fits = [(left, b) for b, (left, s, c) in enumerate(bins) if left >= sizes[i] and left > 0 and s[sources[i]] < places and (clusters[i] < 0 or clusters[i] not in c)]
            if not fits:
                bins.append([capacity, Counter(), set()])
            b = min(fits)[1] if fits else len(bins) - 1
            bins[b][0] -= sizes[i]
            bins[b][1][sources[i]] += 1
            bins[b][2].add(clusters[i])
            out[i] = b
    return out


def test_pack_takes_the_tightest_compatible_bin():
    random.seed(4)
    for _ in range(60):
        n = random.randint(0, 60)
        sizes = np.array([random.randint(0, 50) for _ in range(n)], np.int64)
        sources, clusters = np.array([random.choice([0, 0, 1, 2]) for _ in range(n)], np.int64), np.array([random.choice([-1, -1, 0, 1]) for _ in range(n)], np.int64)
        assert packing.pack(sizes, sources, clusters, 50, 2).tolist() == brute_pack(sizes.tolist(), sources.tolist(), clusters.tolist(), 50, 2)


def test_small_pieces_of_a_hot_source_share_bins_with_others():
    """A source with a third of all pieces: its small pieces must not be left over, four to a bin of their own."""
    random = np.random.default_rng(6)
    sizes = np.minimum(random.lognormal(5, 1, 1200), packing.CAPACITY).astype(np.int64)
    sources, clusters = np.maximum(0, random.integers(-10, 21, 1200)), np.full(1200, -1, np.int64)
    order = packing.pressed_first(sizes, sources, clusters)
    assert sorted(order) == list(range(1200))
    bins = packing.pack(sizes, sources, clusters, order_in=order)
    assert np.bincount(bins[sizes > 0], sizes[sizes > 0]).max() <= packing.CAPACITY
    assert max(Counter(zip(bins.tolist(), sources.tolist(), strict=True)).values()) <= packing.SOURCE_PLACES
    assert sizes.sum() >= 0.9 * packing.CAPACITY * (bins.max() + 1)
    assert sizes.sum() < 0.9 * packing.CAPACITY * (packing.pack(sizes, sources, clusters).max() + 1)


def test_bins_are_full(spark):
    """Sizes as of prose, one source with a third of all rows, copies in clusters: nine tenths of all places are taken."""
    random.seed(21)
    texts = [" ".join(["w"] * int(random.lognormvariate(5, 1))) for _ in range(2500)]
    rows = [(i, x, f"s{max(0, random.randint(-10, 20))}") for i, x in enumerate(texts)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("bin >= 0").select("bin", "used").distinct().collect()
    assert all(r.used <= packing.CAPACITY for r in out)
    assert sum(r.used for r in out) >= 0.9 * packing.CAPACITY * len(out)
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([(1, "a", "b")], "bin long, text string, source string"), key="bin")


def test_packing_edges(odd, empty):
    rows = packing.pack_documents(odd, capacity=50).collect()
    assert sum(r.n_words for r in rows) == 3 * 3 + 3 + 120_000
    assert packing.pack_documents(empty).count() == 0


# ---- more of personal data and languages


@pytest.mark.parametrize(("text", "want"), [
    ("ftp://" + "u" * 300 + ":" + "p" * 300 + "@host/x", [(6, 607, "login")]),
    ("Account " + "12345" * 12 + " was", [(8, 68, "account")]),
    ("account 1234 5678 9012 34, and", [(8, 25, "account")]),
    ("IBAN DE89 3704 0044 0532 0130 00.", [(5, 32, "account")]),
    ("iban DE88370400440532013000", []),
    ("unaccountable1234567 accountable7654321", []),
    ("aCCt#: 7654321", [(7, 14, "account")]),
    ("ssn 666-12-1234, SSN: 123-45-6789, ssn 123-00-6789", [(22, 33, "account")]),
    ("passport no. X1234567 or passport 12", [(13, 21, "account")]),
])
def test_accounts_are_read_to_their_borders(text, want):
    found = pii.spans(text, pii.automaton())
    assert [x for x in found if x[2] not in pii.BASE] == want
    left = pii.redact(text, found)
    assert all(text[s:e] not in left for s, e, _ in want)


def test_models_are_kneser_ney():
    """Bits of runs against the formula over dictionaries: distinct left neighbours below the top, one discount a length."""
    random.seed(15)
    runs_ = Counter("".join(random.choice("abcd") for _ in range(random.randint(1, 7))) for _ in range(60))
    other = Counter({"dddd": 3, "abba": 1})
    models = langid.train({"x": runs_, "y": other})
    order, marks = langid.ORDER, lambda run: [*langid.PAD, *run, chr(langid.END)]

    def grams(run, n):
        s = marks(run)
        return [tuple(s[i - n + 1 : i + 1]) for i in range(order, len(s))]

    def probability(counts):
        level = {order: Counter()}
        for run, c in counts.items():
            for g in grams(run, order):
                level[order][g] += c
        for n in range(order - 1, 0, -1):
            level[n] = Counter(g[1:] for g in level[n + 1])

        def p(g):
            n = len(g)
            if n == 1:
                return (1 - langid.UNSEEN) * level[1][g] / sum(level[1].values()) if g in level[1] else langid.UNSEEN / langid.ALPHABET
            after = {k: c for k, c in level[n].items() if k[:-1] == g[:-1]}
            if not after:
                return p(g[1:])
            times = Counter(level[n].values())
            d = min(0.95, max(0.1, times[1] / (times[1] + 2 * times[2]))) if times[1] else 0.1
            total = sum(after.values())
            return max(level[n][g] - d, 0) / total + sum(min(c, d) for c in after.values()) / total * p(g[1:])

        return p

    some = [*list(runs_)[:10], "abcdabcd", "e", "zabz"]
    bits, lengths = models.bits(some)
    assert lengths.tolist() == [len(x) + 1 for x in some]
    for j, counts in enumerate((runs_, other)):
        p = probability(counts)
        want = [-sum(math.log2(p(g)) for g in grams(run, order)) for run in some]
        assert bits[:, j].tolist() == pytest.approx(want, rel=1e-5)


def test_a_repeated_row_is_one_text(spark):
    rows = [("en", "the same old text again and again")] * 3000 + [("en", f"text number {i} of many words") for i in range(300)] + [("de", f"ein anderer satz {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    once = df.distinct()
    a, b = (langid.learn(x, most=100) for x in (df, once))
    assert a.languages == b.languages == ["de", "en"]
    assert all((x == y).all() for x, y in zip(a.hashes + a.logs, b.hashes + b.logs, strict=True))


# ---- embeddings


def brute_links(rows, least):
    ids, n = [r[0] for r in rows], len(rows)
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].append(j)
                    links[j].append(i)
    low = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        low[i] = min(ids[y] for y in seen)
    return {ids[i]: (len(links[i]), low[i]) for i in range(n)}


def test_near_duplicate_vectors(spark):
    random = np.random.default_rng(5)
    rows, number = [], 100
    for _ in range(25):
        center = random.standard_normal(32)
        for k in range(random.integers(1, 6)):
            number -= 1
            rows.append((number, (center + 0.1 * k * random.standard_normal(32) / 2).astype(np.float32).tolist(), int(random.integers(0, 2))))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 32, 0), (205, [float("nan")] + [1.0] * 31, 0), (206, [], 0), (207, [None] + [1.0] * 31, 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [3e38] * 32, 1), (211, [1.0] * 32, 1)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, filter int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_links(rows, 0.98)
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_that_repeat_or_are_null(spark, kind):
    """Two vectors with one id, each with one near copy, stay two groups; null ids take part, but are no smallest id."""
    random = np.random.default_rng(3)
    near = lambda x: (x + 0.01 * random.standard_normal(16)).tolist()
    a, b, c, d = (random.standard_normal(16) for _ in range(4))
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (4, near(c)), (None, d), (None, near(d)), (5, near(a))]
    rows = [(i if i is None or kind == "long" else f"id{i}", list(map(float, v)), 0) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    x = (lambda i: i) if kind == "long" else (lambda i: f"id{i}")
    want = [(x(1), 2, x(1), True), (x(1), 1, x(1), True), (x(2), 2, x(1), False), (x(3), 1, x(1), False), (None, 1, x(4), False), (x(4), 1, x(4), True), (None, 1, None, True), (None, 1, None, True), (x(5), 2, x(1), False)]
    assert got == sorted(want, key=str)


def test_large_cluster_in_parts(spark, monkeypatch):
    """A cluster that fills its filters, compared part by part, and the filters that many vectors ask for."""
    random = np.random.default_rng(7)
    centre = random.standard_normal(24)
    side = random.standard_normal((700, 24))
    cluster = centre + side / np.linalg.norm(side, axis=1, keepdims=True) * np.linalg.norm(centre) * random.uniform(0.05, 0.3, (700, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([cluster, random.standard_normal((300, 24))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    want = brute_links(rows, 0.98)
    assert sum(n for n, _ in want.values()) > 20_000
    monkeypatch.setattr(embeddings, "PART", 50)
    monkeypatch.setattr(embeddings, "TILE", 32)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, words=160).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(n <= want[k][0] for k, (n, _) in got.items())
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)
    assert embeddings.words_for(2000) == embeddings.WORDS
    assert 2048 * embeddings.words_for(10**9) ** 2 >= 10**9 * embeddings.FILTERS_EACH


def test_op6(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries()["op6_embedding_near_dedup"](spark, SF).collect()}
    want = brute_links(rows, 0.98)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_list_decoding_visits_what_a_scan_finds():
    code = embeddings.ProductCode(24, words=16, blocks=3, each=20)
    unit = embeddings.normalised(np.random.default_rng(1).standard_normal((50, 24)))
    for p in code.products(unit):
        every = p[0][:, None, None] + p[1][None, :, None] + p[2][None, None, :]
        assert code.decode(p).tolist() == np.flatnonzero(every.ravel() >= code.alpha).tolist()


def test_near_copies_where_filters_are_few(spark):
    """Groups of near copies around directions that exceed no filter's threshold."""
    random = np.random.default_rng(11)
    code = embeddings.ProductCode(64)
    unit = embeddings.normalised(random.standard_normal((4000, 64)))
    lone = [u for u, p in zip(unit, code.products(unit), strict=True) if not len(code.decode(p))][:12]
    assert len(lone) == 12
    rows = []
    for center in lone:
        for _ in range(4):
            side = random.standard_normal(64)
            rows.append((len(rows), (center + 0.12 * side / np.linalg.norm(side)).astype(np.float32).tolist(), 0))
    want = brute_links(rows, 0.98)
    assert sum(n for n, _ in want.values()) > 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == want


def test_nearest_filters_are_those_of_a_scan():
    code = embeddings.ProductCode(24, words=16, blocks=3, each=20)
    unit = embeddings.normalised(np.random.default_rng(2).standard_normal((50, 24)))
    for p in code.products(unit):
        every = (p[0][:, None, None] + p[1][None, :, None] + p[2][None, None, :]).ravel()
        assert code.nearest(p, 32).tolist() == sorted(np.argsort(-every)[:32].tolist())
        assert set(code.decode(p)) <= set(code.filters(p)) and len(code.filters(p)) >= 32


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("mentionloom.llm.components.FEW", few)
    random.seed(6)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 540)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# ---- mixing


def test_op7(spark, docs, texts):
    rows = queries()["op7_source_mixing"](spark, SF).collect()
    again = queries()["op7_source_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in texts.items()}
    total = defaultdict(int)
    for k, n in size.items():
        total[source[k]] += n
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:  # excess is shared again until nothing is above its cap
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        new = {s for s in free if target[s] > 2 * total[s]}
        if not new:
            break
        full |= new
    target |= {s: 2.0 * total[s] for s in full}
    taken = defaultdict(int)
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 200)


def test_schedule_is_balanced_at_every_prefix(docs):
    sizes, schedule = mixing.mix(docs)
    slots = schedule.orderBy("slot").collect()
    share = {r.place: r.n / len(slots) for r in schedule.groupBy("place").count().withColumnRenamed("count", "n").collect()}
    seen = Counter()
    for i, r in enumerate(slots):
        seen[r.place] += 1
        if i % 50 == 49:
            assert all(abs(seen[p] - share[p] * (i + 1)) <= 8 for p in share)


def test_mixing_edges(odd, empty):
    rows = mixing.mix(odd)[0].collect()
    assert len(rows) == 8
    assert all(r.taken <= 2 * r.size for r in rows)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert out.count() >= 1
    assert mixing.mix(empty)[0].count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(odd.filter("doc_id = 2"))[0].collect()[0].taken == 0


# ---- language-model scores


def brute_katz(texts, held, order=3):
    """The back-off probability by recursion over tuples: of a word after up to two words, longest first."""
    tokens = {k: [*words_of(t), b""] for k, t in texts.items()}
    c = Counter(w for k in tokens if not held[k] for w in tokens[k])
    total, distinct = sum(c.values()), len(c)
    grams = {n: Counter() for n in range(2, order + 1)}
    for k, ws in tokens.items():
        if not held[k]:
            padded = [None] * (order - 1) + ws
            for i in range(order - 1, len(padded)):
                for n in grams:
                    grams[n][tuple(padded[i - n + 1 : i + 1])] += 1
    d = {n: lm.discounts([Counter(g.values())[r] for r in range(1, lm.LARGE + 2)]) for n, g in grams.items()}
    after = {n: defaultdict(dict) for n in grams}
    for n, g in grams.items():
        for x, m in g.items():
            after[n][x[:-1]][x[-1]] = m
    shares = {}

    def p(context, w):
        n = len(context) + 1
        if n == 1:
            return (c[w] + 0.5) / (total + 0.5 * (distinct + 1))
        seen = after[n].get(context)
        if not seen:
            return p(context[1:], w)
        if context not in shares:
            saved = sum(m * (1 - d[n][m - 1]) for m in seen.values() if m <= lm.LARGE)
            shares[context] = sum(seen.values()), saved, 0 if saved > 0 else 0.5, sum(p(context[1:], x) for x in seen)
        of, saved, extra, share = shares[context]
        if w in seen:
            return seen[w] * (d[n][seen[w] - 1] if seen[w] <= lm.LARGE else 1) / (of + extra)
        return (saved + extra) / (of + extra) / (1 - share) * p(context[1:], w)

    return tokens, c, total, p, after


def check_katz(rows, texts, held):
    tokens, c, total, p, after = brute_katz(texts, held)
    assert rows.keys() == texts.keys()
    for k, r in rows.items():
        ws = tokens[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(w in c for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10(p((), w)) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p((a, b), w)) for a, b, w in zip([None, None, *ws], [None, *ws], ws, strict=False)), rel=1e-9)
    for n in after:
        for context in list(after[n])[:8]:
            assert sum(p(context, w) for w in c) + p(context, b"never seen") == pytest.approx(1, rel=1e-9)


def test_op8(spark, texts):
    rows = {r.doc_id: r for r in queries()["op8_lm_scoring"](spark, SF).collect()}
    check_katz(rows, texts, {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts})


def test_katz_of_small_batches_and_hot_contexts(spark, monkeypatch):
    """Texts over many batches and shards, few words, contexts of which most are hot; a text longer than a batch."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "BATCH", 150)
    monkeypatch.setattr(lm, "HOT", 40)
    random.seed(18)
    texts = {i: " ".join(random.choice("a a a a b b c d e f".split()) for _ in range(random.randint(0, 30))) for i in range(120)}
    texts[500] = " ".join(random.choice("abcdefg") for _ in range(400))
    held = {k: k % 5 == 1 for k in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check_katz({r.doc_id: r for r in lm.katz_scores(df, F.col("doc_id") % 5 == 1).collect()}, texts, held)


def test_words_of_texts_are_those_of_split():
    random.seed(23)
    some = [None, "", " ", *("".join(random.choices("aB\0\t\n\v\f\r  \x1c\x1f\x85\xa0\u2003éÀİ", k=random.randint(1, 12))) for _ in range(2000))]
    found, counts = lm.words_of(pa.array(["left out", *some])[1:])
    assert counts.tolist() == [len(words_of(x)) for x in some]
    assert [w.encode() for w in found.to_pylist()] == [w for x in some for w in words_of(x)]


def test_numbers_take_the_bytes_they_need():
    for top in (0, 1, 255, 256, 1 << 16, (1 << 62) - 1):
        x = np.append(np.arange(100) % (top + 1), top)
        assert lm._pack(x)[0] == max(1, -(-top.bit_length() // 8))
        assert (lm._unpack(lm._pack(x), np.int64) == x).all()
    for x in (np.zeros(0, np.uint32), np.array([-3, 5]), np.array([0.25, -1e300]), np.array([(1 << 64) - 1], np.uint64)):
        assert (lm._unpack(lm._pack(x), x.dtype) == x).all()


def test_order_by_two_numbers():
    random_ = np.random.default_rng(3)
    for top in (1, 2, 7, 8, 1000, 1 << 31, 1 << 40):
        u, v = random_.integers(0, top, (2, 2000))
        u[::50] = lm.NOWHERE
        by, want = lm.by_two(u, v), np.lexsort((v, u))
        assert (u[by] == u[want]).all() and (v[by] == v[want]).all()


def test_answers_about_triples_are_short(spark, monkeypatch):
    """A context's sum of discounted counts is a fraction, which takes eight bytes; what it is made of takes few."""
    tables = {}
    made = lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, made(df, name)))
    monkeypatch.setattr(lm, "dropped", lambda *tables: None)
    random.seed(17)
    words, weights = [f"w{i}" for i in range(3000)], [1 / (i + 3) for i in range(3000)]
    rows = [(i, " ".join(random.choices(words, weights, k=300))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lm.katz_scores(df, lm.F.col("doc_id") % 5 == 1).count()
    answers = tables["lm-triples"].filter("batch is not null").select("kinds", "low").collect()
    contexts = sum(len(lm._unpack(r.kinds, np.uint32)) // lm.LARGE for r in answers)
    assert contexts > 50_000
    assert sum(len(r.low) for r in answers) < 2.5 * contexts


def test_copies_of_training_texts_stand_out(spark):
    """Of prose whose words are drawn at random, and of which some comes twice, held-out copies of training texts score far above
    all other held-out texts."""
    from pyspark.sql import functions as F

    random.seed(19)
    prose = lambda: " ".join(f"w{int(3000 * random.random() ** 2)}" for _ in range(120))
    copies, others, rest = ([prose() for _ in range(n)] for n in (30, 50, 100))
    rows = [(i, x, i < 80) for i, x in enumerate(copies + others + copies + rest + rest[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    score = {r.doc_id: r.score / r.n_tokens for r in lm.katz_scores(df, F.col("held")).collect()}
    assert min(score[i] for i in range(30)) > max(score[i] for i in range(30, 80)) + 1


def test_katz_edges(odd, empty):
    from pyspark.sql import functions as F

    rows = lm.katz_scores(odd, F.lit(False)).collect()
    assert len(rows) == 8
    assert all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    untrained = lm.katz_scores(odd, F.lit(True)).collect()
    assert [r.train_tokens for r in untrained] == [0] * 8
    assert all(r.score == pytest.approx(r.base_score) for r in untrained)
    assert lm.katz_scores(empty, F.lit(False)).count() == 0
    assert ((lm.discounts([10, 4, 2, 1, 1, 1]) > 0) & (lm.discounts([10, 4, 2, 1, 1, 1]) < 1)).all()
    assert ((lm.discounts([0] * 6) > 0) & (lm.discounts([0] * 6) < 1)).all()


@pytest.mark.parametrize("times", [[184712, 23127, 5984, 1951, 2262, 607], [1482341, 227973, 46941, 19718, 17404, 6993]])
def test_a_bump_leaves_the_discounts_below_it(times):
    """Numbers of pairs of sf0.01 and sf0.1: groups of five copies are many, and a plain discount of count 4 is over 1."""
    cut = 6 * times[5] / times[0]
    plain = [((r + 1) * times[r] / (r * times[r - 1]) - cut) / (1 - cut) for r in range(1, 6)]
    assert plain[3] > 1
    d = lm.discounts(times)
    assert d[:3].tolist() == pytest.approx(plain[:3], rel=1e-9)
    assert ((d > 0) & (d < 1)).all()
    assert (np.diff(d * np.arange(1, 6)) > 0).all()


def test_discounts_of_few_and_odd_counts():
    # exactly log-linear numbers are their own fit
    clean = [1e6 * r**-2.5 for r in range(1, 7)]
    cut = 6 * clean[5] / clean[0]
    assert lm.discounts(clean).tolist() == pytest.approx([((r + 1) * clean[r] / (r * clean[r - 1]) - cut) / (1 - cut) for r in range(1, 6)])
    for times in ([3, 1, 0, 0, 0, 0], [5, 0, 0, 0, 0, 1], [0, 0, 4, 0, 0, 2], [7, 7, 7, 7, 7, 7], [1, 2, 3, 4, 5, 6], [9, 0, 0, 0, 0, 0], [900, 100, 30, 2, 50, 1]):
        d = lm.discounts(times)
        assert ((d > 0) & (d < 1)).all()
        assert (np.diff(d * np.arange(1, 6)) > 0).all()


# ---- token files


@pytest.mark.parametrize(("n", "block", "top"), [(0, 256, 9), (1, 256, 9), (257, 256, 1 << 16), (5000, 256, 3), (3000, 1000, 1 << 16), (20_000, 1024, 50), (1000, 1000, 1)])
def test_coder_round_trip(n, block, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    words, sizes = tokenfiles.encode_blocks(ids, block)
    assert (tokenfiles.decode_blocks(words, sizes, n, block) == ids).all()
    if top == 3:
        assert 2 * len(words) < n  # under 4 bits an id


def test_segments_and_checksums():
    file = io.BytesIO()
    counts, ids = np.array([2, 0, 3]), np.array([5, 6, 5, 6, 7])
    tokenfiles.write_segment(file, np.array([3, 0, 9]), np.array([False, True, False]), counts, ids)
    tokenfiles.write_segment(file, np.array([11]), np.array([False]), np.array([1]), np.array([65535]))
    raw = file.getvalue()
    got = list(tokenfiles.read_segments(io.BytesIO(raw)))
    assert [g[3].tolist() for g in got] == [[5, 6, 5, 6, 7], [65535]]
    assert got[0][1].tolist() == [False, True, False]
    told = lambda found: [[x.tolist() for x in g] for g in found]
    codes = 0
    for at in range(len(raw)):
        for flip in (0x41, 0xFF, 0x80):
            broken = bytearray(raw)
            broken[at] ^= flip
            try:
                changed = list(tokenfiles.read_segments(io.BytesIO(bytes(broken))))
            except ValueError:
                continue
            # bits of a code behind what tells the last id apart say nothing
            assert told(changed) == told(got)
            codes += 1
    assert codes < 3 * 2 * 6
    for at in range(1, len(raw)):
        try:
            assert told(tokenfiles.read_segments(io.BytesIO(raw[:at]))) == told(got[:1])  # cut between segments
        except ValueError:
            continue
    with pytest.raises(ValueError):
        tokenfiles.write_segment(io.BytesIO(), np.array([1]), np.array([False]), np.array([1]), np.array([1 << 16]))


def test_every_order_tells_something():
    """Sequences cost less than the orders below the one that foresees them could tell at best."""
    random_ = np.random.default_rng(4)
    bits = lambda ids: 16 * len(tokenfiles.encode_blocks(ids.astype(np.uint16), 1024)[0]) / len(ids)
    # order 0: few ids; spelt out they'd be 16 bits each
    assert bits(random_.choice(np.arange(1, 9) * 5000, 8192)) < 4.5
    # order 1: the second of a pair follows from the first; counts alone tell log2(80) = 6.3 bits
    pairs = np.stack([np.arange(40) * 900, np.arange(40) * 900 + 7], 1)
    assert bits(pairs[random_.integers(0, 40, 4096)].ravel()) < 5
    # order 2: the third follows from the first, what is between is always the same; or it doesn't
    first, other = random_.integers(0, 16, (2, 2730)) * 900
    triples = lambda third: np.stack([first, np.full(2730, 500), third + 7], 1).ravel()
    assert bits(triples(first)) < 0.8 * bits(triples(other))


def test_probabilities_of_the_orders_add_up():
    """The code of a block is as long as the mixed probabilities say: shares times what each order gives, summed."""
    ids = np.random.default_rng(5).choice([3, 4, 5, 6, 60_000], 1024, p=[0.4, 0.3, 0.2, 0.05, 0.05])
    shares, bits, tables = tokenfiles.Shares(1), 0.0, ({}, {})
    history, happened, log = Counter(), [], {0: 0, **{e: e for _, e in tokenfiles._periods(1024)}}
    for t, x in enumerate(ids.tolist()):
        if t in log and t:
            shares.renew(np.array(happened), t)
            history, happened = Counter(ids[:t].tolist()), []
        before1, before2 = (np.array([ids[t - k] if t >= k else 0], np.int32) for k in (1, 2))
        slots = [int(s[0]) for s in tokenfiles._slots(before1, before2)]
        (p1, c1), (p2, c2) = (tables[k].get(slots[k], (None, 0)) for k in (0, 1))
        same = p1 == p2 and p1 is not None
        state = (c2 << 3) + (c1 << 1) + same
        s2, s1, s0, new = ((int(shares.packed[state]) >> k) & 0xFFFF for k in (48, 32, 16, 0))
        p = s2 * (p2 == x) + s1 * (p1 == x and not same) + s0 * history[x] / max(1, sum(history.values()))
        known = [p2 == x and c2 > 0, p1 == x and c1 > 0 and not same, history[x] > 0, True].index(True)
        p = p if known < 3 else new / 65536
        bits -= math.log2(p / tokenfiles.SHARES)
        happened.append((state << 2) + known)
        for k, (said, c) in enumerate(((p1, c1), (p2, c2))):
            tables[k][slots[k]] = (x, min(c + 1, tokenfiles.SURE) if said == x else 1)
    words = tokenfiles.encode_blocks(ids.astype(np.uint16), 1024)[0]
    assert bits / 16 <= len(words) + 1
    assert len(words) <= bits / 16 * 1.01 + 5


def test_any_other_tokenizer_reads_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    assert not e.by_word
    some = ["Two  spaces, Two", "", None, "\tédition <|endoftext|>"]
    ids, counts = e.encode(some)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in some]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for x in want for i in x]


def test_words_give_the_ids_of_the_text():
    t = Tokenizer.from_file(TOKENIZER)
    weird = ["", None, " a b c\x1cd  e", "Ünḯcödé İstanbul ΑΣ σ Σ.", "it's  THE'LL don't, x.. y., (z.) The. the", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>.", "a​b 　 c", "日本語 テキスト", "é é ́x ﬁ, 7. ７"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in weird]
    small = tokenfiles.Encoder(TOKENIZER, most=4)  # forgets words between any two texts
    for e, groups in ((tokenfiles.Encoder(TOKENIZER), [weird]), (small, [[x] for x in weird + weird])):
        for group, expected in zip(groups, [want] if len(groups) == 1 else [[x] for x in want + want], strict=True):
            ids, counts = e.encode(group)
            assert counts.tolist() == list(map(len, expected))
            assert ids.tolist() == [i for x in expected for i in x]


def test_words_are_told_apart():
    """By all their bytes: zeros at the end, long words that start alike, words that were forgotten in between."""
    random.seed(9)
    some = list({"".join(random.choices("ab\0é", k=random.choice((0, 1, 2, 3, 7, 8, 9, 15, 16, 17, 18, 40)))) for _ in range(20_000)})
    words, known = tokenfiles.Words(), {}
    for i in range(0, len(some), 3000):
        seen = some[: i + 3000]
        found = words.find(pa.array(seen))
        assert found.tolist() == [known.get(w, -1) for w in seen]
        new = [w for w in seen if w not in known]
        words.add(pa.array(new))
        known |= {w: len(known) + k for k, w in enumerate(new)}
        assert words.find(pa.array(new)).tolist() == [known[w] for w in new]
        if i == 6000:
            keep = np.array([k % 3 == 0 for k in range(len(known))])
            words.keep(keep)
            known = {w: k for k, w in enumerate(w for w, j in known.items() if keep[j])}
    assert len(words) == len(known)


def test_texts_come_as_arrow_arrays():
    some = ["One, two.  THREE", None, "", " \t", "x<|endoftext|>Y z\x1c", "naïve, ciónes. a1b2-c3"]
    t, e = Tokenizer.from_file(TOKENIZER), tokenfiles.Encoder(TOKENIZER)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in some]
    for array in (pa.array(some), pa.array(["left out", *some])[1:], pa.array(some, pa.large_string())):
        ids, counts = e.encode(array)
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == [i for x in want for i in x]


def test_codes_carry():
    """Intervals that run over into words given off before, in as many blocks as it takes to meet some."""
    ids = (np.random.default_rng(7).geometric(0.02, 300_000) * 37 % 65536).astype(np.uint16)
    words, sizes = tokenfiles.encode_blocks(ids, 1000)
    assert words.max() <= 0xFFFF and words.itemsize == 2 and (sizes % 2 == 0).all()
    assert (tokenfiles.decode_blocks(words, sizes, len(ids), 1000) == ids).all()


def test_op9(spark, texts):
    rows = {r.doc_id: r for r in queries()["op9_token_files"](spark, SF).collect()}
    t, start = Tokenizer.from_file(TOKENIZER), 0
    assert rows.keys() == texts.keys()
    for k in sorted(texts):
        ids = [*t.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_edges(odd, empty, tmp_path):
    files = tokenfiles.write_tokens(odd, TOKENIZER, str(tmp_path / "t"))
    rows = tokenfiles.read_tokens(files, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    assert [r.key for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [r.n_tokens for r in rows[1:4]] == [1, 1, 1]
    assert all(r.ids[-1] == 2 for r in rows)
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(empty, TOKENIZER, str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


# ---- shingle join


def brute_join(texts):
    sets = {}
    for k, t in texts.items():
        w = words_of(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_op10(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op10_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute_join(texts)


@pytest.mark.parametrize("limits", [{}, {"LEAF": 2, "HELD": 5, "ROWS": 64, "PAIRS_EACH": 0, "ROUNDS": 3}])
def test_join_of_dense_regions(spark, monkeypatch, limits):
    """Large groups of near copies, strangers that share a passage, exact copies; small limits make regions recurse."""
    for name, value in limits.items():
        monkeypatch.setattr(shingles, name, value)
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, passage = {}, [random.choice(vocabulary) for _ in range(40)]
    for group in range(6):
        base = [random.choice(vocabulary) for _ in range(random.randint(30, 90))]
        for _ in range(random.randint(3, 18)):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            texts[len(texts) * 3 + 1] = " ".join(w[random.randint(0, 6) :]) if group % 2 else " ".join(w)
    for _ in range(20):
        texts[len(texts) * 3 + 1] = " ".join(passage + [random.choice(vocabulary) for _ in range(random.randint(5, 25))]).upper()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_components(df).collect()}
    assert got == brute_join(texts)


def test_join_bridges_large_groups(spark):
    """Chains of overlapping windows: groups of near copies in several components, whose shingles are all common. The
    documents between two groups are apart in some of their regions and in the largest component of others."""
    random.seed(1)
    chains = []
    for c in range(60):
        base = [f"c{c}w{i}" for i in range(170)]
        chains.append({})
        for i in range(80):
            at = random.randint(0, 120)
            w = base[at : at + 50 + random.randint(-3, 3)]
            if random.random() < 0.5:
                w[random.choice([0, -1])] = f"u{c}x{i}"
            chains[-1][c * 80 + i] = " ".join(w)
    df = spark.createDataFrame([x for c in chains for x in c.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_components(df).collect()}
    for c in chains:
        want = brute_join(c)
        assert {k: got[k] for k in c} == want


def test_distances_come_from_pairs_that_may_link(spark, monkeypatch):
    """Members of a region that no pivot may link with are in no join of all members with all pivots."""
    seen = []
    made = shingles.open_members
    monkeypatch.setattr(shingles, "open_members", lambda members, star, *rest: seen.append((members, star)) or made(members, star, *rest))
    random.seed(5)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = {i: passage + " " + " ".join(f"x{i}y{j}" for j in range(20 + 4 * (i % 40))) for i in range(120)}
    texts |= {1000 + i: texts[i] + f" end{i}" for i in range(0, 120, 2)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(shingles, "SEEN", 10**6)  # no shingle counts as frequent, so those of the passage are pivots as well
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_components(df).collect()}
    assert got == brute_join(texts)
    members, star = seen[0]
    assert star.columns == ["s", "fp", "p"]
    assert 0 < star.count() < members.count() // 2


def test_join_edges(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in shingles.jaccard_components(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (None, 1, None), (6, 2, 6)], key=str)
    kept = shingles.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6], key=str)
    assert shingles.jaccard_components(empty).count() == 0


def test_sketches_never_exceed_the_difference():
    random = np.random.default_rng(2)
    import zstandard

    read = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).astype(int)
    for _ in range(50):
        every = np.unique(random.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
        a, b = np.sort(random.choice(every, 300, replace=False)), np.sort(random.choice(every, 250, replace=False))
        assert np.abs(read(shingles.sketch_of(a)) - read(shingles.sketch_of(b))).sum() <= len(np.setxor1d(a, b))


def test_linked_sets_may_link_at_their_first_common_shingle():
    """The bound that regions go by, on random pairs at and above the threshold, in random orders."""
    random.seed(9)
    met = 0
    for _ in range(4000):
        n = random.randint(1, 60)
        base = random.sample(range(1000), n)
        x, y = set(base), set(random.sample(base, max(1, n - random.randint(0, n // 4))))
        x |= set(random.sample(range(1000, 1100), random.randint(0, n // 6)))
        y |= set(random.sample(range(1100, 1200), random.randint(0, n // 6)))
        both = len(x & y)
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        met += 1
        rank = dict(zip(range(1200), random.sample(range(1200), 1200), strict=True))
        px, py = (sorted(z, key=rank.get)[: shingles.prefix_length(len(z))] for z in (x, y))
        first = min(set(px) & set(py), key=rank.get)
        assert shingles.may_link(len(x), px.index(first), len(y), py.index(first))
        small, place = (x, px) if len(x) <= len(y) else (y, py)
        assert 7 * place.index(first) <= len(small)
    assert met > 500


# ---- pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "source_mixing", "best_fit_packing"]
    now = docs
    for i, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, now, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if i < 4:
            assert after.columns == docs.columns
        if i == 1:
            texts = {r.doc_id: r.text for r in now.collect()}
            want = brute_join(texts)
            assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
        if i == 2:
            anchors = pii.automaton()
            assert not any(s for r in after.collect() for s in pii.spans(r.text, anchors) if s[2] in pii.BASE)
            assert all(r.n_chars == len(r.text) for r in after.collect())
        now = after
    assert now.count() > 0
