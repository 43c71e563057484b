"""Semantics of single operators on small hand-made tables."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mentionloom.functions import text as T
from mentionloom.functions.similarity import jaro_winkler
from mentionloom.operators import curate, evaluate, extract, graph, ids, link, simjoin, stats, synonyms
from mentionloom.plans import catalogue
from mentionloom.plans.schema import CURATION_TERMS, MENTIONS_RAW
from mentionloom.sources import catalogs, nxml, stage, tables
from mentionloom.streaming import ingest
from tests.conftest import DATA


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [("ImageJ", "Image J", 0.893333), ("scikit-learn", "scikit-learn python", 0.922222), ("SPSS", "SPSS®", 0.941667), ("MATLAB", "Matlab", 0.0), ("GraphPad Prism", "GraphPad Prism 6", 0.973333), ("limma", "limma R package", 0.857143), ("a", "ab", 0.0), ("ab", "ab", 1.0)])
def test_jaro_winkler(a, b, want):
    assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)


def test_similarity_join_is_brute_force(spark):
    random.seed(5)
    names = list({"".join(random.choice("abc ") for _ in range(random.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in [*names, None]], "software string")
    for q, threshold in ((2, 0.9), (1, 0.85)):
        got = {(r[0], r[1]): r[2] for r in simjoin.similar_pairs(df, df, threshold=threshold, q=q).collect()}
        want = {(a, b): s for a in names for b in names if len(a) >= 2 and len(b) >= 2 and (s := jaro_winkler(a, b, q)) >= threshold}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        simjoin.similar_pairs(df, df, threshold=0.7)


def test_text_functions(spark):
    assert one(spark, " a\t\n b  ", T.collapse_space) == " a b "
    assert one(spark, "A. B. ", T.split_sentences) == ["A", "B", ""]
    assert one(spark, "", T.split_sentences) == [""]
    assert one(spark, "x" * 600, T.truncated) == "x" * 512
    assert one(spark, "data/Non_Comm/x", T.license_of) == "non_comm"
    assert one(spark, "non_comm/x", T.license_of) == "comm"
    assert one(spark, " a  b ", T.tokens) == ["a", "b"]
    assert one(spark, "(lim-ma_1)!", T.clean_token) == "lim-ma_1"
    assert one(spark, "Prism 5", T.without_digits) == "Prism"
    assert one(spark, "R/B-c d", T.without_punctuation) == "RBcd"
    assert one(spark, "SPSSé", T.all_letters) is True
    assert one(spark, "SPSS 2", T.all_letters) is False
    assert one(spark, "SM10", T.id_number) == 10
    assert one(spark, '<a href="/x">Y</a>', T.anchor) == Row(link="/x", name="Y")
    assert one(spark, None, lambda c: T.any_keyword(c, ["a"])) is False
    pairs = spark.createDataFrame([("SPSS", "SPSS®"), ("a©", "a®")], "a string, b string")
    assert [r[0] for r in pairs.select(T.equal_without_copyright(F.col("a"), F.col("b"))).collect()] == [True, False]


@pytest.mark.parametrize(("tokens", "text", "want"), [
    ("scikit - learn", "we use scikit-learn here", "scikit-learn"), ("C + +", "in C++ code", "C++"), ("naive tool", "naïve tool", "naive tool"), ("", "abc", ""), ("gone", "abc", "gone"), ("tool", "äxtooly z", "äxtooly"),
])
def test_detokenize(spark, tokens, text, want):
    df = spark.createDataFrame([(tokens, text)], "software string, text string")
    assert extract.detokenize(df, "text", ("software",)).first()["software"] == want


def test_collapse():
    tagged = [("SPSS", "B-software"), ("22", "B-version"), ("Prism", "B-software"), ("Pad", "I-software")]
    assert extract.collapse(tagged) == [("SPSS", "22"), ("Prism Pad", "")]
    assert extract.collapse(tagged, legacy=True) == [("SPSS", "22"), ("Prism", "22"), ("Pad", "22")]
    assert extract.collapse([("x", "O"), ("R", "B-software"), ("y", "O"), ("3", "B-version")]) == [("R", "")]
    assert extract.collapse([("3", "B-version"), ("R", "B-software")]) == [("", "3"), ("R", "")]
    assert extract.collapse([("p", "PAD")]) == []
    assert extract.glued([("Ima", "B-software"), ("##ge", "I-software"), ("J", "O")]) == [("Image", "B-software"), ("J", "O")]


def test_mentions(spark):
    df = spark.createDataFrame([(1, "We used ImageJ 1.5 here. And ImageJ, R 3"), (2, None)], "id long, text string")
    rows = extract.mentions(extract.sentences(df), extract.dictionary_tagger({"ImageJ", "R"})).collect()
    assert [(r.id, r.sentence_no, r.software, r.version) for r in rows] == [(1, 0, "ImageJ", "1.5"), (1, 1, "ImageJ R", "3")]


def test_ids(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3), ("c", 9_000_000_000)], "software string, pos long")
    first = {r.software: r.ID for r in ids.assign_ids(df).collect()}
    assert first == {"b": "SM0", "a": "SM1", "c": "SM2"}
    known = ids.assign_ids(df.filter("pos < 2"))
    more = spark.createDataFrame([("z", 0), ("a", 1), ("y", 2)], "software string, pos long")
    assert {r.software: r.ID for r in ids.update_ids(known, more).collect()} == {"b": "SM0", "a": "SM1", "z": "SM2", "y": "SM3"}
    assert ids.assign_ids(df.filter("pos < 0")).count() == 0
    assert {r.software: r.ID for r in ids.with_ids(more, known).collect()} == {"z": None, "a": "SM1", "y": None}
    with pytest.raises(Exception, match="no id"):
        ids.with_ids(more, known, strict=True).collect()


def test_curation(spark):
    m = spark.createDataFrame([("SM0",), ("SM1",), ("SM2",), ("SM3",)], "ID string")
    t = spark.createDataFrame([("SM0", "software", None), ("SM0", "not_software", None), ("SM1", "unclear", None), ("SM2", "not_software", None)], CURATION_TERMS)
    assert {r.ID: r.curation_label for r in curate.label(m, t).collect()} == {"SM0": "software", "SM1": "unclear", "SM2": "not_software", "SM3": "not_curated"}
    assert sorted(r.ID for r in curate.curated(m, t).collect()) == ["SM1", "SM3"]
    order = spark.createDataFrame([("SM0", "a", 1), ("SM0", "b", 2)], "ID string, label string, n int")
    assert {r.ID: r.label for r in curate.last_label(m, order, "n").collect()}["SM0"] == "b"


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "correct", None), ("a", "correct", None), ("b", "incorrect", "Github API"), ("c", "other", "x")], "software_mention string, link_label string, source_y string")
    assert [(r.label, r.n, r.percent) for r in evaluate.linking(rows).collect()] == [("correct", 1, 50.0), ("incorrect", 1, 50.0), ("unclear", 0, 0.0)]
    assert [r.n for r in evaluate.linking(rows, without_github=True).collect()] == [2, 0, 0]
    assert evaluate.extraction(spark.createDataFrame([("1", "software", "database")], CURATION_TERMS), multi=True).filter("label = 'database'").first().percent == 100.0
    assert [r.percent for r in evaluate.linking(rows.filter("false")).collect()] == [None] * 3


def test_stats_nulls(spark):
    df = spark.createDataFrame([("a", "1"), ("a", None), (None, "2")], "software string, pmid string")
    assert stats.nunique(df, "software").collect() == [Row(software="a", num_pmid=1)]
    assert stats.without(df, "software", "a").count() == 1
    s = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (1, "t", "b"), (2, "t", "a"), (2, "t", "a"), (None, "t", "a"), (None, "t", "b")], "pmid int, text string, m string")
    assert [tuple(r) for r in stats.cooccurrence(s, ["pmid", "text"], "m").collect()] == [("a", "b", 4)]
    assert stats.multi_mention_sentences(s, ["pmid", "text"], "m").count() == 2
    e = spark.createDataFrame([("x", "not_disambiguated"), ("y", "Y")], "software string, mapped_to_software string")
    assert [r.mapped_to_software for r in stats.entity(e).collect()] == ["x", "Y"]
    assert stats.sample_rows(df, 2).count() == 2


def keyword_loop(packages, mentions, clues, shared, strict, disregard):
    out = set()
    for m in mentions:
        if m in packages:
            out.add((m, m))
            continue
        words = m.split()
        hit = next((w for w in (extract_clean(x) for x in reversed(words)) if w in packages and w not in disregard), None)
        if hit and set(words) & set(strict if hit in shared else clues):
            out.add((hit, m))
    return out


def extract_clean(word):
    import re

    return re.sub(r"[^A-z0-9 \n\-]", "", word)


def test_keyword_synonyms(spark):
    packages, shared = {"limma", "numpy", "package", "knn"}, {"knn"}
    said = ["limma", "limma R package", "the numpy.", "numpy (Python)", "R knn", "knn R-package", "package R", "a limma numpy python", "limma"]
    p = spark.createDataFrame([(x,) for x in [*packages, None]], "mapped_to string")
    m = spark.createDataFrame([(x,) for x in [*said, None]], "software_mention string")
    clues, strict = ("R", "package", "Python", "python", "R-package"), ("R-package",)
    got = {tuple(r) for r in synonyms.keyword_synonyms(p, m, clues, spark.createDataFrame([(x,) for x in shared], "n string"), strict).collect()}
    assert got == keyword_loop(packages, said, clues, shared, strict, T.DISREGARD + T.STOP_WORDS)


def test_combine(spark):
    pairs = [("SPSS", "SPSS®", 0.93), ("Prism 5", "Prism 6", 0.93), ("Image J", "image j", 0.91), ("SPSS", "python", 1.0), ("a1", "a1", 1.0), ("x1", "R package x", 0.93), ("x1", "R package y", 0.95), ("abc", "abd", 0.99), ("gone", None, 1.0)]
    raw = spark.createDataFrame([(*p, "s") for p in pairs], "software_mention string, synonym string, synonym_conf double, synonym_source string")
    named = spark.createDataFrame([("SPSS", "SM0"), ("Prism 6", "SM1")], "software string, ID string")
    got = {(r.software_mention, r.synonym): (r.synonym_conf, r.ID, r.synonym_ID) for r in synonyms.combine(raw, named).collect()}
    assert got == {("SPSS", "SPSS®"): (1.0, "SM0", None), ("Prism 5", "Prism 6"): (1.0, None, "SM1"), ("Image J", "image j"): (1.0, None, None), ("x1", "R package y"): (0.95, None, None)}
    assert synonyms.combine(raw, named, 0.97).count() == 3
    lists = synonyms.as_lists(raw.na.drop(), "software_mention", "synonym", "synonym_conf").filter("software_mention = 'SPSS'").first()
    assert lists.synonyms == ["SPSS®", "python"]
    assert synonyms.scored(raw.select("software_mention", "synonym"), "x").select("software_mention").distinct().count() == 2
    page = "<h2>Synonym(s)</h2><div><p>A, B</p></div><h2>Abbreviation(s)</h2><p>C</p>"
    assert one(spark, page, synonyms.page_synonyms) == ["A", "B", "C"]


def union_find(edges, vertices):
    root = {v: v for v in vertices}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def test_components(spark):
    random.seed(2)
    names = [f"v{i:03d}" for i in range(120)]
    pairs = [tuple(random.sample(names, 2)) for _ in range(70)] + [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(40)]
    e = graph.edges(spark.createDataFrame([(a, b, 0.95) for a, b in pairs], "software_mention string, synonym string, synonym_conf double"))
    v = spark.createDataFrame([(n,) for n in names], "v string")
    assert {r.v: r.component for r in graph.components(v, e).collect()} == union_find(pairs, names)


def test_silhouette_and_entities(spark):
    import numpy as np

    # two dense groups of 12 with weak links between, one border vertex, one noise vertex
    names = [f"a{i:02d}" for i in range(12)] + [f"b{i:02d}" for i in range(12)] + ["c", "d"]
    pairs = [(x, y, 0.95) for g in "ab" for i, x in enumerate(n for n in names if n[0] == g) for y in [n for n in names if n[0] == g][i + 1 :]] + [("a00", "b00", 0.5), ("a01", "c", 0.93), ("b01", "d", 0.6)]
    df = spark.createDataFrame(pairs, "software_mention string, synonym string, synonym_conf double")
    e = graph.edges(df)
    labels = {r.v: r.cluster for r in graph.dbscan(graph.vertices(df), e, 0.1, 10).collect()}
    assert {k: v for k, v in labels.items() if k in ("a05", "b05", "c", "d")} == {"a05": "a00", "b05": "b00", "c": "a00", "d": None}
    dist = np.ones((26, 26)) - np.eye(26)
    for a, b, c in pairs:
        i, j = names.index(a), names.index(b)
        dist[i, j] = dist[j, i] = 1 - c
    of = [labels[n] or "" for n in names]
    s = []
    for i, n in enumerate(names):
        own = [j for j in range(26) if of[j] == of[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, [j for j in range(26) if of[j] == o]].mean() for o in set(of) - {of[i]})
        s.append((b - a) / max(a, b))
    got = graph.silhouette(spark.createDataFrame(list(labels.items()), "v string, cluster string"), e).first()[0]
    assert got == pytest.approx(np.mean(s))
    freq = spark.createDataFrame([("a03", 9), ("b02", 4), ("b01", 4)], "software string, freq long")
    named = {r.v: r.name for r in graph.entities(df, freq, 0.1, 10).collect()}
    assert (named["a00"], named["c"], named["b00"], named["d"]) == ("a03", "a03", "b01", "d")
    m = graph.map_mentions(spark.createDataFrame([("a00",), ("zz",)], "software string"), graph.entities(df, freq, 0.1, 10))
    assert {r.software: r.mapped_to_software for r in m.collect()} == {"a00": "a03", "zz": "zz"}


def test_links(spark):
    body = '{"total_count": 2, "items": [{"name": "x", "url": "u1"}, {"name": "q", "url": "u2", "license": {"name": "MIT"}}]}'
    r = spark.createDataFrame([("q", body), ("z", body), ("n", '{"total_count": 0, "items": []}'), ("bad", "{")], "mention string, json string")
    got = {x.software_mention: (x.best_github_match, x.github_url, x.license, x.exact_match) for x in link.best_hit(r).collect()}
    assert got == {"q": ("q", "u2", "MIT", True), "z": ("x", "u1", None, False), "n": (None, None, None, False), "bad": (None, None, None, False)}
    merged = link.merge([link.normalize_github(link.best_hit(r)), link.normalize_pypi(spark.createDataFrame([("q", "u"), ("q", "u")], "`pypi package` string, pypi_url string"))])
    assert sorted((x.software_mention, x.source) for x in merged.collect()) == [("q", "Github API"), ("q", "PyPI Index")]
    html = "<table><tr><th>h</th></tr><tr><td><a href=\"../../web/x.html\">X</a></td><td>Title &amp; x</td></tr><tr><td>one</td></tr></table>"
    pages = spark.createDataFrame([(html,)], "html string")
    assert [tuple(x) for x in catalogs.cran(pages).collect()] == [("X", "https://cran.r-project.org/web/x.html", "Title &amp; x")]
    assert catalogs.bioconductor(pages).first()[0] == "x"
    catalog = link.Catalog("cran", lambda m: link.matched(catalogs.cran(pages), m, "CRAN Package"), link.normalize_cran)
    linked = link.link(spark.createDataFrame([("X",)], "software_mention string"), catalog, spark.createDataFrame([("X", "SM7")], "software string, ID string"))
    assert (linked.first().ID, linked.first().source, len(linked.columns)) == ("SM7", "CRAN Index", 16)
    xml = """<response><query><clauses><clauses><expansion><expansion>Fiji</expansion><expansion>IJ</expansion></expansion></clauses></clauses></query>
    <result><results><row><data><name>Resource Name</name><value>&lt;a href="http://r"&gt;FIJI&lt;/a&gt;</value></data><data><name>Resource ID</name><value>RRID:1</value></data></row></results></result></response>"""
    found = catalogs.scicrunch(spark.createDataFrame([("imagej", xml), ("none", "<response></response>"), ("bad", "<")], "mention string, xml string")).collect()
    assert [(x["software_name"], x["Resource Name"], x["Resource Name Link"], x["Resource ID"]) for x in found] == [("imagej", "FIJI", "http://r", "RRID:1")]
    asked = catalogs.fetched(spark.createDataFrame([("a",), ("b",)], "software_mention string"), lambda m: (200, m.upper()) if m == "a" else (500, ""), tries=2, wait=0.0, partitions=1)
    assert {x.mention: x.body for x in asked.collect()} == {"a": "A", "b": None}


def test_tables(spark, tmp_path):
    header = "\t".join(MENTIONS_RAW.fieldNames())
    short = "comm\tx\t1\t\t\t2020\tbody\t3\ttext\t\"R"
    (tmp_path / "a.tsv").write_text(f"{header}\n{short}\t1.0\n{short}\n{short}\t1\textra\n")
    df = tables.read_tsv(spark, str(tmp_path / "a.tsv"), MENTIONS_RAW, position="pos")
    rows = df.collect()
    assert [(r.software, r.version, r.pmid, r.pubdate, r.number) for r in rows] == [('"R', "1.0", None, 2020, 3), ('"R', None, None, 2020, 3)]
    tables.write_tsv(df.drop("pos"), str(tmp_path / "out"))
    assert tables.read_tsv(spark, str(tmp_path / "out"), MENTIONS_RAW).count() == 2
    tables.write_csv(df.select("software"), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).columns == ["software"]
    assert tables.read_csv(spark, str(tmp_path / "csv"), index=True).columns == []
    both = tables.union_files(spark, [str(tmp_path / "csv")] * 2, tables.read_csv)
    assert both.count() == 4
    assert tables.read_or_empty(spark, str(tmp_path / "none"), MENTIONS_RAW).count() == 0
    tables.write_batches(spark.createDataFrame([("SM1",), ("SM20000",)], "ID string"), str(tmp_path / "b"))
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [0, 2]
    assert one(spark, "a/b ", tables.output_name) == "f_a_b"
    with pytest.raises(FileNotFoundError):
        stage.cached(spark, str(tmp_path / "s"), lambda: df)
    assert stage.cached(spark, str(tmp_path / "s"), lambda: df, generate=True).count() == 2
    assert stage.cached(spark, str(tmp_path / "s"), lambda: df).count() == 2


PAPER = """<?xml version="1.0"?><article><front><article-meta><article-id pub-id-type="pmid">12</article-id><article-id pub-id-type="doi">10/x</article-id>
<title-group><article-title>The  title</article-title></title-group><pub-date><year>2019</year></pub-date></article-meta></front>
<body><sec><title>Methods</title><p>We used <italic>R</italic> &amp; more.</p><p>Second.</p></sec><fig id="f"><caption><p>Fig one</p></caption></fig></body></article>"""


def test_parts_of_papers_grow_in_number(spark, tmp_path, monkeypatch):
    """Eight times the mentions are in more parts, not in larger ones; the query's parts go by the files that it reads."""
    monkeypatch.setattr(stats, "PART_BYTES", 1 << 14, raising=False)
    size = lambda *paths: sum(f.stat().st_size for p in paths for f in ([Path(p)] if Path(p).is_file() else Path(p).glob("*.parquet")))
    parts = lambda *paths: max(spark.sparkContext.defaultParallelism, -(-size(*paths) // (1 << 14)))
    tables_ = [f"{DATA}/sf0.01/{t}.parquet" for t in ("lineitem", "part", "orders")]
    plan = catalogue.queries()["top_by_year"](spark, f"{DATA}/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert {int(n) for n in re.findall(r"hashpartitioning\(pmid#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)} == {parts(*tables_)}
    largest = []
    for n in (20_000, 160_000):
        m, p = str(tmp_path / f"m{n}"), str(tmp_path / f"p{n}")
        spark.range(n).select(F.xxhash64(F.col("id") % (n // 4)).alias("pmid"), (F.col("id") % 7).alias("software")).write.parquet(m)
        spark.range(n // 4).select(F.xxhash64("id").alias("pmid"), (F.col("id") % 3).alias("year")).write.parquet(p)
        rows = stats.by_paper(spark.read.parquet(m), spark.read.parquet(p), "pmid")
        counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == n
        largest.append(max(counts))
    assert largest[1] < 2 * largest[0]
    # what has no known size is joined as it is
    known = spark.createDataFrame([("a", 1), ("b", 1), ("b", None)], "software string, pmid long")
    assert stats.by_paper(known, spark.createDataFrame([(1, 2000)], "pmid long, year int"), "pmid").count() == 2


def test_nxml(spark, tmp_path):
    (tmp_path / "ok.nxml").write_text(PAPER)
    (tmp_path / "bad.nxml").write_text("<article><front>")
    (tmp_path / "skip.txt").write_text(PAPER)
    rows = nxml.objects(nxml.well_formed(nxml.read_papers(spark, str(tmp_path)))).collect()
    got = {(r.source, r.number): r.text for r in rows}
    assert got[("paper_title", 0)] == "The  title"
    assert got[("paper_abstract", 0)] == ""
    assert got[("fig_caption", 0)] == "Fig one"
    assert got[("Methods", 0)] == "We used R & more."
    assert got[("Methods", 1)] == "Second."
    assert {(r.pmid, r.doi, r.pmcid, r.pubdate, r.license) for r in rows} == {("12", "10/x", "", 2019, "comm")}


def test_nxml_sections_and_captions(spark):
    """Marks, references and titles inside of pieces; titles without paragraphs, paragraphs before any title; papers without text."""
    body = "<p>a &#x3b1;</p><sec><title>One <b>&amp;</b></title><p id='1'>x\r\ny<title>no</title></p><sec><title>Two</title></sec><sec><title/><p/><p><![CDATA[<x>]]> &quot;</p></sec></sec>"
    xml = f"<article><front/><body>{body}</body><fig><caption><title>F.</title><p>é</p></caption></fig><fig/><fig></fig><table-wrap id='t'><caption>T<!-- - --></caption></table-wrap></article>"
    papers = spark.createDataFrame([("/non_comm/1", xml), ("/2", None), ("/3", ""), ("/4", "<article><p></article>")], "path string, xml string")
    rows = nxml.objects(nxml.well_formed(papers)).collect()
    assert {(r.license, r.location, r.pmid, r.pubdate) for r in rows} == {("non_comm", "/non_comm/1", "", None)}
    got = sorted((r.source, r.number, r.text) for r in rows)
    assert got == sorted([("paper_title", 0, ""), ("paper_abstract", 0, ""), ("fig_caption", 0, "F.é"), ("fig_caption", 1, ""), ("tab_caption", 0, "T"), ("", 0, "a α"), ("One &", 1, "x\nyno"), ("Two", 2, '<x> "')])
    # without a text there's still a title and an abstract
    assert sorted((r.source, r.text) for r in nxml.objects(papers.filter("xml is null")).collect()) == [("paper_abstract", ""), ("paper_title", "")]


def test_nxml_makes_each_paper_once(spark):
    """Texts are made once and parsed as a whole twice, for being well-formed and for what a paper has once."""
    made = spark.createDataFrame([("/1", PAPER)], "path string, part string").select("path", F.reverse(F.reverse(F.concat("part", F.lit(" ")))).alias("xml"))
    plan = nxml.objects(nxml.well_formed(made))._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("reverse(reverse("), plan.count("from_xml("), plan.count(").evaluate(xml#"), plan.count("Union")) == (1, 1, 1, 0)


def test_streaming(spark, tmp_path):
    schema = spark.createDataFrame([("a", 0)], "software string, pos long").schema
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 0), ("b", 1)], schema).coalesce(1).write.parquet(source)
    run = lambda: ingest.ingest_ids(spark, source, schema, str(tmp_path / "ids"), str(tmp_path / "c1"))
    assert {r.software: r.ID for r in run().collect()} == {"a": "SM0", "b": "SM1"}
    spark.createDataFrame([("c", 0), ("a", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    assert {r.software: r.ID for r in run().collect()} == {"a": "SM0", "b": "SM1", "c": "SM2"}
    assert {r.software: r.ID for r in run().collect()} == {"a": "SM0", "b": "SM1", "c": "SM2"}
    for _ in range(2):
        ingest.ingest(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_list_literals(spark):
    rows = [("['a', \"it's\"]", ["a", "it's"]), ("[]", []), ("['x\\\\y', 'q\\'s']", ["x\\y", "q's"]), ("none", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").orderBy("i").select(T.list_literal(F.col("s"))).collect()]
    assert got == [w for _, w in rows]


def test_command_line(spark, tmp_path):
    from mentionloom.__main__ import main

    papers, names = tmp_path / "papers", tmp_path / "names.txt"
    papers.mkdir()
    (papers / "ok.nxml").write_text(PAPER.replace("R</italic> &amp; more", "R</italic> 3.2 &#945;"))
    names.write_text("R\n")
    main(["extract", str(papers), str(tmp_path / "m"), "--names", str(names)])
    assert [(r.software, r.version) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("R", "3.2")]
    spark.createDataFrame([("R", "1"), ("R", "2"), ("Stata", "1"), ("Rr", "1")], "software string, pmcid string").coalesce(1).write.parquet(str(tmp_path / "t"))
    main(["top", str(tmp_path / "t"), str(tmp_path / "top"), "--top-k", "1", "--format", "csv"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "top"), header=True).collect()] == [("R", "2")]
    main(["assign-ids", str(tmp_path / "t"), str(tmp_path / "i")])
    assert {r.software: r.ID for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {"R": "SM0", "Stata": "SM1", "Rr": "SM2"}
    main(["similar", str(tmp_path / "t"), str(tmp_path / "s")])
    assert {(r.software_mention, r.synonym) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("Stata", "Stata"), ("Rr", "Rr")}


@pytest.mark.parametrize("threshold", [0.75, 0.85, 0.9])
def test_similar_pairs_lose_none(spark, threshold):
    """Against all pairs of random strings of like and unlike sizes."""
    random.seed(int(threshold * 100))
    some = {"".join(random.choice("abcd") for _ in range(random.randint(2, 14))) for _ in range(60)}
    some |= {x[: random.randint(0, 3)] + "d" + x[2:] for x in list(some)}
    df = spark.createDataFrame([(x,) for x in some], "software string")
    got = {(r.software_mention, r.synonym) for r in simjoin.similar_pairs(df, df, threshold=threshold).collect()}
    kept = [x for x in some if len(x) >= 2]
    assert got == {(x, y) for x in kept for y in kept if jaro_winkler(x, y) >= threshold}
