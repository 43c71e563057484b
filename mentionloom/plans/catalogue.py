"""Queries of the mention operators over the driver's tables, with the same queries in SQL.

Lineitems stand in for mentions, part names for mention strings, orders for papers, documents for paper texts, labels
for curation, pages for catalog indexes and events for JSON responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.functions import text as T
from mentionloom.operators import curate, evaluate, extract, graph, ids, link, simjoin, stats, synonyms
from mentionloom.sources import catalogs, nxml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """software, pmid (the order), pmcid (the supplier), doi (order and line), source of each mention."""
    items, parts = _table(spark, sf, "lineitem"), _table(spark, sf, "part")
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    return joined.select(F.col("p_name").alias("software"), F.col("l_orderkey").alias("pmid"), F.col("l_suppkey").alias("pmcid"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("doi"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("text"), F.col("p_brand").alias("brand"), F.col("l_shipdate").alias("shipped"))


MENTIONS = """m AS (SELECT p_name AS software, l_orderkey AS pmid, l_suppkey AS pmcid, concat_ws('/', l_orderkey, l_linenumber) AS doi, l_returnflag AS source, l_linestatus AS text, p_brand AS brand
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@_register(f"WITH {MENTIONS} SELECT software, count(DISTINCT pmid) AS num_pmid FROM m WHERE software IS NOT NULL GROUP BY software ORDER BY num_pmid DESC, software LIMIT 10")
def top_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_k(stats.frequency(_mentions(spark, sf), "software", {"num_pmid": "pmid"}), "num_pmid", "software", 10)


@_register(f"WITH {MENTIONS} SELECT software, count(DISTINCT pmid) AS num_pmid, count(DISTINCT pmcid) AS num_pmcid, count(DISTINCT doi) AS num_doi FROM m WHERE software IS NOT NULL GROUP BY software")
def mentions_all_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return stats.nunique(_mentions(spark, sf).select("software", "pmid", "pmcid", "doi"), "software")


LOADED = """SELECT software, num_pmids, num_pmcids, num_dois FROM (SELECT software, count(DISTINCT pmid) AS num_pmids, count(DISTINCT pmcid) AS num_pmcids, count(DISTINCT doi) AS num_dois
    FROM m WHERE software IS NOT NULL GROUP BY software) WHERE num_pmcids >= 50 ORDER BY num_pmids DESC, software LIMIT 20"""


@_register(f"WITH {MENTIONS} {LOADED}")
def load_mentions_thresholded(spark: SparkSession, sf: str) -> DataFrame:
    return stats.load_mentions(_mentions(spark, sf), freq_threshold=50, top=20)


@_register("""WITH i AS (SELECT 'SM' || p_partkey AS ID, p_name AS software, l_orderkey AS pmid, l_suppkey AS pmcid, concat_ws('/', l_orderkey, l_linenumber) AS doi FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT * FROM i WHERE ID NOT IN (SELECT 'SM' || s_suppkey FROM supplier) AND CAST(substr(ID, 3) AS BIGINT) >= 50 AND CAST(substr(ID, 3) AS BIGINT) < 1500)
    SELECT software, count(DISTINCT pmid) AS num_pmids, count(DISTINCT pmcid) AS num_pmcids, count(DISTINCT doi) AS num_dois FROM m WHERE software IS NOT NULL GROUP BY software HAVING count(DISTINCT pmcid) >= 1""")
def load_mentions_id_range(spark: SparkSession, sf: str) -> DataFrame:
    items, parts = _table(spark, sf, "lineitem"), _table(spark, sf, "part")
    rows = items.join(parts, items.l_partkey == parts.p_partkey).select(T.surrogate_id(F.col("p_partkey")).alias("ID"), F.col("p_name").alias("software"), F.col("l_orderkey").alias("pmid"), F.col("l_suppkey").alias("pmcid"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("doi"))
    seen = _table(spark, sf, "supplier").select(T.surrogate_id(F.col("s_suppkey")).alias("ID"))
    return stats.load_mentions(rows, id_start=50, id_end=1500, seen=seen)


@_register("""SELECT pubdate, software, num_pmid, rank FROM (SELECT *, row_number() OVER (PARTITION BY pubdate ORDER BY num_pmid DESC, software) AS rank FROM (
    SELECT year(o_orderdate) AS pubdate, p_name AS software, count(DISTINCT l_orderkey) AS num_pmid FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE rank <= 5""")
def top_by_year(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("pmid"), F.year("o_orderdate").alias("pubdate"))
    return stats.top_by(stats.by_paper(_mentions(spark, sf), orders, "pmid"), "pubdate", "software", "pmid", 5)


@_register(f"WITH {MENTIONS} SELECT * FROM (SELECT software, count(DISTINCT pmid) AS num_pmid FROM m GROUP BY software ORDER BY num_pmid, software DESC LIMIT 20)")
def bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bottom_k(stats.frequency(_mentions(spark, sf), "software", {"num_pmid": "pmid"}), "num_pmid", "software", 20)


@_register("""SELECT source, count(DISTINCT doc_id) AS num_pmid FROM documents WHERE source IS NOT NULL AND (contains(text, 'the ') OR contains(text, 'License')) GROUP BY source ORDER BY num_pmid DESC, source LIMIT 10""")
def keyword_field_top(spark: SparkSession, sf: str) -> DataFrame:
    return stats.field_top(_table(spark, sf, "documents"), "text", ["the ", "License"], "source", "doc_id", 10)


@_register("SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS low, CAST(max(year(o_orderdate)) AS INTEGER) AS high FROM orders")
def year_range(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_range(_table(spark, sf, "orders").select(F.year("o_orderdate").alias("pubdate")), "pubdate")


@_register(f"""WITH {MENTIONS}, c AS (SELECT pmid, source, text, brand, count(*) AS n FROM m GROUP BY ALL)
    SELECT a.brand AS mention_a, b.brand AS mention_b, CAST(sum(2 * a.n * b.n) AS BIGINT) AS pairs FROM c a JOIN c b ON a.pmid = b.pmid AND a.source = b.source AND a.text = b.text AND a.brand < b.brand GROUP BY 1, 2""")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cooccurrence(_mentions(spark, sf), ["pmid", "source", "text"], "brand")


@_register(f"WITH {MENTIONS} SELECT pmid, source, text, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1")
def multi_mention_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return stats.multi_mention_sentences(_mentions(spark, sf), ["pmid", "source", "text"], "brand").select("pmid", "source", "text", F.size("mentions").cast("long").alias("n"))


FIRST = "f AS (SELECT p_name AS software, min(p_partkey) AS first FROM part WHERE p_name IS NOT NULL GROUP BY p_name)"


@_register(f"WITH {FIRST} SELECT software, 'SM' || (row_number() OVER (ORDER BY first, software) - 1) AS ID FROM f")
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ids.assign_ids(_table(spark, sf, "part").select(F.col("p_name").alias("software"), F.col("p_partkey").alias("pos")))


@_register(f"""WITH {FIRST}, k AS (SELECT p_name AS software, min(p_partkey) AS first FROM part WHERE p_partkey <= 20 GROUP BY p_name), known AS (SELECT software, row_number() OVER (ORDER BY first, software) - 1 AS n FROM k),
    new AS (SELECT software, row_number() OVER (ORDER BY first, software) - 1 + (SELECT count(*) FROM k) AS n FROM f WHERE software NOT IN (SELECT software FROM k))
    SELECT software, 'SM' || n AS ID FROM (SELECT * FROM known UNION ALL SELECT * FROM new)""")
def update_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "part").select(F.col("p_name").alias("software"), F.col("p_partkey").alias("pos"))
    return ids.update_ids(ids.assign_ids(rows.filter("pos <= 20")), rows)


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """A document's labels: toxic is not_software, good quality software, bad quality unclear; some have two."""
    rows = _table(spark, sf, "labels").select(F.col("doc_id").alias("ID"), F.when(F.col("quality") == 1, "software").otherwise("unclear").alias("a"), F.when(F.col("toxic") == 1, "not_software").alias("b"))
    return rows.select("ID", F.explode(F.array("a", "b")).alias("label")).filter("label is not null")


LABELS = "t AS (SELECT doc_id AS ID, CASE WHEN quality = 1 THEN 'software' ELSE 'unclear' END AS label FROM labels UNION ALL SELECT doc_id, 'not_software' FROM labels WHERE toxic = 1)"
LABELED = """l AS (SELECT d.doc_id AS ID, CASE WHEN d.doc_id IN (SELECT ID FROM t WHERE label = 'software') THEN 'software' WHEN d.doc_id IN (SELECT ID FROM t WHERE label = 'not_software') THEN 'not_software'
    WHEN d.doc_id IN (SELECT ID FROM t WHERE label = 'unclear') THEN 'unclear' ELSE 'not_curated' END AS curation_label FROM documents d)"""


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("ID"))


@_register(f"WITH {LABELS}, {LABELED} SELECT ID, curation_label FROM l")
def curation_label(spark: SparkSession, sf: str) -> DataFrame:
    return curate.label(_papers(spark, sf), _terms(spark, sf))


@_register(f"WITH {LABELS} SELECT doc_id AS ID FROM documents WHERE doc_id NOT IN (SELECT ID FROM t WHERE label = 'not_software')")
def curated_only(spark: SparkSession, sf: str) -> DataFrame:
    return curate.curated(_papers(spark, sf), _terms(spark, sf))


@_register(f"""WITH {LABELS}, {LABELED}, x AS (SELECT unnest(['software', 'not_software', 'unclear', 'not_curated']) AS label)
    SELECT label, (SELECT count(*) FROM l WHERE curation_label = label) AS n, round((SELECT count(*) FROM l WHERE curation_label = label) / (SELECT count(*) FROM l) * 100, 6) AS percent FROM x""")
def curation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.shares(curate.label(_papers(spark, sf), _terms(spark, sf)), "curation_label", T.CURATION_LABELS)
    return rows.withColumn("percent", F.round("percent", 6))


SPLIT = r"""s AS (SELECT doc_id AS id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS sentence_no FROM (SELECT doc_id, string_split(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), '. ') AS p FROM documents WHERE text IS NOT NULL))"""


@_register(f"WITH {SPLIT} SELECT id, CAST(sentence_no AS INTEGER) AS sentence_no, substr(sentence, 1, 512) AS sentence FROM s")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return extract.sentences(_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@_register(r"""SELECT conv_id, turn, CAST(len(string_split(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), '. ')) AS BIGINT) AS sentences FROM conversations WHERE text IS NOT NULL""")
def conversation_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", F.size(T.split_sentences(T.collapse_space(F.col("text")))).cast("long").alias("sentences"))


@_register("SELECT page_id, CASE WHEN contains(lower(url), '/non_comm/') THEN 'non_comm' ELSE 'comm' END AS license FROM pages")
def license_from_path(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", T.license_of(F.col("url")).alias("license"))


NAMES = {"the", "de", "der", "la"}


@_register(rf"""WITH {SPLIT}, w AS (SELECT id, sentence_no, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT id, sentence_no, list_filter(string_split_regex(substr(sentence, 1, 512), '[ \x09-\x0D\x1C-\x1F\x{{85}}\x{{A0}}]+'), lambda x: x <> '') AS l FROM s)),
    n AS (SELECT id, sentence_no, pos, trim(w, '.,;:()') AS name FROM w WHERE trim(w, '.,;:()') IN ('the', 'de', 'der', 'la')), g AS (SELECT *, pos - row_number() OVER (PARTITION BY id, sentence_no ORDER BY pos) AS run FROM n),
    m AS (SELECT id, string_agg(name, ' ' ORDER BY pos) AS software FROM g GROUP BY id, sentence_no, run) SELECT id, software, count(*) AS n FROM m GROUP BY id, software""")
def mention_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions by document, from the dictionary tagger; adjacent names are one mention."""
    sents = extract.sentences(_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return extract.mentions(sents, extract.dictionary_tagger(NAMES)).groupBy("id", "software").agg(F.count("*").alias("n"))


@_register(r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '[a-z]+ [a-z]+') AS pair FROM documents), p AS (SELECT doc_id, text, replace(pair, ' ', '  ') AS spaced FROM d WHERE pair <> '')
    SELECT doc_id, regexp_extract(text, '[\p{L}\p{N}\p{M}_]*' || replace(spaced, ' ', ' *') || '[\p{L}\p{N}\p{M}_]*') AS software FROM p""")
def detokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    pair = F.regexp_extract("text", "[a-z]+ [a-z]+", 0)
    rows = docs.select("doc_id", "text", F.replace(pair, F.lit(" "), F.lit("  ")).alias("software")).filter("software <> ''")
    return extract.detokenize(rows, "text", ("software",)).select("doc_id", "software")


ANCHORS = r"""a AS (SELECT page_id, regexp_extract(x, 'href="([^"]*)"[^>]*>([^<]*)<', 1) AS link, regexp_extract(x, 'href="([^"]*)"[^>]*>([^<]*)<', 2) AS name
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)<')) AS x FROM pages))"""


@_register(f"WITH {ANCHORS} SELECT page_id, link, name FROM a")
def index_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.anchors(_table(spark, sf, "pages"), keep=["page_id"])


WORDS = r"w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS word FROM documents)"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter("word <> ''").distinct()


@_register(f"WITH {ANCHORS}, {WORDS} SELECT name AS package, 'https://pypi.org/project/' || name AS url FROM a WHERE name IN (SELECT word FROM w WHERE word <> '')")
def index_links(spark: SparkSession, sf: str) -> DataFrame:
    raw = catalogs.pypi(_table(spark, sf, "pages"))
    return link.matched(raw, _words(spark, sf), "pypi package", "word").select(F.col("pypi package").alias("package"), F.col("pypi_url").alias("url"))


@_register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response for each brand, whose hits are its part names in order of keys."""
    hits = _table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("l"))
    items = F.transform("l", lambda x: F.struct(x["p_name"].alias("name"), F.lit("d").alias("description"), F.concat(F.lit("https://host/"), x["p_partkey"]).alias("url"), F.struct(F.lit("MIT").alias("name")).alias("license")))
    # every second brand asks for its third hit's name
    asked = F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 0, F.coalesce(F.get("l", F.lit(2))["p_name"], F.col("p_brand"))).otherwise(F.col("p_brand"))
    return hits.select(F.col("p_brand").alias("brand"), asked.alias("mention"), F.to_json(F.struct(F.size("l").alias("total_count"), items.alias("items"))).alias("json"))


@_register("""WITH h AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS names, list(p_partkey ORDER BY p_partkey) AS keys FROM part GROUP BY p_brand),
    a AS (SELECT *, CASE WHEN CAST(right(p_brand, 1) AS INTEGER) % 2 = 0 THEN coalesce(names[3], p_brand) ELSE p_brand END AS mention FROM h)
    SELECT mention AS software_mention, coalesce(names[list_position(names, mention)], names[1]) AS best_github_match, 'https://host/' || coalesce(keys[list_position(names, mention)], keys[1]) AS github_url, list_position(names, mention) IS NOT NULL AND list_position(names, mention) > 0 AS exact_match FROM a""")
def json_best_hit(spark: SparkSession, sf: str) -> DataFrame:
    return link.best_hit(_responses(spark, sf)).select("software_mention", "best_github_match", "github_url", "exact_match")


@_register(f"""WITH {ANCHORS}, p AS (SELECT name AS software_mention, 'PyPI Index' AS source, 'https://pypi.org/project/' || name AS package_url, CAST(NULL AS BOOLEAN) AS exact_match FROM a),
    g AS (SELECT p_name AS software_mention, 'Github API' AS source, 'https://host/' || p_brand AS package_url, p_size % 2 = 0 AS exact_match FROM part)
    SELECT DISTINCT * FROM (SELECT * FROM p UNION ALL SELECT * FROM g) WHERE source IS DISTINCT FROM 'Github API' OR exact_match""")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    index = link.normalize_pypi(catalogs.pypi(_table(spark, sf, "pages")))
    part = _table(spark, sf, "part").select(F.col("p_name").alias("software_mention"), F.col("p_name").alias("best_github_match"), F.concat(F.lit("https://host/"), "p_brand").alias("github_url"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("license"), (F.col("p_size") % 2 == 0).alias("exact_match"))
    return link.merge([index, link.normalize_github(part)]).select("software_mention", "source", "package_url", "exact_match")


@_register(f"WITH {ANCHORS}, {WORDS} SELECT DISTINCT name FROM a WHERE name IN (SELECT word FROM w WHERE word <> '' UNION SELECT p_name FROM part)")
def common_catalog_names(spark: SparkSession, sf: str) -> DataFrame:
    a = catalogs.anchors(_table(spark, sf, "pages")).select("name")
    return synonyms.shared_names(a, _words(spark, sf).withColumnRenamed("word", "name"), _table(spark, sf, "part").select(F.col("p_name").alias("name")), "name")


COLOURS = ("red", "blue", "hot", "new")


@_register("""WITH m AS (SELECT DISTINCT p_name AS mention FROM part WHERE p_name IS NOT NULL), k AS (SELECT DISTINCT string_split(mention, ' ')[2] AS package FROM m)
    SELECT k.package, mention FROM m JOIN k ON string_split(mention, ' ')[2] = k.package WHERE string_split(mention, ' ')[1] IN ('red', 'blue', 'hot', 'new')""")
def keyword_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    said = _table(spark, sf, "part").select(F.col("p_name").alias("software_mention")).filter("p_name is not null").distinct()
    packages = said.select(F.get(F.split("software_mention", " "), F.lit(1)).alias("mapped_to")).distinct()
    return synonyms.keyword_synonyms(packages, said, COLOURS)


def _similar(spark: SparkSession, sf: str, threshold: float, q: int) -> DataFrame:
    s = _table(spark, sf, "part").select(F.col("p_name").alias("software"))
    return simjoin.similar_pairs(s, s, threshold=threshold, q=q)


@_register("""WITH s AS (SELECT DISTINCT p_name AS s FROM part WHERE length(p_name) >= 2) SELECT a.s AS software_mention, b.s AS synonym, round(jaro_winkler_similarity(a.s, b.s), 9) AS synonym_conf FROM s a, s b WHERE jaro_winkler_similarity(a.s, b.s) >= 0.8""")
def string_sim_q1(spark: SparkSession, sf: str) -> DataFrame:
    return _similar(spark, sf, 0.8, 1).withColumn("synonym_conf", F.round("synonym_conf", 9))


#: DuckDB compares the bytes of two strings; every bigram (54 there are) becomes one byte.
BIGRAMS = """s AS (SELECT DISTINCT p_name AS s FROM part WHERE length(p_name) >= 2), x AS (SELECT s, i, substr(s, i, 2) AS gram FROM (SELECT s, unnest(range(1, length(s))) AS i FROM s)),
    code AS (SELECT gram, chr(CAST(33 + row_number() OVER (ORDER BY gram) AS INTEGER)) AS c FROM (SELECT DISTINCT gram FROM x)), t AS (SELECT s, string_agg(c, '' ORDER BY i) AS t FROM x JOIN code USING (gram) GROUP BY s)"""


@_register(f"WITH {BIGRAMS} SELECT a.s AS software_mention, b.s AS synonym, round(jaro_winkler_similarity(a.t, b.t), 9) AS synonym_conf FROM t a, t b WHERE jaro_winkler_similarity(a.t, b.t) >= 0.75")
def string_sim_q2(spark: SparkSession, sf: str) -> DataFrame:
    return _similar(spark, sf, 0.75, 2).withColumn("synonym_conf", F.round("synonym_conf", 9))


def _raw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names against numbered, dotted and other forms of themselves, one confidence each by balance."""
    c = _table(spark, sf, "customer").select("c_name", "c_mktsegment", "c_nationkey")
    forms = F.array(F.concat("c_name", F.lit(" 2")), F.replace("c_name", F.lit("#"), F.lit("-")), F.concat(F.lit("R package "), "c_name"), F.col("c_mktsegment"), F.col("c_name"), F.lit("python"), F.concat("c_name", F.lit("®")))
    rows = c.select(F.col("c_name").alias("software_mention"), F.posexplode(forms).alias("form", "synonym"), "c_nationkey")
    return rows.select("software_mention", "synonym", (F.lit(0.9) + F.col("c_nationkey") / 400).alias("synonym_conf"), F.lit("string_similarity").alias("synonym_source"))


@_register("""WITH r AS (SELECT c_name AS m, unnest([c_name || ' 2', replace(c_name, '#', '-'), 'R package ' || c_name, c_mktsegment, c_name, 'python', c_name || '®']) AS s, 0.9::DOUBLE + c_nationkey::DOUBLE / 400 AS conf FROM customer),
    d AS (SELECT DISTINCT * FROM r WHERE s <> 'python' AND m <> s AND NOT (starts_with(s, 'R package') AND conf < 0.94)),
    f AS (SELECT *, translate(m, '0123456789 ', '') = translate(s, '0123456789 ', '') AS digits, regexp_replace(m, '[ -/:-@[-`{-~]', '', 'g') = regexp_replace(s, '[ -/:-@[-`{-~]', '', 'g') AS punct,
        translate(m, '© ', '') = translate(s, '© ', '') OR translate(m, '™ ', '') = translate(s, '™ ', '') OR translate(m, '® ', '') = translate(s, '® ', '') AS sign FROM d)
    SELECT m AS software_mention, s AS synonym, round(CASE WHEN digits OR punct OR sign THEN 1.0 ELSE conf END, 9) AS synonym_conf, starts_with(s, m) AS is_substr FROM f
    WHERE NOT (regexp_full_match(m, '\\p{L}*') AND regexp_full_match(s, '\\p{L}*') AND NOT digits AND NOT punct)""".replace("\\\\", "\\"))
def combine_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _raw_pairs(spark, sf)
    named = pairs.select(F.col("software_mention").alias("software"), F.lit("SM0").alias("ID")).distinct()
    return synonyms.combine(pairs, named).select("software_mention", "synonym", F.round("synonym_conf", 9).alias("synonym_conf"), "is_substr")


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """Part names are linked when they share a word that starts with a letter up to n; confidence by the letter."""
    words = _table(spark, sf, "part").select(F.col("p_name").alias("v")).distinct().select("v", F.explode(F.split("v", " ")).alias("w"))
    a, b = words.select(F.col("v").alias("software_mention"), "w"), words.select(F.col("v").alias("synonym"), "w")
    conf = F.when(F.substring("w", 1, 1) <= "g", 0.95).when(F.substring("w", 1, 1) <= "n", 0.92).otherwise(0.5)
    return a.join(b, "w").filter("software_mention < synonym").select("software_mention", "synonym", conf.cast("double").alias("synonym_conf"))


EDGES = """words AS (SELECT v, unnest(string_split(v, ' ')) AS w FROM (SELECT DISTINCT p_name AS v FROM part)),
    e AS (SELECT a.v AS src, b.v AS dst, max(CASE WHEN substr(a.w, 1, 1) <= 'g' THEN 0.95 WHEN substr(a.w, 1, 1) <= 'n' THEN 0.92 ELSE 0.5 END)::DOUBLE AS conf FROM words a JOIN words b ON a.w = b.w AND a.v < b.v GROUP BY 1, 2),
    b AS (SELECT src, dst, conf FROM e UNION ALL SELECT dst, src, conf FROM e), v AS (SELECT DISTINCT src AS v FROM b)"""
NEAR = "near AS (SELECT src, dst FROM b WHERE 1 - conf <= 0.1 + 1e-12)"


@_register(f"""WITH RECURSIVE {EDGES}, strong AS (SELECT src, dst FROM b), r AS (SELECT v, v AS c FROM v UNION SELECT s.dst, r.c FROM r JOIN strong s ON s.src = r.v)
    SELECT v, min(c) AS component FROM r GROUP BY v""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.edges(_graph(spark, sf))
    return graph.components(graph.vertices(_graph(spark, sf)), e)


CORES = f"{NEAR}, deg AS (SELECT src AS v, count(*) + 1 AS n FROM near GROUP BY 1), core AS (SELECT v FROM deg WHERE n >= 10)"
SPLITS = """r AS (SELECT v, v AS c FROM core UNION SELECT near.dst, r.c FROM r JOIN near ON near.src = r.v JOIN core ON core.v = near.dst), comp AS (SELECT v, min(c) AS c FROM r GROUP BY v),
    border AS (SELECT near.src AS v, min(comp.c) AS c FROM near JOIN comp ON comp.v = near.dst GROUP BY 1), k AS (SELECT v.v, coalesce(comp.c, border.c) AS cluster FROM v LEFT JOIN comp ON comp.v = v.v LEFT JOIN border ON border.v = v.v)"""


@_register(f"WITH RECURSIVE {EDGES}, {CORES}, {SPLITS} SELECT v, cluster FROM k")
def dbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph(spark, sf)
    return graph.dbscan(graph.vertices(pairs), graph.edges(pairs), 0.1, 10)


@_register(f"""WITH RECURSIVE {EDGES}, {CORES}, {SPLITS}, q AS (SELECT v, coalesce(cluster, '') AS g FROM k), sz AS (SELECT g, count(*) AS n FROM q GROUP BY g),
    dist AS (SELECT x.v, x.g, y.g AS h, sum(1 - coalesce(b.conf, CASE WHEN x.v = y.v THEN 1 ELSE 0 END)) AS d FROM q x, q y LEFT JOIN b ON b.src = x.v AND b.dst = y.v GROUP BY ALL),
    ab AS (SELECT v, dist.g, max(CASE WHEN dist.g = h AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN dist.g <> h THEN d / n END) AS b FROM dist JOIN sz ON sz.g = h GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 9) AS silhouette FROM ab""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph(spark, sf)
    e = graph.edges(pairs)
    return graph.silhouette(graph.dbscan(graph.vertices(pairs), e, 0.1, 10), e).select(F.round("silhouette", 9).alias("silhouette"))


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frequency(_mentions(spark, sf), "software", {"freq": "pmid"})


NAMED = """fr AS (SELECT p_name AS v, count(DISTINCT l_orderkey) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), nm AS (SELECT cluster, arg_min(k.v, (-coalesce(freq, 0), k.v)) AS name FROM k LEFT JOIN fr ON fr.v = k.v WHERE cluster IS NOT NULL GROUP BY cluster)"""


@_register(f"WITH RECURSIVE {EDGES}, {CORES}, {SPLITS}, {NAMED} SELECT cluster, name FROM nm")
def cluster_names(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph(spark, sf)
    return graph.names(graph.dbscan(graph.vertices(pairs), graph.edges(pairs), 0.1, 10), _frequencies(spark, sf))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph(spark, sf)
    clusters = graph.dbscan(graph.vertices(pairs), graph.edges(pairs), 0.1, 10)
    return graph.checkpointed(clusters.join(graph.names(clusters, _frequencies(spark, sf)), "cluster"))


@_register(f"""WITH RECURSIVE {EDGES}, {CORES}, {SPLITS}, {NAMED} SELECT coalesce(nm.name, p_name) AS mapped_to_software, count(DISTINCT l_orderkey) AS num_pmid FROM lineitem JOIN part ON l_partkey = p_partkey
    LEFT JOIN k ON k.v = p_name LEFT JOIN nm ON nm.cluster = k.cluster GROUP BY 1""")
def mention_to_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frequency(graph.map_mentions(_mentions(spark, sf), _named(spark, sf)), "mapped_to_software", {"num_pmid": "pmid"})


@_register(f"""WITH RECURSIVE {EDGES}, {CORES}, {SPLITS}, t AS (SELECT cluster FROM k WHERE v = (SELECT min(v) FROM k WHERE cluster IS NOT NULL))
    SELECT cluster, p_name AS software, count(DISTINCT l_orderkey) AS num_papers FROM lineitem JOIN part ON l_partkey = p_partkey JOIN k ON k.v = p_name WHERE cluster IN (SELECT cluster FROM t) GROUP BY 1, 2""")
def entity_profile(spark: SparkSession, sf: str) -> DataFrame:
    clusters = _named(spark, sf).select(F.col("v").alias("software"), "cluster")
    first = clusters.agg(F.min("software")).first()[0]
    return stats.profile(_mentions(spark, sf), clusters, first)


#: Entities: components of all edges, density clusters of the largest, their silhouette, names by papers.
LARGEST = """ar AS (SELECT v, v AS c FROM v0 UNION SELECT b0.dst, ar.c FROM ar JOIN b0 ON b0.src = ar.v), parts AS (SELECT v, min(c) AS c FROM ar GROUP BY v), big AS (SELECT c FROM parts GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
    v AS (SELECT v FROM parts JOIN big USING (c)), b AS (SELECT b0.* FROM b0 JOIN v ON v.v = b0.src)"""
WIDTHS = """q AS (SELECT v, coalesce(cluster, '') AS g FROM k), sz AS (SELECT g, count(*) AS n FROM q GROUP BY g),
    dist AS (SELECT x.v, x.g, y.g AS h, sum(1 - coalesce(b.conf, CASE WHEN x.v = y.v THEN 1 ELSE 0 END)) AS d FROM q x, q y LEFT JOIN b ON b.src = x.v AND b.dst = y.v GROUP BY ALL),
    ab AS (SELECT v, dist.g, max(CASE WHEN dist.g = h AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN dist.g <> h THEN d / n END) AS b FROM dist JOIN sz ON sz.g = h GROUP BY 1, 2),
    take AS (SELECT coalesce(avg(CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 0) > 0 OR (SELECT count(*) FROM sz) <= 1 AS yes FROM ab)"""


@_register(f"""WITH RECURSIVE {EDGES.replace("b AS (SELECT src", "b0 AS (SELECT src").replace("v AS (SELECT DISTINCT src AS v FROM b)", "v0 AS (SELECT DISTINCT src AS v FROM b0)")}, {LARGEST}, {CORES}, {SPLITS}, {WIDTHS},
    fr AS (SELECT p_name AS v, count(DISTINCT l_orderkey) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    c AS (SELECT v, 'component:' || c AS cluster FROM parts WHERE c NOT IN (SELECT c FROM big) UNION ALL SELECT v, 'cluster:' || CASE WHEN yes THEN cluster ELSE '*' END FROM k, take WHERE NOT yes OR cluster IS NOT NULL),
    nm AS (SELECT cluster, arg_min(c.v, (-coalesce(freq, 0), c.v)) AS name FROM c LEFT JOIN fr ON fr.v = c.v GROUP BY cluster)
    SELECT v, cluster, name FROM c JOIN nm USING (cluster) UNION ALL SELECT v, 'single:' || v, v FROM k, take WHERE yes AND cluster IS NULL""")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: components, density clusters of the largest, silhouette gate, names."""
    return graph.entities(_graph(spark, sf), _frequencies(spark, sf), 0.1, 10)


@_register("""WITH x AS (SELECT unnest(['correct', 'incorrect', 'unclear']) AS label), r AS (SELECT DISTINCT doc_id, CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 THEN 'correct' ELSE 'unclear' END AS l FROM labels)
    SELECT label, (SELECT count(*) FROM r WHERE l = label) AS n, round((SELECT count(*) FROM r WHERE l = label) / (SELECT count(*) FROM r) * 100, 6) AS percent FROM x""")
def eval_linking(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "labels").select(F.col("doc_id").alias("software_mention"), F.when(F.col("toxic") == 1, "incorrect").when(F.col("quality") == 1, "correct").otherwise("unclear").alias("link_label"))
    return evaluate.linking(rows).withColumn("percent", F.round("percent", 6))


@_register("""WITH x AS (SELECT unnest(['correct', 'unclear', 'incorrect', 'not_software']) AS label), r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'not_software' WHEN quality = 0 THEN 'incorrect' WHEN doc_id % 3 = 2 THEN 'unclear' ELSE 'correct' END AS l FROM labels)
    SELECT label, (SELECT count(*) FROM r WHERE l = label) AS n, round((SELECT count(*) FROM r WHERE l = label) / (SELECT count(*) FROM r) * 100, 6) AS percent FROM x""")
def eval_disambiguation(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "Not software").when(F.col("quality") == 0, "Not synonym").otherwise(F.element_at(F.array(F.lit("Exact"), F.lit("Narrow"), F.lit("Unclear")), (F.col("doc_id") % 3 + 1).cast("int")))
    rows = _table(spark, sf, "labels").select(F.col("doc_id").alias("software_mention"), F.col("doc_id").alias("synonym"), kind.alias("synonym_label"))
    return evaluate.disambiguation(rows).withColumn("percent", F.round("percent", 6))


def _table_page(spark: SparkSession, sf: str, cells: list) -> DataFrame:
    """One page whose table has a head and a row for each part."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    rows = _table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    return rows.select(F.concat(F.lit("<table><tr><th>Name</th></tr>"), "rows", F.lit("</table>")).alias("html"))


@_register("""SELECT DISTINCT p_name AS software_mention, 'CRAN' AS source, 'https://cran.r-project.org/web/packages/' || p_partkey || '/index.html' AS package_url, p_type AS description FROM part""")
def cran_links(spark: SparkSession, sf: str) -> DataFrame:
    """The CRAN index: a name with a relative link, and a title with marks inside, in each row of a table."""
    name = F.concat(F.lit('<a href="../../web/packages/'), F.col("p_partkey"), F.lit('/index.html">'), F.col("p_name"), F.lit("</a>"))
    raw = catalogs.cran(_table_page(spark, sf, [name, F.concat(F.lit(" <b>"), "p_type", F.lit("</b>"))]))
    return raw.select(F.col("CRAN Package").alias("software_mention"), F.lit("CRAN").alias("source"), F.col("CRAN Link").alias("package_url"), F.col("Title").alias("description")).distinct()


@_register("""SELECT DISTINCT lower(p_type) AS package, 'https://www.bioconductor.org/packages/release/bioc/' || p_partkey AS link, p_brand AS maintainer, p_name AS title FROM part""")
def bioconductor_links(spark: SparkSession, sf: str) -> DataFrame:
    """The Bioconductor index, names in lower case."""
    name = F.concat(F.lit('<a href="bioc/'), F.col("p_partkey"), F.lit('">'), F.col("p_type"), F.lit("</a>"))
    raw = catalogs.bioconductor(_table_page(spark, sf, [name, F.col("p_brand"), F.col("p_name")]))
    return raw.select(F.col("Bioconductor Package").alias("package"), F.col("BioConductor Link").alias("link"), F.col("Maintainer").alias("maintainer"), F.col("Title").alias("title")).distinct()


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    """A response for each part name: the query's expansions, and a row with a linked resource name; every third part's is another's."""
    part = _table(spark, sf, "part")
    named = F.when(F.col("p_partkey") % 3 == 0, F.lit("other")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" tool")))
    link = F.concat(F.lit('&lt;a href="https://host/'), F.col("p_partkey"), F.lit('"&gt;'), named, F.lit("&lt;/a&gt;"))
    said = F.concat(F.lit("<query><clauses><clauses><expansion><expansion>"), "p_name", F.lit(" tool</expansion><expansion>x</expansion></expansion></clauses></clauses></query>"))
    data = lambda n, v: F.concat(F.lit(f"<data><name>{n}</name><value>"), v, F.lit("</value></data>"))
    return part.select("p_partkey", F.col("p_name").alias("mention"), F.concat(F.lit("<response>"), said, F.lit("<result><results><row>"), data("Resource Name", link), data("Resource ID", F.concat(F.lit("RRID:"), "p_partkey")), F.lit("</row></results></result></response>")).alias("xml"))


@_register("""SELECT p_name AS mention, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name || ' tool' END AS resource, 'RRID:' || p_partkey AS rrid, 'https://host/' || p_partkey AS link FROM part WHERE p_partkey % 3 <> 0""")
def scicrunch_links(spark: SparkSession, sf: str) -> DataFrame:
    """Resources whose linked name is the mention or one of its expansions, by lower case."""
    found = catalogs.scicrunch(_resources(spark, sf))
    return found.select(F.col("software_name").alias("mention"), F.col("Resource Name").alias("resource"), F.col("Resource ID").alias("rrid"), F.col("Resource Name Link").alias("link"))


@_register("""SELECT DISTINCT p_name AS mention, unnest([p_name || ' tool', 'x', lower(p_name), p_name]) AS synonym FROM part WHERE p_partkey % 3 <> 0 AND p_name IS NOT NULL""")
def resource_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Expansions of the resources that were found, and each with itself."""
    return synonyms.catalog_synonyms(catalogs.scicrunch(_resources(spark, sf)), "software_name")


@_register("""WITH r AS (SELECT DISTINCT p_brand AS software_mention, p_name AS synonym, 1.0::DOUBLE AS synonym_conf, 'keywords' AS synonym_source FROM part)
    SELECT * FROM r WHERE software_mention IN (SELECT software_mention FROM r GROUP BY 1 HAVING count(*) >= 46)""")
def scored_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "part").select(F.col("p_brand").alias("software_mention"), F.col("p_name").alias("synonym"))
    return synonyms.scored(pairs, "keywords", least=46)


#: A paper for each document: its first words as title, two paragraphs in a section, references and marks inside.
@_register(r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, regexp_replace(substr(coalesce(text, ''), 1, 200), '[^a-zA-Z ]', '', 'g') AS t, regexp_replace(substr(coalesce(text, ''), 201, 200), '[^a-zA-Z ]', '', 'g') AS u FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS pmid, 2000 + CAST(doc_id % 20 AS INTEGER) AS pubdate, source, CAST(number AS INTEGER) AS number, text FROM (
    SELECT *, unnest(['paper_title', 'paper_abstract', 'fig_caption', 'Methods', 'Methods']) AS source, unnest([0, 0, 0, 0, 1]) AS number, unnest([lang || ' ' || chr(945) || t, u, 'Fig ' || u, t || ' & ' || u || chr(160) || '<x>', u]) AS text FROM d)""")
def nxml_objects(spark: SparkSession, sf: str) -> DataFrame:
    plain = lambda a: F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), a, 200), "[^a-zA-Z ]", "")
    d = _table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), plain(1).alias("t"), plain(201).alias("u"))
    xml = F.concat(
        F.lit("<article><front><article-meta><article-id pub-id-type=\"pmid\">"), "doc_id", F.lit("</article-id><title-group><article-title>"), "lang", F.lit(" &#x3b1;"), "t",
        F.lit("</article-title></title-group><pub-date><year>"), (F.col("doc_id") % 20 + 2000).cast("string"), F.lit("</year></pub-date><abstract>"), "u",
        F.lit("</abstract></article-meta></front><body><sec><title>Methods</title><p><i>"), "t", F.lit("</i> &amp; "), "u", F.lit("&#160;<![CDATA[<x>]]></p><p id=\"2\">"), "u",
        F.lit("</p></sec><fig><caption>Fig "), "u", F.lit("</caption></fig></body></article>"),
    )
    papers = d.select(F.concat(F.lit("/comm/"), "doc_id", F.lit(".nxml")).alias("path"), xml.alias("xml"))
    return nxml.objects(nxml.well_formed(papers)).select("pmid", "pubdate", "source", "number", "text")


@_register("""WITH m AS (SELECT doc_id, 'SM' || doc_id % 50 AS ID FROM documents), t AS (SELECT DISTINCT 'SM' || doc_id % 50 AS ID, doc_id AS pos, CASE WHEN quality = 1 THEN 'software' ELSE 'not_software' END AS label FROM labels),
    l AS (SELECT ID, arg_max(label, pos) AS label FROM t GROUP BY ID) SELECT doc_id, ID, label FROM m LEFT JOIN l USING (ID)""")
def last_curation_label(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.concat(F.lit("SM"), F.col("doc_id") % 50).alias("ID")
    terms = _table(spark, sf, "labels").select(id_, F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, "software").otherwise("not_software").alias("label"))
    return curate.last_label(_table(spark, sf, "documents").select("doc_id", id_), terms, "pos").select("doc_id", "ID", "label")


@_register("""WITH f AS (SELECT p_name AS software, 'SM' || (row_number() OVER (ORDER BY min(p_partkey), p_name) - 1) AS ID FROM part WHERE p_name IS NOT NULL GROUP BY p_name) SELECT p_partkey, software, ID FROM part JOIN f ON p_name = software""")
def strict_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention has an id, or the query fails."""
    part = _table(spark, sf, "part").filter("p_name is not null").select("p_partkey", F.col("p_name").alias("software"))
    return ids.with_ids(part, ids.assign_ids(part, position="p_partkey"), strict=True).select("p_partkey", "software", "ID")
