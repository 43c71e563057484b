"""Papers in NXML: metadata, captions and paragraphs as rows of text, by XPath on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mentionloom.functions.text import collapse_space, license_of


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of all .nxml files below a directory."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.nxml", recursiveFileLookup=True).load(path)
    # a document type would be fetched from the network
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "")
    return files.select("path", text.alias("xml"))


def well_formed(papers: DataFrame) -> DataFrame:
    """Papers that parse; others are left out, as one broken paper must not end a run."""
    parsed = F.from_xml("xml", StructType.fromDDL("_corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": "article"})
    # a filter would be pushed below what makes the texts, and would make each of them once more for every use
    kept = F.explode(F.when(F.col("xml").isNotNull() & parsed["_corrupt"].isNull(), F.array("xml")))
    return papers.select(*[kept.alias(c) if c == "xml" else F.col(f"`{c}`") for c in papers.columns])


#: XPath of the values that a paper has once.
ONCE = {
    "pmcid": '//article-meta/article-id[@pub-id-type="pmc"]', "pmid": '//article-meta/article-id[@pub-id-type="pmid"]', "doi": '//article-meta/article-id[@pub-id-type="doi"]',
    "pubdate": "(//article-meta/pub-date/year)[1]", "paper_title": "//article-meta/title-group/article-title", "paper_abstract": "//article-meta/abstract",
}
#: Two characters that no XML may hold, neither as they are nor by reference.
END, TITLE = "\uffff", "\ufffe"


def objects(papers: DataFrame, license: str | None = None) -> DataFrame:
    """Rows (license, location, pmcid, pmid, doi, pubdate, source, number, text): title, abstract, figure and table
    captions, and all body paragraphs, with the section's title as source. A paper is read once and parsed once for all
    that it has once."""
    joined = F.xpath_string("xml", F.lit("concat(" + f",'{END}',".join(ONCE.values()) + ")"))
    one = papers.select("xml", (F.lit(license) if license else license_of(F.col("path"))).alias("license"), F.col("path").alias("location"), F.split(F.coalesce(joined, F.lit("")), END, -1).alias("once"))
    once = {n: F.coalesce(F.get("once", F.lit(i)), F.lit("")) for i, n in enumerate(ONCE)}
    row = lambda source, number, text: F.struct(source.alias("source"), number.cast("int").alias("number"), text.alias("text"))
    all_of = lambda c, pattern: F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    parts = [F.array(*[row(F.lit(n), F.lit(0), once[n]) for n in ("paper_title", "paper_abstract")])]
    captioned = lambda source: lambda x, i: row(F.lit(source), i, plain(F.regexp_extract(x, r"(?s)<caption[^>]*>(.*?)</caption>", 1)))
    # a table or figure has no other one inside
    parts += [F.transform(all_of(F.col("xml"), rf"(?s)<{p}[\s>].*?</{p}>"), captioned(source)) for source, p in (("fig_caption", "fig"), ("tab_caption", "table-wrap"))]
    body = F.regexp_extract("xml", r"(?s)<body[^>]*>(.*)</body>", 1)
    # a paragraph's section is the last title before it
    pieces = all_of(body, r"(?s)<title[^>]*>.*?</title>|<p[\s>].*?</p>")
    marked = F.array_join(F.transform(pieces, lambda x: F.concat(F.when(x.startswith("<title"), TITLE).otherwise(END), x)), "")
    sections = F.transform(F.split(marked, TITLE, -1), lambda s: F.split(s, END, -1))
    titled = F.transform(sections, lambda s: F.struct(collapse_space(plain(s[0])).alias("section"), F.slice(s, 2, F.size(s)).alias("texts")))
    listed = F.flatten(F.transform(titled, lambda s: F.transform(s["texts"], lambda x: F.struct(s["section"].alias("section"), x.alias("text")))))
    parts.append(F.transform(listed, lambda p, i: row(p["section"], i, plain(p["text"]))))
    said = one.select("license", "location", *[collapse_space(once[n]).alias(n) for n in ("pmcid", "pmid", "doi", "pubdate")], F.explode(F.concat(*parts)).alias("o"))
    return said.select("license", "location", "pmcid", "pmid", "doi", F.col("pubdate").try_cast("int").alias("pubdate"), "o.source", "o.number", "o.text")


def plain(xml: Column) -> Column:
    """Text of a piece of XML: marks removed, CDATA sections as they are, the five entities and all numeric references
    resolved. Where something is left to resolve, the XPath function of the JVM parses it, in an element of its own."""
    # an entity of a document type that isn't read stays as its name
    known = F.regexp_replace(xml, r"&(?!(?:lt|gt|quot|apos|amp|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    # prefixes are declared outside of the piece
    bare = F.regexp_replace(known, r"(?s)<!--.*?-->|(<!\[CDATA\[.*?\]\]>)|<[^>]*>", "$1")
    parsed = F.xpath_string(F.concat(F.lit("<t>"), bare, F.lit("</t>")), F.lit("/t"))
    return F.when(bare.rlike(r"[&<\r\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]|\]\]>"), parsed).otherwise(bare)
