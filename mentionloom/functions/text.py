"""Scalar text functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop terms of the synonym table, label vocabularies, stop words (the common English list of 179 words).
STOP_TERMS = (
    "script", "Interface", "R package", "r package", "interface", "R packag", "r packag", "R packages", "Bioconductor package", "analysis", "BioConductor", "Bioconductor", "Bioconductor package R",
    "Bioconductor/R", "R bioconductor", "R/Bioconductor", "package", "Bioconductor R package", "Bioconductor R-package", "R package)", "R Bioconductor package", "bioconductor", "R/Bioconductor package",
    "Library", "Biothings API and Explorer", "Python", "python", "python programming language", "Python package", "Python Package", "packages", "libraries",
)
DISREGARD = ("package", "software", "Library", "studio", "image", "analysis", "scripts", "language")
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them
    their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
    aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
    wasn't weren weren't won won't wouldn wouldn't""".split()
)
CURATION_LABELS = ("software", "not_software", "unclear", "not_curated")
#: Prefixes of synonyms that need at least this confidence.
PREFIX_LEAST = (("Bioconductor package", 0.935), ("R Bioconductor package", 0.935), ("R/BioConductor package", 0.94), ("R package", 0.94), ("R-package", 0.94))
COPYRIGHT = "©™®"


def collapse_space(c: Column) -> Column:
    """Each run of spaces, tabs and line breaks as one space; ends are kept."""
    return F.regexp_replace(c, r"[ \t\n\r]+", " ")


def split_sentences(c: Column) -> Column:
    """Parts between '. '; empty parts stay."""
    return F.split(c, r"\. ", -1)


def truncated(c: Column, most: int = 512) -> Column:
    return F.substring(c, 1, most)


def license_of(path: Column) -> Column:
    return F.when(F.lower(path).contains("/non_comm/"), "non_comm").otherwise("comm")


def tokens(c: Column) -> Column:
    """Parts between white space, none of them empty."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def clean_token(c: Column) -> Column:
    """Without what isn't in A-z (with the six signs between), digits, space, line break or hyphen."""
    return F.regexp_replace(c, r"[^A-z0-9 \n\-]", "")


def without_digits(c: Column) -> Column:
    return F.translate(c, string.digits + " ", "")


def without_punctuation(c: Column) -> Column:
    return F.translate(c, string.punctuation + " ", "")


def equal_without_copyright(a: Column, b: Column) -> Column:
    """Equal once one of the three signs, and spaces, are gone from both."""
    same = F.lit(False)
    for sign in COPYRIGHT:
        same = same | (F.translate(a, sign + " ", "") == F.translate(b, sign + " ", ""))
    return same


def all_letters(c: Column) -> Column:
    return c.rlike(r"^\p{L}*$")


def surrogate_id(number: Column) -> Column:
    return F.concat(F.lit("SM"), number.cast("string"))


def id_number(c: Column) -> Column:
    return F.substring(c, 3, 20).cast("long")


ANCHOR = r'href="([^"]*)"[^>]*>([^<]*)<'


def anchor(c: Column) -> Column:
    """Link and name of an HTML anchor."""
    return F.struct(F.regexp_extract(c, ANCHOR, 1).alias("link"), F.regexp_extract(c, ANCHOR, 2).alias("name"))


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """True where the text has a keyword as a part, by case; null texts have none."""
    found = F.lit(False)
    for k in keywords:
        found = found | text.contains(k)
    return F.coalesce(found, F.lit(False))


def spacing_pattern(token_text: Column) -> Column:
    """A Java pattern that finds the words of ``token_text`` however they are spaced, inside of longer words too."""
    escaped = F.regexp_replace(token_text, r"([.^$*+?()\[\]{}])", r"\\$1")
    return F.concat(F.lit(r"(?U)\w*"), F.replace(escaped, F.lit(" "), F.lit(" *")), F.lit(r"\w*"))


def detokenized(tokens_: str, text: str) -> Column:
    """The first stretch of column ``text`` that spells column ``tokens_``; without one, the tokens as they are."""
    pattern = spacing_pattern(F.rtrim(F.col(tokens_)))
    found = F.call_function("regexp_extract", F.col(text), pattern, F.lit(0))
    return F.when(F.coalesce(F.col(tokens_), F.lit("")) == "", F.col(tokens_)).when(F.call_function("rlike", F.col(text), pattern), found).otherwise(F.col(tokens_))


def list_literal(c: Column) -> Column:
    """The strings of a list as it is printed, in single or double quotes; null where nothing is listed between brackets."""
    quoted = F.regexp_extract_all(c, F.lit(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""), F.lit(0))
    plain = F.transform(quoted, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(['\"\\])", "$1"))
    return F.when(F.trim(c).rlike(r"(?s)^\[.*\]$"), plain)
