"""Fixed schemas. Paper ids are strings: a missing one must not turn the others into floats."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


MENTIONS_RAW = T.StructType([*_strings("license location pmcid pmid doi"), T.StructField("pubdate", T.IntegerType()), *_strings("source"), T.StructField("number", T.IntegerType()), *_strings("text software version")])
MENTIONS_ID = T.StructType([*MENTIONS_RAW, *_strings("ID")])
MENTIONS_LABELED = T.StructType([*MENTIONS_ID, *_strings("curation_label")])
MENTIONS_DISAMBIGUATED = T.StructType([*MENTIONS_LABELED, *_strings("mapped_to_software")])
CURATION_TERMS = T.StructType(_strings("ID label multi_label"))
METADATA = T.StructType([
    *_strings("ID software_mention mapped_to source platform package_url description homepage_url other_urls license github_repo github_repo_license"), T.StructField("exact_match", T.BooleanType()),
    *_strings("RRID reference"), T.StructField("scicrunch_synonyms", T.ArrayType(T.StringType())),
])
