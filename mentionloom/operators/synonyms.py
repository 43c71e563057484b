"""Scored synonym pairs of mentions: by keywords, from catalogs, by string similarity, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.functions import text as T

# Clue words by catalog, and those that still count for names that PyPI and R catalogs share.
CLUES = {"pypi": ("python", "Python", "API"), "CRAN": ("R", "r", "package", "Package", "R-package", "R-Package", "r-package"), "Bioconductor": ("R", "r", "package", "Package", "R-package", "R-Package", "r-package", "bioconductor", "Bioconductor")}
SHARED_CLUES = {"pypi": (), "CRAN": ("R-package", "R-Package", "r-package"), "Bioconductor": ("R-package", "R-Package", "r-package", "bioconductor", "Bioconductor")}


def shared_names(pypi: DataFrame, cran: DataFrame, bioconductor: DataFrame, name: str = "mapped_to") -> DataFrame:
    """Names in PyPI and in an R catalog."""
    return pypi.select(name).intersect(cran.select(name).union(bioconductor.select(name)).distinct())


def keyword_synonyms(packages: DataFrame, mentions: DataFrame, clues: tuple[str, ...], shared: DataFrame | None = None, shared_clues: tuple[str, ...] = (), disregard: tuple[str, ...] = T.DISREGARD + T.STOP_WORDS, package: str = "mapped_to", mention: str = "software_mention") -> DataFrame:
    """(package, mention): a mention that is a package belongs to itself; any other to the last of its cleaned tokens
    that is a package, if it has a clue token. For shared names only ``shared_clues`` count."""
    names = packages.select(F.col(package).alias("package")).filter("package is not null").distinct()
    said = mentions.select(F.col(mention).alias("mention")).filter("mention is not null").distinct()
    itself = said.join(names, said.mention == names.package, "left_semi").select(F.col("mention").alias("package"), "mention")
    split = said.join(names, said.mention == names.package, "left_anti").withColumn("tokens", T.tokens(F.col("mention")))
    words = F.array(*[F.lit(x) for x in clues]) if clues else F.array().cast("array<string>")
    strict = F.array(*[F.lit(x) for x in shared_clues]) if shared_clues else F.array().cast("array<string>")
    split = split.withColumn("clue", F.arrays_overlap("tokens", words)).withColumn("strict", F.arrays_overlap("tokens", strict)).filter("clue or strict")
    parts = split.select("mention", "clue", "strict", F.posexplode("tokens").alias("place", "token")).withColumn("token", T.clean_token(F.col("token")))
    hits = parts.filter(~F.col("token").isin(*disregard)).join(names, parts.token == names.package)
    last = hits.groupBy("mention", "clue", "strict").agg(F.max_by("package", "place").alias("package"))
    if shared is None:
        found = last.filter("clue")
    else:
        both = shared.select(F.col(shared.columns[0]).alias("package"), F.lit(True).alias("both")).distinct()
        found = last.join(both, "package", "left").filter(F.when(F.coalesce("both", F.lit(False)), F.col("strict")).otherwise(F.col("clue")))
    return itself.unionByName(found.select("package", "mention"))


def as_lists(pairs: DataFrame, key: str, value: str, conf: str | None = None) -> DataFrame:
    """One row a key with sorted synonyms and their confidences; for display."""
    item = F.struct(F.col(value).alias("synonym"), (F.col(conf) if conf else F.lit(None).cast("double")).alias("conf"))
    lists = pairs.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("l"))
    return lists.select(F.col(key), F.col("l.synonym").alias("synonyms"), F.col("l.conf").alias("synonyms_confs"))


def catalog_synonyms(resources: DataFrame, name: str = "software_mention", synonyms: str = "scicrunch_synonyms") -> DataFrame:
    """(mention, synonym) of a resource's list, and each resource with itself."""
    own = F.array_distinct(F.concat(F.coalesce(synonyms, F.array().cast("array<string>")), F.array(F.col(name))))
    return resources.filter(F.col(name).isNotNull()).select(F.col(name).alias("mention"), F.explode(own).alias("synonym")).distinct()


def page_synonyms(html: Column) -> Column:
    """Synonyms and abbreviations that a resource page lists, as an array."""
    part = lambda head: F.regexp_extract(html, rf"(?s)<h2[^>]*>{head}</h2>.*?<p[^>]*>([^<]*)</p>", 1)
    listed = lambda c: F.filter(F.split(c, ", "), lambda x: x != "")
    return F.concat(listed(part(r"Synonym\(s\)")), listed(part(r"Abbreviation\(s\)")))


def scored(pairs: DataFrame, source: str, conf: float = 1.0, own: str | None = None, least: int = 2) -> DataFrame:
    """(software_mention, synonym, synonym_conf, synonym_source) of mentions with at least ``least`` synonyms; ``own``
    names a column that has the confidences."""
    rows = pairs.select("software_mention", "synonym", (F.col(own) if own else F.lit(conf)).cast("double").alias("synonym_conf")).distinct()
    rich = rows.groupBy("software_mention").count().filter(F.col("count") >= least).select("software_mention")
    return rows.join(rich, "software_mention", "left_semi").withColumn("synonym_source", F.lit(source))


def combine(raw: DataFrame, ids: DataFrame, conf_threshold: float | None = None) -> DataFrame:
    """The cleaned edge list with its rule columns. Stop terms and self pairs go; package phrases need their least
    confidence; pairs that are equal without digits, punctuation or a copyright sign, or by case with two tokens or
    more, get confidence 1; pairs of two all-letter strings go unless equal without digits or punctuation."""
    m, s = F.col("software_mention"), F.col("synonym")
    rows = raw.select("software_mention", "synonym", "synonym_conf", "synonym_source").na.drop().distinct()
    rows = rows.filter(~m.isin(*T.STOP_TERMS) & ~s.isin(*T.STOP_TERMS) & (m != s))
    for prefix, least in T.PREFIX_LEAST:
        rows = rows.filter(~(s.startswith(prefix) & (F.col("synonym_conf") < least)))
    rows = rows.withColumns({
        "syn_substring_digits": T.without_digits(m) == T.without_digits(s), "syn_substring_punctuation": T.without_punctuation(m) == T.without_punctuation(s), "syn_substring_copyright": T.equal_without_copyright(m, s),
        "lowercase_equal": F.lower(m) == F.lower(s), "num_tokens": F.size(T.tokens(m)), "is_chars": T.all_letters(m), "is_chars_syn": T.all_letters(s), "is_substr": s.startswith(m),
    })
    sure = F.col("syn_substring_digits") | F.col("syn_substring_punctuation") | F.col("syn_substring_copyright") | (F.col("lowercase_equal") & (F.col("num_tokens") > 1))
    rows = rows.withColumn("synonym_conf", F.when(sure, 1.0).otherwise(F.col("synonym_conf")))
    rows = rows.filter(~(F.col("is_chars") & F.col("is_chars_syn") & ~F.col("syn_substring_digits") & ~F.col("syn_substring_punctuation")))
    if conf_threshold is not None:
        rows = rows.filter(F.col("synonym_conf") >= conf_threshold)
    named = ids.select("software", "ID")
    rows = rows.join(named.withColumnRenamed("software", "software_mention"), "software_mention", "left")
    return rows.join(named.select(F.col("software").alias("synonym"), F.col("ID").alias("synonym_ID")), "synonym", "left")
