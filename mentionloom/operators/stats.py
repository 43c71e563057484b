"""Counts of distinct papers, top-k reports, year and field reports, co-occurrence, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions.text import any_keyword, id_number

NOT_DISAMBIGUATED = "not_disambiguated"


def frequency(df: DataFrame, key: str, counts: dict[str, str], as_name: str | None = None) -> DataFrame:
    """Distinct values of the named columns for each non-null key; only the asked columns are counted."""
    kept = df.filter(F.col(key).isNotNull())
    return kept.groupBy(F.col(key).alias(as_name or key)).agg(*[F.count_distinct(c).alias(n) for n, c in counts.items()])


def nunique(df: DataFrame, key: str, prefix: str = "num_") -> DataFrame:
    """Distinct values of every other column for each non-null key."""
    return frequency(df, key, {prefix + c: c for c in df.columns if c != key})


def top_k(df: DataFrame, by: str, name: str, k: int = -1) -> DataFrame:
    """The k rows with the largest value, ties by name; -1 keeps all."""
    ordered = df.orderBy(F.desc(by), name)
    return ordered if k < 0 else ordered.limit(k)


def bottom_k(df: DataFrame, by: str, name: str, k: int = 20) -> DataFrame:
    """The k rows with the smallest value, largest of them first."""
    return df.orderBy(F.asc(by), F.desc(name)).limit(k).orderBy(F.desc(by), name)


def entity(df: DataFrame, mapped: str = "mapped_to_software", mention: str = "software") -> DataFrame:
    """The entity of each row; where none has been found, the mention itself."""
    return df.withColumn(mapped, F.when(F.col(mapped) == NOT_DISAMBIGUATED, F.col(mention)).otherwise(F.col(mapped)))


def without(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column isn't the value; nulls stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def top_by(df: DataFrame, group: str, key: str, paper: str, k: int, value: str = "num_pmid") -> DataFrame:
    """The k keys with most distinct papers in each group, with their rank: one query for all groups."""
    counts = df.filter(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(group, key).agg(F.count_distinct(paper).alias(value))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), key))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Bytes of files that are read for one part of a join by paper.
PART_BYTES = 24 << 20


def by_paper(mentions: DataFrame, papers: DataFrame, paper: str) -> DataFrame:
    """Mentions with what is known of their papers. The join's parts, in which the distinct papers are then counted, grow in
    number with the tables and not in size: parts of a fixed number of bytes hold very many mentions, as these compress well."""
    leaves = [plan.apply(i).stats().sizeInBytes() for df in (mentions, papers) for plan in [df._jdf.queryExecution().optimizedPlan().collectLeaves()] for i in range(plan.size())]
    size = sum(int(str(x)) for x in leaves)
    if size >> 60:  # a table whose size isn't known counts as 2^63 bytes
        return mentions.join(papers, paper)
    n = max(mentions.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return mentions.repartition(n, paper).join(papers.repartition(n, paper), paper)


def field_top(df: DataFrame, text: str, keywords: list[str], key: str, paper: str, k: int) -> DataFrame:
    """Top keys among the rows whose text has a keyword."""
    return top_k(frequency(df.filter(any_keyword(F.col(text), keywords)), key, {"num_pmid": paper}), "num_pmid", key, k)


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def load_mentions(df: DataFrame, freq_threshold: int = 1, top: int = -1, id_start: int | None = None, id_end: int | None = None, seen: DataFrame | None = None, mention: str = "software", pmcid: str = "pmcid", pmid: str = "pmid", doi: str = "doi", id_: str = "ID") -> DataFrame:
    """Mentions with their numbers of papers, most pmids first, of at least ``freq_threshold`` pmcids; ids that ``seen`` has
    or that are outside [id_start, id_end) are left out, the range only if both ends are given."""
    if seen is not None:
        df = df.join(seen.select(id_).distinct(), id_, "left_anti")
    if id_start is not None and id_end is not None:
        df = df.filter((id_number(F.col(id_)) >= id_start) & (id_number(F.col(id_)) < id_end))
    counts = frequency(df, mention, {"num_pmids": pmid, "num_pmcids": pmcid, "num_dois": doi})
    return top_k(counts.filter(F.col("num_pmcids") >= freq_threshold), "num_pmids", mention, top)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows at random, or all if there are fewer."""
    return df.orderBy(F.rand(seed)).limit(n)


def multi_mention_sentences(df: DataFrame, sentence: list[str], mention: str) -> DataFrame:
    """Sentences with more than one mention, and the sorted list of them; sentences with a null key are left out."""
    kept = df.na.drop(subset=[*sentence, mention])
    return kept.groupBy(*sentence).agg(F.array_sort(F.collect_list(mention)).alias("mentions")).filter(F.size("mentions") > 1)


def cooccurrence(df: DataFrame, sentence: list[str], mention: str) -> DataFrame:
    """Unordered pairs of different mentions of a sentence: ordered index pairs, so 2 * count_a * count_b a sentence."""
    counts = df.na.drop(subset=[*sentence, mention]).groupBy(*sentence, mention).agg(F.count("*").alias("n"))
    # a sentence's pairs come from its own short list, so there's no join of sentences
    lists = counts.groupBy(*sentence).agg(F.array_sort(F.collect_list(F.struct(F.col(mention).alias("m"), "n"))).alias("l")).filter(F.size("l") > 1)
    a = lists.select("l", F.posexplode("l").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    return pairs.groupBy(F.col("a.m").alias("mention_a"), F.col("b.m").alias("mention_b")).agg(F.sum(2 * F.col("a.n") * F.col("b.n")).alias("pairs"))


def profile(mentions: DataFrame, clusters: DataFrame, name: Column | str, mention: str = "software", paper: str = "pmid") -> DataFrame:
    """All spellings of the entity that a mention belongs to, with their distinct papers."""
    name = F.lit(name) if isinstance(name, str) else name
    own = clusters.filter(F.col(mention) == name).select("cluster")
    members = clusters.join(own, "cluster", "left_semi")
    return mentions.join(members, mention).groupBy("cluster", mention).agg(F.count_distinct(paper).alias("num_papers"))
