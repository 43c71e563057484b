"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mentionloom.llm.embeddings import op6_embedding_near_dedup
from mentionloom.llm.langid import op4_language_id
from mentionloom.llm.lm import op8_lm_scoring
from mentionloom.llm.mixing import op7_source_mixing
from mentionloom.llm.packing import op5_best_fit_packing
from mentionloom.llm.pii import op3_pii
from mentionloom.llm.quality import op2_quality_rules
from mentionloom.llm.sharding import op1_sharding
from mentionloom.llm.shingles import op10_ngram_jaccard_join
from mentionloom.llm.tokenfiles import op9_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality_rules": op2_quality_rules,
        "op3_pii": op3_pii,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_source_mixing": op7_source_mixing,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_token_files": op9_token_files,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


#: The mix: sizes, targets from the first source that isn't capped, the schedule, and what it takes of each document.
MIX_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h, text FROM documents),
s0 AS (SELECT src, no_src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY no_src, src) - 1 AS place FROM d GROUP BY src, no_src),
s1 AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, source_size * 2 AS cap, CAST((SELECT sum(source_size) FROM s0) AS DOUBLE) * 1.5 AS goal FROM s0),
level AS (SELECT l FROM (SELECT a.place, (a.goal - coalesce((SELECT sum(b.cap) FROM s1 b WHERE (b.cap / b.weight, b.place) < (a.cap / a.weight, a.place)), 0))
        / ((SELECT sum(weight) FROM s1) - coalesce((SELECT sum(b.weight) FROM s1 b WHERE (b.cap / b.weight, b.place) < (a.cap / a.weight, a.place)), 0)) AS l, a.cap / a.weight AS need, a.weight, a.cap FROM s1 a) WHERE l * weight < cap ORDER BY need, place LIMIT 1),
t AS (SELECT s1.*, CASE WHEN cap <= weight * (SELECT l FROM level) OR (SELECT count(*) FROM level) = 0 THEN CAST(cap AS DOUBLE) ELSE (SELECT l FROM level) * weight END AS target,
    CAST(greatest(64, least(65536, floor((SELECT sum(source_size) FROM s0) / 20000))) AS BIGINT) AS width FROM s1),
n AS (SELECT *, CAST(ceil(source_size / width) AS BIGINT) AS n_blocks, CASE WHEN source_size > 0 THEN target / source_size * ceil(source_size / width) ELSE 0 END AS share FROM t),
u AS (SELECT *, sum(share) OVER () AS slots, sum(share) OVER (ORDER BY place) AS high, max(CASE WHEN share > 0 THEN place END) OVER () AS last FROM n),
v AS (SELECT *, CASE WHEN place = last THEN 4294967296 ELSE CAST(least(4294967296, greatest(0, round(high / slots * 4294967296))) AS BIGINT) END AS upto FROM u),
w AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY place), 0) AS since FROM v),
p AS (SELECT slot, CAST(slot::HUGEINT * 2654435769 % 4294967296 AS BIGINT) AS x FROM (SELECT unnest(range(CAST(floor((SELECT max(slots) FROM u)) AS BIGINT))) AS slot)),
k AS (SELECT place, n_blocks, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM p JOIN w ON x >= since AND x < upto),
takes AS (SELECT place, rank % n_blocks AS block, count(*) AS takes FROM k WHERE rank < 2 * n_blocks GROUP BY 1, 2),
laid AS (SELECT doc_id, size, source_size, target, place, width, coalesce(sum(size) OVER (PARTITION BY place ORDER BY h, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d JOIN n USING (src, no_src)),
pieces AS (SELECT *, unnest(range(CAST(pos // width AS BIGINT), CAST((pos + greatest(size, 1) - 1) // width + 1 AS BIGINT))) AS block FROM laid)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum((least(pos + size, (block + 1) * width) - greatest(pos, block * width)) * takes) FILTER (size > 0), 0) AS BIGINT) AS taken
FROM pieces LEFT JOIN takes USING (place, block) GROUP BY doc_id, size, source_size, target, place, pos"""


#: Cosines of all pairs of one label, and what links reach.
COSINE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM m LEFT JOIN n USING (vec_id)"""

#: Shingles as strings, their intersections by a join on them, and what links reach.
JACCARD_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM m LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_near_dedup": COSINE_SQL, "op7_source_mixing": MIX_SQL, "op10_ngram_jaccard_join": JACCARD_SQL}
