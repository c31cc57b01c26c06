"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .caps import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("times")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtopk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is inserted under two tokenizer versions, the first with an estimate from n_chars; a second
    batch revises the estimates, a third deletes what is labelled toxic. Each batch is sent twice and counts once."""
    from .common import WORD, scratch, scratch_path
    from .rollup import Rollup

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    counted = docs.select("doc_id", "source", "lang", F.coalesce(F.floor(F.col("n_chars") / 6), F.lit(0)).alias("guess"), words.alias("words"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    counted = scratch(counted.join(toxic, "doc_id", "left"), "counted")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    one = lambda op, tokenizer, old, new: counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), old.alias("old_tokens"), new.alias("new_tokens"), "toxic")
    none = F.lit(None).cast("long")
    batches = {
        "1-insert": one("insert", "words-1", none, F.col("guess")).unionByName(one("insert", "chars-1", none, F.col("chars"))),
        "2-revise": one("revise", "words-1", F.col("guess"), F.col("words")),
        "3-delete": one("delete", "words-1", F.col("words"), none).unionByName(one("delete", "chars-1", F.col("chars"), none)).where("toxic"),
    }
    for name, changes in batches.items():
        rollup.apply(name, changes)
        rollup.apply(name, changes)
    rollup.compact()
    return rollup.totals()


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    d = dedup_lines(_table(spark, sf_dir, "documents"), report=True)
    return d.select("doc_id", F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"), F.col("_chunks").alias("removed_chunks"), F.col("_lines").alias("removed_lines"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 199)) AS s, x FROM d WHERE len(x) >= 400),
k AS (SELECT doc_id, s, md5(substring(x, 2 * s + 1, 400)) AS m FROM w),
r AS (SELECT doc_id, s FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
f AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000000) > 200 AS new FROM r),
g AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f),
p AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS z FROM g GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM p GROUP BY 1),
c AS (SELECT p.doc_id, a, substring(x, 2 * from_ + 1, 2 * (a - from_)) AS part
  FROM (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM p) p JOIN d ON d.doc_id = p.doc_id),
h AS (SELECT c.doc_id, string_agg(part, '' ORDER BY a) AS head FROM c GROUP BY 1)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
-- a source is full where filling all to its own level, min(cap, weight * cap_i / weight_i), takes no more than the budget
f AS (SELECT i.source, any_value(i.source_size) AS source_size, any_value(i.weight) AS weight, any_value(i.cap) AS cap,
    sum(least(j.cap * i.weight, j.weight * i.cap)) <= 1.5 * sum(j.source_size) * any_value(i.weight) AS is_full FROM w i, w j GROUP BY i.source),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * ((1.5 * sum(source_size) OVER () - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / sum(weight) FILTER (NOT is_full) OVER ()) END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (copies + CASE WHEN upto <= budget OR (upto - size <= budget AND 2 * (budget - (upto - size)) >= size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

_OP6 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words, coalesce(length(text), 0)::BIGINT AS chars FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
a AS (SELECT source, lang, 'words-1' AS tokenizer, words AS t FROM d UNION ALL SELECT source, lang, 'chars-1', chars FROM d)
SELECT source, lang, tokenizer, count(*)::BIGINT AS documents, sum(t)::BIGINT AS tokens FROM a GROUP BY 1, 2, 3
"""

_OP9 = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM a),
h AS (SELECT *, ('0x' || substring(md5(line), 1, 15))::BIGINT % 1000003 AS h FROM l),
r AS (SELECT *, (31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) % 1000003 + h % 1000003) % 1000003 AS r FROM h),
b AS (SELECT *, i > 0 AND coalesce(lag(r) OVER o > r AND r <= lead(r) OVER o, false) AS ends FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
c AS (SELECT *, part * 100000 + (i - min(i) OVER (PARTITION BY doc_id, part)) // 16 AS chunk FROM m),
g AS (SELECT doc_id, chunk, min(i) AS p, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY 1, 2),
f AS (SELECT *, n > 1 AND row_number() OVER w > 1 AS gone, first_value(doc_id) OVER w AS doc0, first_value(p) OVER w AS p0 FROM g WINDOW w AS (PARTITION BY body ORDER BY doc_id, p)),
e AS (SELECT *, CASE WHEN lag(gone) OVER o THEN 0 ELSE coalesce(lag(n) OVER o, 0) END AS most_b, CASE WHEN lead(gone) OVER o THEN 0 ELSE coalesce(lead(n) OVER o, 0) END AS most_a FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
u AS (SELECT doc_id, p, n, doc0, p0, unnest(range(1, most_b + 1)) AS k, p - k AS i, p0 - k AS i0, most_b AS most, -1 AS side FROM e WHERE gone
  UNION ALL SELECT doc_id, p, n, doc0, p0, unnest(range(1, most_a + 1)) AS k, p + n - 1 + k, p0 + n - 1 + k, most_a, 1 FROM e WHERE gone),
v AS (SELECT u.*, coalesce(min(CASE WHEN y.line = x.line THEN NULL ELSE k END) OVER (PARTITION BY u.doc_id, u.p, side), most + 1) AS stop FROM u JOIN l x ON x.doc_id = u.doc_id AND x.i = u.i LEFT JOIN l y ON y.doc_id = u.doc0 AND y.i = u.i0),
z AS (SELECT doc_id, i FROM v WHERE k < stop UNION SELECT c.doc_id, c.i FROM c JOIN f ON f.doc_id = c.doc_id AND f.chunk = c.chunk WHERE f.gone),
k AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (z.i IS NULL), '') AS kept, count(z.i) AS removed_lines, any_value(s.removed_chunks) AS removed_chunks
  FROM l LEFT JOIN z ON z.doc_id = l.doc_id AND z.i = l.i LEFT JOIN (SELECT doc_id, count(*) AS removed_chunks FROM f WHERE gone GROUP BY 1) s ON s.doc_id = l.doc_id GROUP BY 1)
SELECT d.doc_id, length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5, coalesce(removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(removed_lines, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": _OP2, "op4_suffix_array_dedup": _OP4, "op5_mixing": _OP5, "op6_exact_top_k": _OP6, "op7_token_counts": _OP7, "op9_line_dedup": _OP9}
