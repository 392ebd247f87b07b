"""The operators over their whole tables: one named query each, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (decontam, embed_lsh, fim, hmm_lm, license_scan, line_dedup, mixing, ngram_join, nn_descent, pii,
                        quality_dsir, target_resample, toxicity)
from quarry.llm.common import id_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(_table(spark, sf_dir, "documents")))


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(id_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    ratio = quality_dsir.fit_log_ratio(docs, labels)
    return quality_dsir.resample(quality_dsir.log_weights(docs, ratio), share or 0.0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_passages(docs)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return target_resample.resample_to_target(docs, target).drop("n_words")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
          ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
comp AS (SELECT id, MIN(c) AS c FROM reach GROUP BY id),
n AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, COALESCE(n.n, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

OP9_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, text, i, l[i + 1] AS a, l[i + 2] AS b, l[i + 3] AS c
      FROM (SELECT doc_id, text, l, UNNEST(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
u AS (SELECT * FROM w WHERE length(a) + length(b) + length(c) >= 40),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM u),
gone AS (SELECT DISTINCT doc_id, text, i + o AS i FROM r, (SELECT UNNEST([0, 1, 2]) AS o) WHERE k > 1),
g AS (SELECT doc_id, text, COUNT(*) AS n, list(i) AS xs FROM gone GROUP BY 1, 2)
SELECT documents.doc_id,
       CASE WHEN g.n IS NULL THEN documents.text ELSE array_to_string(list_filter(
         string_split(documents.text, chr(10)), lambda x, p: NOT list_contains(g.xs, p - 1)), chr(10)) END AS text,
       CASE WHEN documents.text IS NULL THEN 0 ELSE len(string_split(documents.text, chr(10))) END AS n_lines,
       COALESCE(g.n, 0) AS n_removed
FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id AND g.text = documents.text"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
_SEED_UNION = " UNION ".join(
    f"SELECT x.doc_id, y.item_id, x.p - y.q AS s FROM dw x JOIN tw y ON " +
    " AND ".join(f"x.w[x.p + {k + 1}] = y.w[y.q + {k + 1}]" for k in m) + f" AND least(len(y.w), 8) = {kind}"
    for kind, masks in decontam.MASKS.items() for m in masks)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, w, UNNEST(range(0, len(w))) AS p FROM d WHERE len(w) > 0),
tw AS (SELECT item_id, w, UNNEST(range(0, len(w))) AS q FROM t WHERE len(w) > 0),
h AS ({_SEED_UNION}),
v AS (SELECT h.doc_id, h.item_id, least(16, len(t.w)) AS n,
             [CASE WHEN t.w[i + 1] = d.w[i + s + 1] THEN 1 ELSE 0 END
              for i in range(greatest(0, -s), least(len(t.w), len(d.w) - s))] AS e
      FROM h JOIN d ON d.doc_id = h.doc_id JOIN t ON t.item_id = h.item_id),
f AS (SELECT doc_id, item_id, list_max([list_sum(e[i + 1:i + n]) / n for i in range(0, len(e) - n + 1)]) AS agree
      FROM v WHERE len(e) >= n),
g AS (SELECT doc_id, item_id, MAX(agree) AS agree FROM f WHERE agree >= 0.8 GROUP BY 1, 2),
k AS (SELECT doc_id, COUNT(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids, MAX(agree) AS best
      FROM g GROUP BY 1)
SELECT documents.doc_id, k.n IS NOT NULL AS contaminated, COALESCE(k.n, 0) AS n_items,
       COALESCE(k.ids, '') AS item_ids, COALESCE(k.best, 0.0) AS best
FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
             [CAST('0x' || substr(h, 8 * i + 1, 8) AS UBIGINT) for i in range(4)] AS r FROM d),
v AS (SELECT *, len(l) AS n, least(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) AS a, greatest(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
                  WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, COALESCE(array_to_string(l[1:a], ''), '') AS p, COALESCE(array_to_string(l[a + 1:b], ''), '') AS m,
             COALESCE(array_to_string(l[b + 1:], ''), '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM w"""

# all pairs: what the search returns where it misses none, as it does on the tables of sf0.001 to sf0.1
OP12_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, [q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]), lambda x, y: x + y) AS score
      FROM g q JOIN g c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

# CRC-32 by its defining steps, bytes from the hexadecimal form of the UTF-8 text
OP13_SQL = r"""
WITH steps AS (SELECT list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                                  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v, b
               FROM (SELECT UNNEST(range(256)) AS b)),
tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM steps),
src AS (SELECT 'd' AS k, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
words AS (SELECT k, doc_id, row_number() OVER () AS rid, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM src),
runs AS (SELECT k, rid, array_to_string(w[i:i + n - 1], ' ') AS f
         FROM (SELECT k, rid, w, n, UNNEST(range(1, len(w) - n + 2)) AS i FROM words, (SELECT UNNEST([1, 2, 3]) AS n))),
per AS (SELECT k, rid, f, COUNT(*) AS c FROM runs GROUP BY ALL),
feats AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per)),
crc AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) for i in range(len(h) // 2)]),
                                  lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM feats, tab),
tot AS (SELECT bucket, SUM(c) FILTER (k = 'd') AS s, SUM(c) FILTER (k = 'b') AS t FROM per JOIN crc USING (f) GROUP BY 1),
sums AS (SELECT SUM(COALESCE(s, 0)) AS s_all, SUM(COALESCE(t, 0)) AS t_all FROM tot),
gain AS (SELECT bucket, CAST(floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((COALESCE(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g FROM tot, sums),
wt AS (SELECT rid, CAST(SUM(c) AS BIGINT) AS n_features, CAST(SUM(c * g) AS BIGINT) AS weight FROM per JOIN crc USING (f) JOIN gain USING (bucket) WHERE k = 'd' GROUP BY 1),
sc AS (SELECT doc_id, len(w) AS n_words, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight,
              COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
       FROM words LEFT JOIN wt USING (rid) WHERE k = 'd'),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
             COUNT(*) FILTER (n_words >= 20) OVER () AS able FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM r"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_license_scan, op3_hmm_lm, op4_embedding_dedup, op5_ngram_jaccard,
                            op6_mix_sources, op7_toxicity, op8_quality, op9_line_dedup, op9_passage_dedup,
                            op10_decontaminate, op11_fill_in_middle, op12_nn_descent, op13_target_resample)}
SQL: dict[str, str] = {"op4_embedding_dedup": OP4_SQL, "op9_line_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL,
                       "op11_fill_in_middle": OP11_SQL, "op12_nn_descent": OP12_SQL, "op13_target_resample": OP13_SQL}
