"""The queries of this subpackage: each operator over its whole table, with the parameters of production."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm._shared import shared_folder
from rowforge.llm import bpe, embedding_dedup, exact_dedup, hard_negatives, langid, mixing, near_dedup, pii, quality, resharding, spelling, url_filter, warc

#: Vocabulary of the BPE query.
TOKENIZER = "byte_bpe_50k.json"
#: Host, path and verdict of the rules of the URL query, fixed by its contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder, payloads=False).drop("payload")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_read(spark, sf_dir, "documents")))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return resharding.digest(resharding.reshard(_read(spark, sf_dir, "documents"), folder, shards=24))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, threshold=0.8)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_warc, op2_exact_dedup, op3_bpe, op4_pii, op5_resharding, op6_near_dedup, op7_langid, op8_mixing, op9_embedding_dedup, op10_quality, op11_url_filter, op12_hard_negatives, op13_spelling]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE_SQL = {
    "op1_warc": f"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda g:
         array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('{_BASE32}', CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to,
       array_to_string(list_filter(regexp_split_to_array(coalesce(url, ''), '\\s+'), lambda x: x <> ''), ' ') AS target_uri
FROM p
""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op6_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS r FROM s
  UNION
  SELECT pairs.b, reach.r FROM reach JOIN pairs ON pairs.a = reach.node),
c AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.node
""",
    "op8_mixing": """
WITH RECURSIVE r AS (
  SELECT source, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * CAST(count(*) AS DOUBLE)) AS rate FROM documents GROUP BY source),
shares AS (
  SELECT source, CASE WHEN rate > 700 THEN CAST(ceil(rate / 700) AS BIGINT) ELSE 1 END AS parts,
         CASE WHEN rate > 700 THEN rate / ceil(rate / 700) ELSE rate END AS share FROM r),
cdf AS (
  SELECT source, share, 0 AS k, exp(-share) AS p, exp(-share) AS c FROM shares
  UNION ALL
  SELECT source, share, k + 1, p * share / (k + 1), c + p * share / (k + 1) FROM cdf WHERE k < ceil(share + 12 * sqrt(share) + 40)),
keyed AS (
  SELECT documents.*, parts, unnest(range(1, parts + 1)) AS part FROM documents JOIN shares ON documents.source IS NOT DISTINCT FROM shares.source),
u AS (
  SELECT *, CAST(CAST('0x' || substr(md5(CASE WHEN parts = 1 THEN 'copies:17:' ELSE 'copies-part:17:' || part || ':' END || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM keyed),
n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n_copies
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND u.u >= cdf.c
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, unnest(range(0, n_copies)) AS replica FROM n
""",
    "op11_url_filter": r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
m AS (
  SELECT p.r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(rules.verdict, length(rules.host || rules.path)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  GROUP BY p.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.r = m.r
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e, len(embedding) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.dim = b.dim),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
""",
    "op13_spelling": r"""
WITH RECURSIVE steps AS (
  SELECT k, 0 AS turn, k AS c FROM range(0, 256) t(k)
  UNION ALL
  SELECT k, turn + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE turn < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM steps WHERE turn = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
             lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h
  FROM d, crc),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b, b.n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.rest = v.word
  UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.rest = v.word),
best AS (
  SELECT a, count(*) AS n_near, min(b) FILTER (WHERE n = m) AS b, any_value(m) AS m FROM (SELECT *, max(n) OVER (PARTITION BY a) AS m FROM near) GROUP BY a),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN b END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON v.word = best.a),
up AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL
  SELECT up.word, f.word, f.form FROM up JOIN f ON up.next = f.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN up ON f.word = up.word AND up.next IS NULL
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS r FROM embeddings
  UNION
  SELECT pairs.b, reach.r FROM reach JOIN pairs ON pairs.a = reach.node),
c AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT c.node AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.node = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.node
""",
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
