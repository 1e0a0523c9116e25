"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import bpe, decontaminate, lattice, licenses, minhash, packed_ids, pii, quality, substring, url_filter


#: A key that everyone knows, for results that can be compared; whoever publishes a corpus passes a secret one.
PUBLIC_KEY = "known to everyone"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(quality.sample(documents, table(spark, sf_dir, "labels")))
    return quality.classify(documents, model)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode_column(spark, path, pattern).alias("ids"))
    whole = ids.select("doc_id", "ids", bpe.decode_column(spark, path, pattern).alias("decoded"))
    return whole.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymise(table(spark, sf_dir, "documents"), PUBLIC_KEY)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id WHERE r.c < g.b)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
g(k, pattern, h, p) AS (VALUES (1, '*casino*/*', '%casino%', '%'), (2, '*free-bets*/*', '%free-bets%', '%'), (3, '*poker*/*', '%poker%', '%'), (4, '*xxx*/*', '%xxx%', '%'), (5, '*porn*/*', '%porn%', '%'),
  (6, '*malware*/*', '%malware%', '%'), (7, '*phish*/*', '%phish%', '%'), (8, '*cheap-pills*/*', '%cheap-pills%', '%'), (9, '*torrent*/*', '%torrent%', '%'), (10, '*/*/phishing/*', '%', '%/phishing/%'), (11, '*/*.exe', '%', '%.exe')),
x AS (SELECT u.*, (SELECT arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r WHERE ends_with('.' || u.host, '.' || r.h) AND starts_with(u.path, r.p)) AS best,
    (SELECT arg_min(g.pattern, g.k) FROM g WHERE u.host LIKE g.h AND u.path LIKE g.p) AS gl FROM u)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best.rule IS NOT NULL THEN best.verdict WHEN gl IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN best.rule IS NULL THEN gl END AS pattern FROM x
"""


def _op6_sql() -> str:
    templates = ", ".join(f"({t}, '{label}', '{words}', '{key}', {len(words[: words.index(key)].split())})" for t, (label, words, key) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES)
    stop = ", ".join(f"'{w}'" for w in sorted(licenses.STOP))
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
t(t, label, words, key, place) AS (VALUES {templates}),
tw AS (SELECT t, unnest(string_split(words, ' ')) AS x, unnest(range(len(string_split(words, ' ')))) AS p, len(string_split(words, ' ')) AS n FROM t),
post AS (SELECT t, x, p FROM tw WHERE x NOT IN ({stop})),
ph(phrase, label) AS (VALUES {phrases}),
occ AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
base AS (SELECT w.doc_id, o.i, ph.label FROM occ o JOIN w USING (doc_id) JOIN ph ON o.x = string_split(ph.phrase, ' ')[1]
  WHERE ws[o.i + 1 : o.i + len(string_split(ph.phrase, ' '))] = string_split(ph.phrase, ' ')),
df AS (SELECT x, count(DISTINCT doc_id) AS n FROM occ WHERE x IN (SELECT x FROM post) GROUP BY x),
prop AS (SELECT o.doc_id, p.t, o.i - p.p AS s, df.n, min(df.n) OVER (PARTITION BY o.doc_id, p.t) AS least FROM occ o JOIN post p ON p.x = o.x JOIN df ON df.x = o.x),
starts AS (SELECT DISTINCT doc_id, t, s FROM prop WHERE n = least),
proved AS (SELECT st.doc_id, st.t, st.s FROM starts st JOIN t USING (t) JOIN w USING (doc_id)
  WHERE st.s + place >= 0 AND ws[st.s + place + 1 : st.s + place + len(string_split(key, ' '))] = string_split(key, ' ')),
cover AS (SELECT pr.doc_id, pr.t, pr.s, count(*) FILTER (WHERE o.x = tw.x) / any_value(tw.n) AS c FROM proved pr JOIN tw ON tw.t = pr.t LEFT JOIN occ o ON o.doc_id = pr.doc_id AND o.i = pr.s + tw.p GROUP BY ALL),
good AS (SELECT doc_id, t.label, max(c) AS c FROM cover JOIN t USING (t) GROUP BY doc_id, t.label HAVING max(c) >= 0.8),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS ls FROM base GROUP BY doc_id),
g AS (SELECT doc_id, list(label) AS ls, max(c) AS c FROM good GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.ls, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(g.ls, [])))), ','), '') AS labels,
  greatest(coalesce(g.c, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)
"""


OP6_SQL = _op6_sql()


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id WHERE r.c < p.b)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m USING (vec_id) LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op4_url_filters": OP4_SQL, "op6_license_scans": OP6_SQL, "op7_embedding_near_dedup": OP7_SQL}
