"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import caps, completion, fingerprints, forest, manifest, mixing, packing, repair, repeats, sstable, toxicity, unigram, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encode_and_read(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_table(spark, sf_dir, "documents"), text_back=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_documents(_table(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completion.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows; where 7 divides the CRC-32 of doc_id's digits, the row that is checked has n_chars one too high."""
    docs = _table(spark, sf_dir, "documents")
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + more}
    tampered = manifest.leaf_hash([changed.get(c, F.col(c)) for c in manifest.FIELDS])
    out = manifest.manifest(docs, carried={"tampered": tampered})
    out = out.withColumn("folded_root", manifest.folded(F.col("tampered"), F.col("path")))
    proof = F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_fingerprints, op3_url_filter, op4_mixing, op5_token_counts,
        op6_token_output, op7_repeats, op8_toxicity, op9_near_documents, op10_near_vectors,
        op11_repair, op12_best_fit, op13_manifest,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (
  SELECT p.*, (SELECT arg_max(struct_pack(rule := h || pre, verdict := verdict), length(h || pre)) FROM r
               WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
"""

ORACLES["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents),
d2 AS (SELECT doc_id, source, size, ('0x' || substr(h, 1, 7))::BIGINT AS h1, ('0x' || substr(h, 8, 7))::BIGINT * 2 + 1 AS h2 FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d2 GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, list_extract(list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE), ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT) AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
q AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM r),
tried AS (
  SELECT q.source, seed, abs(any_value(whole) * any_value(q.source_size)
           + sum(CASE WHEN ((h1 + seed * h2) % 268435456) / 268435456.0::DOUBLE < part THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM d2 JOIN q ON d2.source IS NOT DISTINCT FROM q.source, range(32) AS x(seed)
  GROUP BY q.source, seed),
best AS (SELECT source, arg_min(seed, (miss, seed)) AS seed FROM tried GROUP BY source)
SELECT doc_id, size, q.source_size, target,
       (size * (whole + CASE WHEN ((h1 + seed * h2) % 268435456) / 268435456.0::DOUBLE < part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d2 JOIN q ON d2.source IS NOT DISTINCT FROM q.source JOIN best ON best.source IS NOT DISTINCT FROM q.source
"""

ORACLES["op10_near_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS e, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s
  FROM embeddings),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
  WHERE a.s > 0 AND b.s > 0 AND list_inner_product(a.e, b.e) / (sqrt(a.s) * sqrt(b.s)) >= 0.98),
reach AS (
  SELECT x, y FROM link
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.y, vec_id)) AS component_id, vec_id <= coalesce(least.y, vec_id) AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN least ON least.x = vec_id
"""

ORACLES["op9_near_documents"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x1C-\x20]+') AS w FROM documents),
s AS (
  SELECT n, list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g
  FROM d WHERE len(w) > 0),
x AS (SELECT n, len(g) AS size, unnest(g) AS g FROM s),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS shared, any_value(a.size) + any_value(b.size) AS total FROM x a JOIN x b ON a.g = b.g AND a.n <> b.n GROUP BY ALL),
link AS (
  SELECT a, b FROM p WHERE shared * 5 >= (total - shared) * 4
  UNION
  SELECT a.n, b.n FROM d a JOIN d b ON a.text = b.text AND a.n <> b.n),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(d.doc_id) AS low FROM reach JOIN d ON d.n = b GROUP BY a),
c AS (SELECT a, count(*) AS n FROM link GROUP BY a),
o AS (SELECT text, min(doc_id) AS copy_of FROM d GROUP BY text)
SELECT d.doc_id, o.copy_of, coalesce(c.n, 0)::BIGINT AS n_links, least(d.doc_id, coalesce(least.low, d.doc_id)) AS class_id,
       d.doc_id <= coalesce(least.low, d.doc_id) AS kept
FROM d JOIN o ON o.text = d.text LEFT JOIN c ON c.a = d.n LEFT JOIN least ON least.a = d.n
"""
