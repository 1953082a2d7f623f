"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear, decontam, divergence, embed, langid, licenses, mixing, pii, prefixes, sharding, simhash, suffix, warc
from .scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"), words=3, radius=2, seed=42)


def op3_bucket_pointer_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op4_transaction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least=0)
    return warc.digest_captures(warc.assemble(warc.read_records(spark, path, payloads=False)))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    profiles = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.cluster(table(spark, sf_dir, "embeddings"), least=0.93)


def op9_dice_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that leaks into it."""
    return decontam.leaked_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, best=10)


def op12_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.rebuilt(prefixes.turns(table(spark, sf_dir, "conversations"))))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), q AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS head,
         [('0x' || substr(hex, 10 * g + 1, 10))::BIGINT for g in range(4)] AS parts
  FROM q
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head = page_id THEN NULL ELSE head END AS refers_to
FROM r
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[(row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER w AS pos,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST)
), l AS (
  SELECT arg_min(lvl, pos) AS lvl FROM o WHERE lvl * weight <= 2 * source_size
), t AS (
  SELECT o.source, source_size, CASE WHEN l.lvl IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, l.lvl * weight) END AS target FROM o, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN part > 0 AND before + size / 2.0 <= part THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""


# every pair is compared: the graphs find all links of tables of this size
OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93::DOUBLE
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT r.node, l.w FROM reach r JOIN links l ON l.u = r.root
), c AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = vec_id
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS total FROM d GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY lang, source, term
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang
), g AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(s.size, 0) AS size, coalesce(l.v, 0) AS v, coalesce(l.size, 0) AS lang_size
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) g
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source) s USING (lang, source) LEFT JOIN l USING (lang)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ((1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.size + 2 * g.v)) AS p, 1 + ((1000000000::HUGEINT * (k.total + 2)) // (g.lang_size + 2 * g.v)) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""


# the checksum is computed bit by bit; sequences of turns are compared by the digest of their JSON
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM t
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS MATERIALIZED (
  SELECT conv_id, d, md5(to_json(turns[1:d])::VARCHAR) AS id, CASE WHEN d > 0 THEN md5(to_json(turns[1:d - 1])::VARCHAR) END AS up,
         CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS size, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS MATERIALIZED (
  SELECT id, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY id
), k AS (
  SELECT up AS id, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up
), m AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (id)
), s AS (
  SELECT a.id, sum((m.n_children = 0)::INTEGER) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved_tokens
  FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.depth GROUP BY a.id
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (id) LEFT JOIN n u ON u.id = m.up
"""


def queries() -> dict:
    found = (
        op1_vector_bin_packing, op2_simhash_vp_tree, op3_bucket_pointer_refinement, op4_transaction_assembly, op5_water_filling,
        op6_rank_order_profiles, op7_anchor_expansion, op8_hnsw_shards, op9_dice_bigrams, op10_spaced_seeds,
        op11_source_divergence, op12_log_bilinear, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_transaction_assembly": OP4_SQL, "op5_water_filling": OP5_SQL, "op8_hnsw_shards": OP8_SQL, "op11_source_divergence": OP11_SQL, "op13_prefix_trie": OP13_SQL}
