"""One query per operator over its whole table, and check SQL where SQL can say the same."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirwise.llm import bpe, curves, fingerprints, licenses, lines, negatives, packing, pii, prefix_trie, quality, sentences, simhash, warc
from dirwise.llm.common import reachable, read_table
from dirwise.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def query(sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


@query()
def op1_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprints.compared(read_table(spark, sf_dir, "documents"))
    near = lambda f, b: f(F.col("sketch"), F.col(b))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near(fingerprints.containment, "edited_sketch").alias("near_edited"), near(fingerprints.containment, "next_sketch").alias("near_next"),
    )


@query(r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM p JOIN g USING (payload_digest)""")
def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(warc.chunk_table(read_table(spark, sf_dir, "pages")), path, compression="gzip")
    back = warc.records(warc.read(spark, path))
    return back.select(F.substring_index("record", "/", -1).cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


@query()
def op3_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query()
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query(r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, line, pos, first_id IS NOT NULL AND first_id <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op6_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    field = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), field).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query()
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


@query()
def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query()
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query()
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentences.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    spanned = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda n, x: n + x)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), spanned.alias("spanned_bytes"),
    )


@query(r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4 AS h
  FROM own),
f AS (SELECT c.*, least(h, coalesce(own.n, 0)) AS given FROM c LEFT JOIN own ON own.conv_id = c.base),
r AS (
  SELECT f.conv_id, t.pos, role, text FROM f JOIN t ON t.conv_id = f.base AND t.pos <= f.h
  UNION ALL SELECT f.conv_id, t.pos - f.h + f.given, role, text FROM f JOIN t ON t.conv_id = f.conv_id AND t.pos > f.h),
p AS (
  SELECT f.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path,
         coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS words
  FROM f LEFT JOIN r ON r.conv_id = f.conv_id GROUP BY f.conv_id),
m AS (SELECT conv_id, path[1:d] AS node, d AS depth, words[d] AS words, len(path) = d AS stops FROM p, unnest(range(0, len(path) + 1)) AS u(d)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE stops), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
k AS (SELECT n.node, u.conv_id AS parent_conv_id FROM n JOIN n u ON u.depth = n.depth - 1 AND u.node = n.node[1:n.depth - 1]),
kids AS (SELECT n.node[1:n.depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.node = n.node),
s AS (
  SELECT a.node, sum((b.n_children = 0)::BIGINT) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM a JOIN a b ON b.depth >= a.depth AND b.node[1:a.depth] = a.node GROUP BY a.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM a JOIN s ON s.node = a.node LEFT JOIN k ON k.node = a.node AND a.depth > 0""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = prefix_trie.rebuilt(prefix_trie.turns(read_table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(rows, convs).drop("node")


@query(r"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label = c.label AS same, c.id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON c.id <> a.id WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(rows, F.col("id") % 100 == 0)
