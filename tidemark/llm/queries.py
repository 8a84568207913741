"""One query per numbered operator, with production parameters, over its whole
table; and the DuckDB SQL of those that SQL can express.

A query takes (spark, sf_dir) and derives the digest columns from what the
operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    arrow_tokens,
    chat,
    fim,
    langid,
    mix,
    pack,
    shard,
    simhash,
    syncmers,
    token_counts,
    topk,
    toxicity,
    vector_codes,
)
from tidemark.llm.common import documents, pick, run_folder, text_bytes


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0).drop("query_row")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard.shuffle_into_shards(documents(spark, sf_dir), shards=8)
    return rows.select(
        "doc_id",
        (text_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(shard.LAW).alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken_words(mix.plan_mix(documents(spark, sf_dir)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack.sequence_pieces(pack.pack_documents(documents(spark, sf_dir), path, end_id=1, length=2048))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.count_tokens(documents(spark, sf_dir), path, run_folder(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(documents(spark, sf_dir), labels)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "arrow-tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = arrow_tokens.write_sequences(documents(spark, sf_dir), folder, path, end_id=0, length=2048)
    return arrow_tokens.read_documents(shards, folder)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=2)
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return rows.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = vector_codes.with_label_errors(found.rows)
    digest = F.lit(vector_codes.books_digest(found.books)).alias("codebooks_sha256")
    return rows.select("vec_id", "code", "error", "label_error", digest)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, i, role, HARD_TEXT) for i, role in enumerate(("user", "assistant"))], given.schema)
    back = chat.read_back(chat.format_conversations(given.unionByName(hard)))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Fixed value: what both turns of the added conversation say.
HARD_TEXT = "</s>[INST] ok [/INST]"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_sharding": op2_sharding,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_language": op7_language,
        "op8_arrow_tokens": op8_arrow_tokens,
        "op9_simhash": op9_simhash,
        "op10_fingerprints": op10_fingerprints,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_vector_codes": op12_vector_codes,
        "op13_chat_format": op13_chat_format,
    }


OP1_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

OP3_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || chr(10) || COALESCE("text", '')
              || CASE copy WHEN 0 THEN '' ELSE chr(10) || copy END), 1, 15) AS BIGINT) AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "text", source) - 1 AS copy FROM documents)
),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
),
levels(i, water, capped) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT i + 1,
         (1.5::DOUBLE * sum(n)::DOUBLE - sum(CASE WHEN n * 2.0::DOUBLE < weight * water THEN n * 2.0::DOUBLE ELSE 0 END))
           / sum(CASE WHEN n * 2.0::DOUBLE < weight * water THEN 0 ELSE weight END)::DOUBLE,
         CAST(count_if(n * 2.0::DOUBLE < weight * water) AS BIGINT)
  FROM levels, weighed GROUP BY i, water, capped
  HAVING count_if(n * 2.0::DOUBLE < weight * water) <> capped
     AND sum(CASE WHEN n * 2.0::DOUBLE < weight * water THEN 0 ELSE weight END) > 0
),
targets AS (
  SELECT source, n, CASE WHEN n * 2.0::DOUBLE < weight * water THEN n * 2.0::DOUBLE ELSE weight * water END AS target
  FROM weighed, (SELECT water FROM levels ORDER BY i DESC LIMIT 1)
),
split AS (
  SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS repeats FROM targets
),
running AS (
  SELECT source, h, sum(size) AS g, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS so_far
  FROM sized WHERE size > 0 GROUP BY source, h
)
SELECT d.doc_id, d.size, s.n AS source_size, s.target,
       CAST(d.size * (s.repeats + CASE WHEN r.g <= 2 * (s.target - s.repeats * s.n - r.so_far) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
LEFT JOIN running r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, COALESCE("text", '') AS t, regexp_extract_all(COALESCE("text", ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
),
parted AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parted
"""

OP12_SQL = """
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, range(16) AS s(p)
),
books(step, p, e, x) AS (
  SELECT 0, p, r - 1, x FROM parts WHERE r <= 64
  UNION ALL
  (
    WITH near AS (
      SELECT q.p, q.r, q.x, arg_min(b.e, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))) * 64 + b.e) AS e
      FROM parts q JOIN books b ON q.p = b.p GROUP BY q.p, q.r, q.x
    ),
    means AS (
      SELECT p, e, list(CAST(floor(total / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY i) AS x
      FROM (SELECT p, e, i, sum(near.x[i]) AS total, count(*) AS n FROM near, range(1, len(near.x) + 1) AS s(i) GROUP BY p, e, i) GROUP BY p, e
    )
    SELECT b.step + 1, b.p, b.e, COALESCE(m.x, b.x) FROM books b LEFT JOIN means m ON b.p = m.p AND b.e = m.e WHERE b.step < 2
  )
),
final AS MATERIALIZED (SELECT p, e, x FROM books WHERE step = 2),
coded AS (
  SELECT q.r, q.p, min(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))) * 64 + b.e) AS best
  FROM parts q JOIN final b ON q.p = b.p GROUP BY q.r, q.p
),
encoded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(best % 64 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error
  FROM coded GROUP BY r
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM final) AS codebooks_sha256
FROM kept k JOIN encoded c ON k.r = c.r
"""

OP13_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE("text", '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
safe AS (
  SELECT conv_id, turn, role, t, list_reduce(list_concat([s], MARKS), lambda a, m: replace(a, m, CASE m[1] WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' ELSE '&#91;' END || m[2:])) AS body,
         list_reduce(list_concat([role], MARKS), lambda a, m: replace(a, m, CASE m[1] WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' ELSE '&#91;' END || m[2:])) AS name
  FROM (SELECT *, t AS s FROM said)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 16 + length(name) END) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
""".replace("MARKS", "['&amp;', '&lt;', '&#91;', '[INST]', '[/INST]', '<s>', '</s>', '<<SYS>>', '<</SYS>>', '[ROLE]', '[=]', '[/ROLE]']")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": OP1_SQL,
        "op3_mixing": OP3_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_chat_format": OP13_SQL,
    }
