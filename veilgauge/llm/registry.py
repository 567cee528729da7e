"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from veilgauge.llm import (backoff, boosting, chat, infill, jaccard, licences, packing, personal, pieces, pivots, rules, sharding,
                           whitening)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    scored = backoff.score_documents(table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"))


OP1_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
words AS (
  SELECT id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM texts),
tokens AS (
  SELECT id, pos, w, lag(w) OVER t AS p1, lag(w, 2) OVER t AS p2 FROM words WINDOW t AS (PARTITION BY id ORDER BY pos)),
counted AS (
  SELECT id, pos, p1, p2,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY id, w) AS c1,
         count(*) OVER (PARTITION BY p1, w) - count(*) OVER (PARTITION BY id, p1, w) AS c2,
         count(*) OVER (PARTITION BY p2, p1, w) - count(*) OVER (PARTITION BY id, p2, p1, w) AS c3,
         count(*) OVER () - count(*) OVER (PARTITION BY id) AS n
  FROM tokens),
contexts AS (
  SELECT *, lag(c1) OVER t AS d2, lag(c2) OVER t AS d3 FROM counted WINDOW t AS (PARTITION BY id ORDER BY pos)),
unigrams AS (
  SELECT *, greatest(c1, 1) / greatest(n, 1) AS s1 FROM contexts),
bigrams AS (
  SELECT *, CASE WHEN p1 IS NULL THEN s1 WHEN c2 > 0 THEN c2 / d2 ELSE 0.4::DOUBLE * s1 END AS s2 FROM unigrams),
scores AS (
  SELECT id, sum(ln(CASE WHEN p2 IS NULL THEN s2 WHEN c3 > 0 THEN c3 / d3 ELSE 0.4::DOUBLE * s2 END)) AS log_score
  FROM bigrams GROUP BY id)
SELECT doc_id, len(words) AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score,
       round(log_score / nullif(len(words), 0), 6) AS mean_log_score
FROM texts LEFT JOIN scores USING (id)
"""


def op2_pivot_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(table(spark, folder, "embeddings"))


def op3_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    return boosting.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    found = licences.scan(files)
    inherited = F.col("origin") == "inherited"
    return found.select("doc_id", F.when(~inherited, F.col("licence")).alias("licence"), "cosine", "origin",
                        F.when(inherited, F.col("licence")).alias("directory_licence"), "from_path")


def op6_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    pieces_ = packing.tokenized(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    short = pieces_.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(short)


def op7_t_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard.similar_groups(table(spark, folder, "documents"), words=4, similarity=(85, 100))
    return groups.select("doc_id", "n_shingles", "component_id")


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(turns)
    back = made.select("conv_id", "valid", "first_error", F.length("formatted").cast("long").alias("formatted_chars"),
                       chat.parsed(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "valid", "first_error")


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM turns),
moves AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY pos) AS previous,
         count(*) OVER (PARTITION BY conv_id) AS n FROM numbered),
checked AS (
  SELECT *, (previous, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'),
                                 ('assistant', 'user')) AND (pos > 0 OR previous = 'start') AS allowed,
         length(replace(replace(role, '\', '\\'), chr(10), '\n')) + (length(role) - length(replace(role, '<|', ''))) // 2 AS role_length,
         length(replace(text, '\', '\\')) + (length(text) - length(replace(text, '<|', ''))) // 2 AS text_length
  FROM moves)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + role_length + 1 + text_length + 10 + 1) AS BIGINT) AS formatted_chars,
       min(CASE WHEN NOT allowed THEN pos END) IS NULL AND bool_or(pos = n - 1 AND role = 'assistant') AS valid,
       CAST(coalesce(min(CASE WHEN NOT allowed THEN pos END),
                     CASE WHEN NOT bool_or(pos = n - 1 AND role = 'assistant') THEN count(*) END) AS INTEGER) AS first_error
FROM checked GROUP BY conv_id
"""


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, folder, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_adaptive_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
windows AS (
  SELECT id, pos, array_to_string(words[pos:pos + 4], ' ') AS w
  FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS pos FROM words)),
covered AS (
  SELECT id, count(DISTINCT pos + k) AS n
  FROM (SELECT id, pos, count(*) OVER (PARTITION BY id, w) AS times FROM windows), range(0, 5) r(k)
  WHERE times > 1 GROUP BY id),
lines AS (
  SELECT id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
counted AS (
  SELECT t.doc_id, t.lang, t.source, len(w.words) AS n_words, length(array_to_string(w.words, '')) AS word_chars,
         length(t.text) - length(translate(t.text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts t JOIN words w USING (id) LEFT JOIN lines l USING (id) LEFT JOIN covered c USING (id)),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(word_chars / nullif(n_words, 0), 0.0) AS m1, coalesce(n_symbols / nullif(word_chars, 0), 0.0) AS m2,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS m3, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS m4
  FROM counted),
long AS (
  SELECT lang, source, base_failed, unnest([1, 2, 3, 4]) AS m, unnest([m1, m2, m3, m4]) AS v FROM measured),
levels AS (
  SELECT 1 AS level, lang, source, m, v FROM long WHERE NOT base_failed
  UNION ALL SELECT 2, lang, NULL, m, v FROM long WHERE NOT base_failed
  UNION ALL SELECT 3, NULL, NULL, m, v FROM long WHERE NOT base_failed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, m ORDER BY v) AS r,
         count(*) OVER (PARTITION BY level, lang, source, m) AS n FROM levels),
quartiles AS (
  SELECT level, lang, source, m, any_value(n) AS n, min(v) FILTER (r >= 0.25 * n) AS q1, min(v) FILTER (r >= 0.75 * n) AS q3
  FROM ranked GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, m FROM long),
chosen AS (
  SELECT g.lang, g.source, g.m, arg_min(struct_pack(q1 := q.q1, q3 := q.q3), q.level) AS q
  FROM groups g JOIN quartiles q ON q.m = g.m AND (
    q.level = 1 AND q.n >= 100 AND q.lang IS NOT DISTINCT FROM g.lang AND q.source IS NOT DISTINCT FROM g.source
    OR q.level = 2 AND q.n >= 100 AND q.lang IS NOT DISTINCT FROM g.lang OR q.level = 3)
  GROUP BY ALL),
bounds AS (
  SELECT lang, source, m, q.q1 - 4 * s AS low, q.q3 + 4 * s AS high
  FROM (SELECT *, greatest(q.q3 - q.q1, [0.5, 0.01, 0.07, 0.03][m]) AS s FROM chosen))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM bounds b WHERE b.lang IS NOT DISTINCT FROM d.lang AND b.source IS NOT DISTINCT FROM d.source
         AND ([d.m1, d.m2, d.m3, d.m4][b.m] < b.low OR [d.m1, d.m2, d.m3, d.m4][b.m] > b.high)) AS kept
FROM measured d
"""


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(infill.restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM texts),
cuts AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
pieces AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""


def op12_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"))
    flat = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return flat.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
                       F.col("explained")[F.col("place")].alias("explained"), "identity_error")


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    return personal.personal_spans(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", *[personal.n_of(spans, kind).alias(f"n_{kind}") for kind in personal.BASE],
        F.sha2(personal.listed(spans, base_only=True).cast("binary"), 256).alias("base_sha256"), personal.listed(spans).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_stupid_backoff, op2_pivot_permutation, op3_boosted_quality, op4_jump_shards, op5_licence_scan, op6_linear_grouping, op7_t_occurrence, op8_chat_format, op9_sentencepiece,
        op10_adaptive_rules, op11_fill_in_middle, op12_jacobi_davidson, op13_personal_data)}


def statements() -> dict[str, str]:
    return {"op1_stupid_backoff": OP1_SQL, "op8_chat_format": OP8_SQL, "op10_adaptive_rules": OP10_SQL,
            "op11_fill_in_middle": OP11_SQL}
