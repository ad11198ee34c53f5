"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, jaccard_join, language, lexical, licenses, line_dedup, mixing, quality, runs, sentencepiece_codec, substring_dedup, tokens

_S = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.JaccardJoin(_documents(spark, sf_dir)).report()


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_documents(spark, sf_dir))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_report(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(_documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode_report(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(_documents(spark, sf_dir), rewrite=runs.planted)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_token_ids": op5_token_ids,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_rotate_perspectives": op8_rotate_perspectives,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {
    "op8_rotate_perspectives": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS said,
    regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<||im_start||>'), '<|im_end|>', '<||im_end||>'), '[\r\n]', ' ', 'g') AS role,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<||im_start||>'), '<|im_end|>', '<||im_end||>') AS text
  FROM conversations),
t AS (SELECT *, said = 'system' AS system, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM r),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE NOT system),
p AS (
  SELECT t.conv_id, perspective, rn, NOT system AND role = perspective AS learn,
    '<|im_start|>' || CASE WHEN system THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
    t.text || '<|im_end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY rn) AS BIGINT) - 1 AS e FROM p)
SELECT conv_id, perspective, count(*) AS n_turns,
  CAST(coalesce(sum(length(body)) FILTER (WHERE learn), 0) AS BIGINT) AS n_learned,
  string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
  coalesce(string_agg((e - length(body)) || '-' || e, ',' ORDER BY rn) FILTER (WHERE learn), '') AS mask
FROM q GROUP BY conv_id, perspective
""",
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), {_S}, '') AS norm FROM documents),
h AS (SELECT doc_id, chars, norm, sha256(norm) AS text_sha256 FROM n),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place, count(*) OVER (PARTITION BY norm) AS group_size FROM h WINDOW g AS (PARTITION BY norm ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
""",
    "op10_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_S}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
a AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
c AS (SELECT p.r, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS adds FROM p JOIN w USING (term) JOIN n USING (r), s),
t AS (SELECT item_id, r, CAST(sum(adds) AS BIGINT) AS score FROM a JOIN c USING (term) GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM t JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
}
