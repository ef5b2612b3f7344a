"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import ship
from timberline.llm import chat_format, decontaminate, exact_dedup, language_id, mixing, near_dedup, quality_lm, token_counts, toxicity, url_filter
from timberline.llm.common import new_path
from timberline.llm.mixing import GOLDEN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_lm.classify(docs, trusted).select("doc_id", "perplexity", "lo", "hi", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.Tokenizer("piece_bpe_32k.model"), new_path(spark, "token-cache"), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(_remainder(5) != 0), labels.where(_remainder(5) != 0).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation beside a worse one of its own; spans as text, so that SQL can give the same."""
    rows = chat_format.format_preferences(chat_format.echo_pairs(chat_format.conversations(_table(spark, sf_dir, "conversations"))))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.withColumns({c: text(c) for c in ("chosen_spans", "rejected_spans")})


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "run", "kind", F.lit(True).alias("contaminated"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs, language_id.fit(docs.where(_remainder(4) != 2)))
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLES["op4_exact_dedup"] = f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""


def mixing_sql(rows: str) -> str:
    """`rows`: SQL that gives doc_id, source, text."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM ({rows})),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM l WHERE level * weight <= cap) * weight), cap) AS target FROM l),
n AS (SELECT *, CAST(ceil(source_size / 32) AS BIGINT) AS blocks, CAST(round(target) AS BIGINT) AS take FROM t),
r AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN take // source_size * blocks + ceil((take % source_size) / 32) ELSE 0 END AS BIGINT) AS need FROM n),
h AS (SELECT *, CAST(sum(need) OVER (ORDER BY source NULLS LAST) AS DOUBLE) / CAST(sum(need) OVER () AS DOUBLE) AS hi FROM r WHERE need > 0),
i AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM h),
q AS (SELECT (CAST(slot + 1 AS DOUBLE) * {GOLDEN}::DOUBLE) % 1.0::DOUBLE AS u FROM range(CAST((SELECT sum(need) FROM r) AS BIGINT)) AS g(slot)),
c AS (SELECT source, least(count(*), 2 * any_value(blocks)) AS used FROM i JOIN q ON u >= lo AND u < hi GROUP BY source),
f AS (SELECT r.source, r.source_size, target, coalesce(CAST(used // blocks AS BIGINT), 0) AS rounds, coalesce(least(used % blocks * 32, r.source_size), 0) AS rest FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(rounds * size + greatest(least(start + size, rest) - start, 0) AS BIGINT) AS taken
FROM p JOIN f ON p.source IS NOT DISTINCT FROM f.source
"""


ORACLES["op10_mixing"] = mixing_sql("SELECT doc_id, source, text FROM documents")

ORACLES["op5_chat_format"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
a AS (SELECT conv_id, count(*) AS size, max(i) FILTER (role = 'assistant') AS l, min(i) FILTER (role = 'assistant') AS f FROM n GROUP BY conv_id),
w AS (SELECT n.*, a.size, a.l, CASE WHEN n.i = a.l THEN CASE WHEN a.f < a.l THEN (SELECT m.text FROM n m WHERE m.conv_id = n.conv_id AND m.i = a.f) ELSE '' END ELSE n.text END AS other FROM n JOIN a USING (conv_id)),
p AS (SELECT conv_id, coalesce(min(i) FILTER (text <> other) - 1, any_value(size)) AS k FROM w GROUP BY conv_id),
r AS (SELECT w.*, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS d FROM w JOIN p USING (conv_id)),
s AS (SELECT *, coalesce(sum(length(c)) FILTER (i > k) OVER b, 0) AS cs, coalesce(sum(length(d)) FILTER (i > k) OVER b, 0) AS ds FROM r WINDOW b AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(any_value(k) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(c, '' ORDER BY i) FILTER (i <= k), '') AS prompt, coalesce(string_agg(c, '' ORDER BY i) FILTER (i > k), '') AS chosen, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > k), '') AS rejected,
       coalesce(string_agg(CAST(CAST(cs + length(role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(cs + length(c) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(CAST(ds + length(role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ds + length(d) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id
"""
