"""One registered query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import conversation, lexical, main_text
from ledgerlens.llm.bpe import encode_digests
from ledgerlens.llm.common import read_table
from ledgerlens.llm.fingerprint import edited_likeness
from ledgerlens.llm.hnsw import nearest_neighbours
from ledgerlens.llm.minhash import near_duplicates
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.packing import packed_documents
from ledgerlens.llm.suffix_dedup import removal_digests
from ledgerlens.llm.token_files import token_file_digests
from ledgerlens.llm.toxicity import fit, held_out, scored
from ledgerlens.llm.warc import derivatives, responses_of_pages

MIX_SEED = "mixture-1"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets an equal share of the characters of the mixture."""
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, seed=MIX_SEED, size=F.length(F.coalesce("text", F.lit(""))))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    rows = scored(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return main_text.extracted(pages, main_text.fit(pages), ["page_id", "url"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derivatives(responses_of_pages(read_table(spark, sf_dir, "pages")))
    return records.withColumn("block", F.decode("block", "utf-8"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(read_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.conversation_audits(read_table(spark, sf_dir, "conversations"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 20)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_main_text": op4_main_text,
    "op5_bpe": op5_bpe,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op11_conversation_repair": conversation.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
    "op1_mix_sources": f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(size) FROM sizes) / size AS rate
  FROM sizes WHERE size > 0),
split AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts FROM rates),
steps AS (
  SELECT source, k, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate / parts AS lam, unnest(generate_series(0, ceil(rate / parts + 12 * sqrt(rate / parts) + 30)::BIGINT)) AS k
        FROM split)),
draws AS (
  SELECT doc_id, source, rate,
         CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part), 1, 13) AS BIGINT)::DOUBLE
           / 4503599627370496.0 AS u
  FROM (SELECT d.doc_id, d.source, s.rate, unnest(generate_series(1, s.parts)) AS part
        FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source)),
counts AS (
  SELECT doc_id, any_value(rate) AS rate, sum((SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM draws.source AND s.cdf < draws.u)) AS n
  FROM draws GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy, c.rate,
       md5('{MIX_SEED}:order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.copy) AS shuffle_key
FROM documents d
JOIN (SELECT doc_id, rate, unnest(generate_series(1, n::BIGINT)) AS copy FROM counts WHERE n > 0) c
  ON d.doc_id IS NOT DISTINCT FROM c.doc_id
""",
}
