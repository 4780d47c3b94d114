"""A corpus pipeline of the operators in ``ledgerlens.llm``.

Each stage takes the documents that the stage before it kept and returns
documents with the same columns; the last returns their token ids.  A stage's
result is written and read again before the next stage is called, so a stage
first deletes the working tables that earlier ones left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, suffix_dedup, toxicity
from ledgerlens.llm.common import read_table, release, written
from ledgerlens.llm.minhash import near_duplicates
from ledgerlens.llm.mixing import mix
from ledgerlens.operators.materialize import shared

MIX_SEED = "pipeline-mixture"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working: list[str] = []  # working tables of the stage called last


def stage(function: Stage) -> Stage:
    """Delete the working tables of the stage before, whose result is written."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _working)
        before = len(written)
        out = function(spark, docs, sf_dir)
        _working.extend(written[before:])
        del written[before:]
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from the labelled ones among
    them, scores below one half."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, COLUMNS, below=0.5)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id.

    Rows are linked by a number of their own, written with them so that every
    scan sees the same one: ids can be null or repeated.  A null id comes after
    all others; rows without a word, which are linked with nothing, are one
    where id and text are equal."""
    rows = shared(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    words = F.col("n_shingles") > 0
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "row")
    names = rows.select("row", "doc_id", F.xxhash64(*COLUMNS).alias("hash"), F.md5("text").alias("digest"))
    kept = (near_duplicates(rows, key="row").withColumnRenamed("row", "linked").hint("merge").join(names, F.col("linked") == F.col("row"))
            .groupBy(F.when(words, F.col("component_id")), F.when(~words, F.col("doc_id")), F.when(~words, F.col("digest")), words)
            .agg(F.min(order).alias("least")).select(F.col("least.row").alias("row")))
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that occur elsewhere."""
    rest = [c for c in COLUMNS if c not in ("text", "n_chars")]
    out = suffix_dedup.remove_repeats(docs, "text string", lambda data, runs: (suffix_dedup.kept_text(data, runs),), carry=rest)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of the characters for all sources; copies keep their id."""
    return mix(docs, seed=MIX_SEED, size=F.length(F.coalesce("text", F.lit("")))).select(*COLUMNS)


@stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every copy."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = shared(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
