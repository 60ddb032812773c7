"""The corpus pipeline: language, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch
from tallyframe.llm.jaccard_join import jaccard_join
from tallyframe.llm.language_id import language_id
from tallyframe.llm.packing import pack
from tallyframe.llm.pii import sanitise
from tallyframe.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of at least LEAST_CHARS whose cosine with every language's prototype is below LEAST_SCORE is in none of
#: them; shorter texts have few trigrams and so low cosines in any language.
LEAST_SCORE, LEAST_CHARS = 0.3, 200


def _retexted(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with another text and its length in code points."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no text, no letter, or a long text unlike every prototype."""
    known = language_id(docs.select(*COLUMNS), docs)
    return known.filter((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SCORE) | (F.char_length("text") < LEAST_CHARS))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id (then of smallest hash) of each component; documents without words stay.

    Rows of a null id, or of one id with different texts, are documents of their own; only rows equal in id and text are one.
    """
    key = F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text").alias("key")
    keyed = docs.select(key, *COLUMNS)
    found = jaccard_join(keyed.select("key", "text"), id_col="key").distinct().join(keyed.select("key", "doc_id").distinct(), "key")
    found = Scratch(spark).write(found)
    least = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("least.key")
    keep = found.filter("n_shingles = 0").select("key").unionByName(least).distinct()
    one = keyed.join(keep, "key", "left_semi").groupBy("key", "doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows of 20 words; texts without any stay as they are."""
    out = substring_dedup(docs.select(*COLUMNS))
    return _retexted(out, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises entities to their kind and removes terms which reveal them."""
    return _retexted(sanitise(docs.select(*COLUMNS)), F.col("sanitised"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]

#: Byte-level BPE and the differencing of windows have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet in the shared folder and reread."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), narrow=False)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
