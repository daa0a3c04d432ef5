"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir)
whose result is written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspan.llm.common import durable, free_name, numbered, small_batches, table
from marlspan.llm.exact_dedup import drop_exact_copies
from marlspan.llm.language_id import UNKNOWN, predict, train
from marlspan.llm.mixing import entropy_mix
from marlspan.llm.ngram_jaccard import drop_near_copies
from marlspan.llm.packing import pack_documents

#: A language is rejected below this share of its mean word score: half is far under what any text in one language gets.
MIN_LANGUAGE_SCORE = 0.5
MIX_WEIGHTS = [3.0, 1.0, 2.0]
TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Words whose ids a worker of the last stage remembers: fewer than a query by itself has room for, as its executors hold what the stages before needed.
CACHED_WORDS = 250_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model learns from all
    labelled documents of the stage; null and letterless texts go."""
    small_batches(spark)
    model = train(docs.select("text", "lang"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = predict(docs, model, lang_col=lang, score_col=score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    small_batches(spark)
    return drop_near_copies(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, one or two copies."""
    row, copies = free_name(docs, "row"), free_name(docs, "copies")
    rows = numbered(docs, row)
    mixed = entropy_mix(rows, MIX_WEIGHTS, share=1.5, cap=2.0, row_col=row)
    taken = durable(mixed.where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies)), "copies")
    return rows.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents packed into sequences; ``row`` tells copies apart."""
    small_batches(spark)
    return pack_documents(docs, TOKENIZER, CAPACITY, cached_words=CACHED_WORDS).select(
        F.col("id").alias("doc_id"), "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no word for the learned, iterated and genetic stages; tests compare the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
