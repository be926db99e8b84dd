"""Cleaning of a training corpus: five stages, each over all that the one before kept."""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import decontaminate, language_id, ngram_join, sentencepiece_codec, suffix_dedup
from factgraph.llm.common import collected, release, stored, table
from factgraph.llm.queries import tokenizer_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3
#: Rows that go to a Python worker at once: texts are long, and a batch lies in the executor and in the worker.
BATCH_ROWS = 1000
#: Spark deletes a query's shuffle files when it ends; else they lie beside the next ones until the driver collects garbage.
END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own = threading.local()


def staged(stage):
    """A stage that first deletes what earlier stages stored, but for what its documents are still read from. It sets the session's Arrow batches to BATCH_ROWS, and END_SHUFFLES."""
    @functools.wraps(stage)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not hasattr(_own, "paths"):
            _own.paths = []
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set(END_SHUFFLES, "true")
        release(spark, _own.paths, docs)
        with collected(_own.paths):
            return stage(spark, docs, sf_dir)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row for a stage's joins: doc_id may repeat or be null."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()))


def by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("row").alias("doc_id"), "text")


@staged
def detect_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (no letter, or no class above LEAST_SCORE); lang becomes the predicted one. Repeated rows and null doc_ids stay; no rows give none."""
    found = language_id.identify(docs, language_id.train(docs), ["text", "source", "n_chars"]).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumnRenamed("lang_pred", "lang").select(COLUMNS)


@staged
def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of each group of documents that share 0.8 of their five-word shingles."""
    return ngram_join.keep_one(docs).select(COLUMNS)


@staged
def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that an earlier document has; a character cut in half goes, and a document with nothing left."""
    found = suffix_dedup.dedup(docs, carry=["lang", "source"]).withColumnRenamed("kept", "text").where(F.trim("text") != "")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@staged
def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    docs = keyed(docs)
    found = decontaminate.decontaminate(by_row(docs), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("row"))
    return docs.join(found, "row", "left_anti").select(COLUMNS)


@staged
def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text and the text that they decode to."""
    return sentencepiece_codec.encode_decode(docs, tokenizer_model(), "full")


STAGES = [("language_id", detect_language), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again, and what it stored goes when the next has its own."""
    docs, results = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with collected(results):
            docs = stored(stage(spark, docs, sf_dir))
        release(spark, results, docs)
    return docs
