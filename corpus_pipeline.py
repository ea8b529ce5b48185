"""A corpus pipeline of five stages; each reads what the one before has written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and reads it again.
All but the last return the columns of ``documents``, whatever other columns those are, and keep their values but for those
named. A stage that begins deletes the intermediate tables that earlier stages of its run have left, but for those that its own
input still reads, so stages may also be chained without writing between them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm import common, language_id, line_dedup, mixing, ngram_join, packing
from placelens.llm.queries import tokenizer_path

_run: ContextVar[str] = ContextVar("pipeline", default="pipeline")


def _own(spark: SparkSession, docs: DataFrame, stage: Callable[[], DataFrame]) -> DataFrame:
    """The stage's result, its tables counted to the run; earlier ones that ``docs`` does not read go first."""
    common.release(spark, _run.get(), docs)
    with common.owned_by(_run.get()):
        return stage()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identification rejects go: texts unlike all languages, null texts and texts without a letter.

    Repeated rows share their verdict; ties between languages do not matter; without labelled rows all go; an empty table
    gives an empty result.
    """
    return _own(spark, docs, lambda: language_id.accepted(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go from the texts, n_chars follows; a document left without words goes.

    So do null and empty texts; of repeated rows and equal lines the first in the order of ids stays, null ids last; an
    empty table gives an empty result.
    """

    def stage() -> DataFrame:
        cleaned = line_dedup.clean(docs)
        if "n_chars" in docs.columns:
            cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return cleaned.filter(F.col("text").rlike(common.WORD)).select(*docs.columns)

    return _own(spark, docs, stage)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of smallest id (null ids last); rows with null text stay.

    An empty table gives an empty result.
    """
    return _own(spark, docs, lambda: ngram_join.one_of_each(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by whole documents: taken / size rounded, at most twice.

    Null and empty texts stay once; a null source is a source; repeated rows are drawn each; an empty table gives an empty
    result.
    """
    return _own(spark, docs, lambda: mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a null or empty text is its end id alone, repeated rows are packed each.

    An empty table gives an empty result.
    """
    return _own(spark, docs, lambda: packing.pack(docs, tokenizer_path()))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_ngrams),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses none of the hashed models and schedules; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it have written is deleted as soon as the next one is."""
    name = f"pipeline-{uuid.uuid4().hex}"
    token = _run.set(name)
    try:
        docs, folder = common.table(spark, sf_dir, "documents"), f"{common.shared_folder(spark)}/{name}"
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                common.delete(spark, f"{folder}/{i - 1}")
        common.release(spark, name)
    finally:
        _run.reset(token)
    return docs
