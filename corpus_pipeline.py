"""A training corpus from ``documents`` in five stages, each an operator of ``stemma.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import langid, packing, passages, simhash, toxicity
from stemma.llm.shared import deleted, noted, shared_folder, written


#: Intermediate tables of the stage before in this thread: its result is stored when the next one starts, which deletes them.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        deleted(spark, _LEFT.get())
        with noted() as folders:
            result = f(spark, docs, sf_dir)
        _LEFT.set(tuple(folders))
        return result

    return run_stage


@stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what has no letters, or fits no language better than chance, goes."""
    judged = langid.identify(docs, langid.learn(docs), declared=F.col("lang"), host=F.col("source"))
    return judged.filter("accepted").select(*docs.columns)


@stage
def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


@stage
def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_near_copies(docs)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document of nothing else goes."""
    cut = passages.remove_repeated(docs)
    kept = cut.filter("NOT (removed_words > 0 AND text = '')")
    return kept.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", keep_clean),
    ("simhash_near_dedup", keep_one_of_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = apply(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, folder=shared_folder(spark))
    _LEFT.set(())  # the last stage's tables have yet to be read
    return docs
