"""Training data from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) to a DataFrame; what it returns is written
as Parquet in the folder that the cluster shares, and read again as the next one's docs. All
but the last keep the columns of documents, whatever other columns these have. Null ids pass
through the filters; texts that are null have no letter, so language identification rejects
them; empty tables pass as they are; very long texts are handled whole. Of near duplicates the
one with the smallest id stays; of rows that share an id, that with the first text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.checkpoints import discard, rest, written
from lodestar.llm import decontaminate, jaccard, langid, packing, pii
from lodestar.llm.common import few
from lodestar.llm.queries import vocabulary
from lodestar.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A language is taken for known from this score on.
SURE = 0.5


def rested(stage: Stage) -> Stage:
    """The stage, begun with what the one before has left in the executors' memory given back."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages; all, if no row has a label."""
    model = langid.train(docs)
    if not model.langs:
        return docs
    told = langid.predict(docs, model, docs.columns, names=("_language_found", "_language_score"))
    return told.where((F.col("_language_found") != "und") & (F.col("_language_score") >= SURE)).select(*docs.columns)


@rested
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group with five-word shingles alike to 0.8 or more."""
    told = jaccard.join(docs, k=5, percent=80)
    gone = told.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(few(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return kept
    # Rows that share an id are one document: the first of them in the order of their texts stays, then in that of all columns.
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.struct("text", F.to_json(every))).alias("_row"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))


@rested
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@rested
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in their texts; n_chars follows."""
    out = pii.spans(docs, keep=docs.columns, names=("_spans_found", "_text_sanitised"))
    text = F.when(F.col("text").isNotNull(), F.col("_text_sanitised"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


@rested
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", sanitise),
    ("packing", pack),
]
#: No stage but the last two's bookkeeping could be put in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of the documents; what a stage has left goes once the next one is written."""
    docs, done = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        discard(*done)
        done = [docs]
    return docs
