"""The corpus pipeline: documents through five operators, each stage stored as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import contamination, jaccard, packing, substrings, toxicity
from kerbline.llm.common import broadcast_if_small, saved, table
from kerbline.session import ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among ids (doc_id)."""
    ids = saved(ids.where("doc_id IS NOT NULL").select("doc_id").distinct(), "dropped")
    return docs.join(broadcast_if_small(ids), "doc_id", "left_anti").select(docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fit(docs, table(ship(spark), sf_dir, "labels"))
    return _without(docs, toxicity.score(docs, model).where("predicted = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each component of the n-gram Jaccard join; of rows that repeat an id all stay."""
    ship(spark)
    groups = jaccard.jaccard_join(docs)
    return _without(docs, groups.where("doc_id <> component_id"))


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they repeat; those of which nothing is left go."""
    ship(spark)
    out = substrings.dedup(docs)
    emptied = (F.size("removed_spans") > 0) & (F.trim("text") == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("removed_spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, _ = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, rows.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences of 1024."""
    ship(spark)
    return packing.pack(packing.tokenise(docs, TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", one_of_each),
    ("substring_dedup", passages_out),
    ("benchmark_decontamination", leaks_out),
    ("best_fit_packing", packed),
]

#: Classifiers, components and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
