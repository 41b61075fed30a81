"""Shared plumbing of the corpus operators: tables, held-out rows, tidy Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.storage import BROADCAST_ROWS, discard, give_back, saved, scratch, scratch_path
from kerbline.storage import small as broadcast_if_small

__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "discard", "held_out", "saved", "scratch", "scratch_path", "table", "tidy", "union_all"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work for mapInPandas, after which the worker gives freed memory back: workers live on, and their peaks would add up."""

    def run(frames: Iterator) -> Iterator:
        try:
            yield from work(frames)
        finally:
            give_back()

    return run


def held_out(col: str = "doc_id") -> Column:
    """True for the third of the rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
