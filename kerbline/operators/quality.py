"""Declarative checks: one aggregate over all of a table's expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(Exception):
    """Rows break an expectation; the message names up to five of them."""


def expect(df: DataFrame, key: str, **bad: Column) -> DataFrame:
    """df, if no row fulfils any of the bad predicates; else ExpectationError with up to five offenders of each."""
    counts = df.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in bad.items())).first()
    failed = [n for n in bad if counts[n]]
    if failed:
        said = [f"{n}: {counts[n]} rows, such as {[r[0] for r in df.where(bad[n]).select(key).limit(5).collect()]}" for n in failed]
        raise ExpectationError("; ".join(said))
    return df


def expect_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if key is never null and never repeated."""
    expect(df, key, missing=F.col(key).isNull())
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").select(key).limit(5).collect()]
    if twice:
        raise ExpectationError(f"{key} repeats: {twice}")
    return df


def expect_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the required columns under the given spelling, matched without regard to case."""
    have = {c.lower(): c for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise ExpectationError(f"missing columns: {missing}")
    return df.withColumnsRenamed({have[c.lower()]: c for c in columns if have[c.lower()] != c})


def coverage_gate(recall: float, inflation: float, min_recall: float, max_inflation: float) -> None:
    """Raises ExpectationError unless the matched network covers its source and isn't blown up."""
    if recall < min_recall or inflation > max_inflation:
        raise ExpectationError(f"recall {recall:.3f} (least {min_recall}), inflation {inflation:.3f} (most {max_inflation})")


def miles_gate(df: DataFrame, group: str, miles: str, ranges: dict[str, list[float]], name: str | None = None, required: list[str] = ()) -> None:
    """Raises ExpectationError if a group's miles leave their range or a required name is missing."""
    got = {r[0]: r[1] for r in df.groupBy(group).agg(F.sum(miles)).collect()}
    said = [f"{g}: {got.get(g, 0.0):.2f} miles, not in {lo}-{hi}" for g, (lo, hi) in ranges.items() if not lo <= (got.get(g) or 0.0) <= hi]
    if required:
        wanted = df.sparkSession.createDataFrame([(n,) for n in required], f"{name} string")
        said += [f"{r[0]} is missing" for r in wanted.join(df, name, "left_anti").collect()]
    if said:
        raise ExpectationError("; ".join(said))
