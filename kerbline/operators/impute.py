"""Cascading imputation with provenance, sample weights and support masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.rules import COARSE, MODEL, NARROW, STATION


def station_medians(counts: DataFrame, station: str, value: str, chars: int) -> DataFrame:
    """(key, value): exact median by the last characters of the trimmed station id; null values are left out."""
    key = F.right(F.trim(F.col(station)), F.lit(chars))
    return counts.where(F.col(value).isNotNull()).groupBy(key.alias("key")).agg(F.median(value).alias("value"))


def first_by_key(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The values of each key's first row; a pre-aggregated minimum, not a window."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("v"))
    return best.select(key, *(F.col(f"v.{v}").alias(v) for v in values))


def cascade(df: DataFrame, measured: str, groups: list[list[str]], floor: float, out: str = "aadt", model: Column | None = None) -> DataFrame:
    """df with the resolved value and its source `<out>_src`.

    A measured value stands (0); then the model's, where it has one (3); then the median of measured
    values of the first group of keys that has one (1 for the first set of keys, 2 for later ones), null
    keys matching null; then the floor (2). Sets of keys with a missing column are skipped but keep
    their place. One aggregate and one join per set.
    """
    found = [F.when(F.col(measured).isNotNull(), F.struct(F.col(measured).cast("double").alias("v"), F.lit(STATION).alias("s")))]
    if model is not None:
        found.append(F.when(model.isNotNull(), F.struct(model.cast("double").alias("v"), F.lit(MODEL).alias("s"))))
    rows = df
    for i, keys in enumerate(groups):
        if any(k not in df.columns for k in keys):
            continue
        medians = df.where(F.col(measured).isNotNull()).groupBy(*(F.col(k).alias(f"_k{i}_{k}") for k in keys)).agg(F.median(measured).alias(f"_m{i}"))
        on = [rows[k].eqNullSafe(medians[f"_k{i}_{k}"]) for k in keys]
        rows = rows.join(medians, on, "left").drop(*(f"_k{i}_{k}" for k in keys))
        found.append(F.when(F.col(f"_m{i}").isNotNull(), F.struct(F.col(f"_m{i}").cast("double").alias("v"), F.lit(NARROW if i == 0 else COARSE).alias("s"))))
    found.append(F.struct(F.lit(float(floor)).alias("v"), F.lit(COARSE).alias("s")))
    rows = rows.withColumn("_r", F.coalesce(*found))
    return rows.select(*df.columns, F.col("_r.v").alias(out), F.col("_r.s").alias(f"{out}_src"))


def sample_weights(df: DataFrame, key: str, out: str = "weight") -> DataFrame:
    """df with 1 / number of rows of the key."""
    return df.withColumn(out, 1 / F.count("*").over(Window.partitionBy(key)))


def support_mask(df: DataFrame, station: str, categories: list[str], least: int, eligible: Column, out: str = "supported") -> DataFrame:
    """df with whether a row is eligible and each of its categories was seen at `least` stations."""
    ok = eligible
    for c in categories:
        seen = df.where(F.col(station).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.count_distinct(station).alias(f"_n_{c}"))
        df = df.join(seen, df[c].eqNullSafe(seen[f"_{c}"]), "left").drop(f"_{c}")
        ok = ok & (F.coalesce(F.col(f"_n_{c}"), F.lit(0)) >= least)
    return df.withColumn(out, F.coalesce(ok, F.lit(False))).drop(*(f"_n_{c}" for c in categories))


def regression_metrics(df: DataFrame, station: str, truth: str, predicted: str, breaks: list[float]) -> DataFrame:
    """One row (n, rmsle, mae, median_ape, bin_accuracy) over stations: least truth and median prediction of each."""
    per = df.groupBy(station).agg(F.min(truth).alias("t"), F.median(predicted).alias("p"))
    bin_ = lambda c: sum(((F.col(c) > b).cast("int") for b in breaks), F.lit(0))
    return per.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.log1p("p") - F.log1p("t"), 2))).alias("rmsle"), F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"),
        (F.median(F.abs(F.col("p") - F.col("t")) / F.col("t")) * 100).alias("median_ape"), F.avg((bin_("p") == bin_("t")).cast("double")).alias("bin_accuracy"),
    )
