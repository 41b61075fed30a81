"""An extension: re-rating streets as speed and volume readings arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import rules
from kerbline.params import Params


def readings(stream: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(id, window, speed_mph, aadt) of a stream (id, ts, speed_mph, aadt): means by event-time window, late rows after `delay` dropped."""
    return stream.withWatermark("ts", delay).groupBy("id", F.window("ts", window)).agg(F.avg("speed_mph").alias("speed_mph"), F.avg("aadt").alias("aadt"))


def rerate(stream: DataFrame, streets: DataFrame, p: Params) -> DataFrame:
    """Stream of ratings: each window's readings over the static rest of a street (id, fac, rdclass, lanes)."""
    rows = readings(stream).join(streets.select("id", "fac", "rdclass", "lanes"), "id")
    return rows.select("id", "window", rules.lts("fac", "rdclass", "lanes", rules.snap_speed("speed_mph"), "aadt", p).alias("lts"))
