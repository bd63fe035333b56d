"""The provided tables read as the library's own: events are timed cues, documents are files, conversations are lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a wall-clock time, whatever the session's time zone."""
    c = F.col(ts)
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000
    return day + F.hour(c) * 3_600_000 + F.minute(c) * 60_000 + F.floor(F.expr(f"extract(second from {ts})") * 1000).cast("long")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, idx, start, end, text, value)``: each event lasts 0.01 hours for each hundredth of its value, in milliseconds."""
    length = F.round(F.col("value") * 100).cast("long") * 36_000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("idx"), millis("ts").alias("start"), (millis("ts") + length).alias("end"), F.col("event_type").alias("text"), "value")


def lengths(all_cues: DataFrame) -> DataFrame:
    return all_cues.groupBy("file_id").agg((F.max("end") + 600_000).alias("duration"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, idx, a, c)``: whole minutes against hundredths of the value."""
    return cues(spark, sf_dir).select("file_id", "idx", F.floor(F.col("start") / 60_000).cast("long").alias("a"), F.round(F.col("value") * 100).cast("long").alias("c"))


CUES = """cues AS (SELECT user_id AS f, event_id AS idx, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(round(value * 100) AS BIGINT) * 36000 AS e, event_type AS t, value AS v FROM events)"""
POINTS = CUES + """, pts AS (SELECT f, idx, s // 60000 AS a, CAST(round(v * 100) AS BIGINT) AS c FROM cues)"""
