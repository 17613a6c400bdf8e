"""Where queries are entered, and the derived tables that several of them read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Enters fn(tables) under its name, with its SQL if it has any."""

    def enter(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return fn

    return enter


def money(c) -> object:
    """An exact sum of cents, whatever the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")).cast("double")


#: Events as intervals: a user is the path, the start is in seconds, the length is the value in minutes.
INTERVALS_SQL = "(SELECT event_id, user_id AS path, event_type, epoch_us(ts) // 1000000 AS bstart, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) * 60 AS bend FROM events)"


def seconds(ts: str) -> object:
    """Whole seconds since 1970 of a time without a zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('SECOND', {ts}))")


def intervals(t: Tables) -> DataFrame:
    start = seconds("ts")
    return t.events.select("event_id", F.col("user_id").alias("path"), "event_type", start.alias("bstart"), (start + F.floor("value").cast("long") * 60).alias("bend"))
