"""Quality of relationships and files: metrics, ambiguity, coverage, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.5


def quality_metrics(rel: DataFrame, name: str, source: str, target: str) -> DataFrame:
    """One row of counts and confidence for a relationship."""
    return rel.agg(
        F.lit(name).alias("relationship"), F.count("*").alias("total_edges"),
        F.count_distinct(source).alias("unique_sources"), F.count_distinct(target).alias("unique_targets"),
        F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence_edges"),
    )


def ambiguity_report(rel: DataFrame, name: str, source: str, group: str) -> DataFrame:
    """How many sources have several candidates; counts by source and group first, then totals."""
    per = rel.groupBy(source, group).agg(F.count("*").alias("n"))
    several = F.col("n") > 1
    return per.agg(
        F.lit(name).alias("relationship"), F.count("*").alias("total_sources"), F.count_if(several).alias("ambiguous_sources"),
        F.max("n").alias("max_candidates"), F.avg(F.when(several, F.col("n"))).alias("avg_candidates"),
        (F.count_if(several) / F.count("*")).alias("ambiguity_rate"),
    )


def union_reports(reports: list[DataFrame]) -> DataFrame:
    if not reports:
        raise ValueError("a report needs a relationship")
    return reduce(DataFrame.unionByName, reports)


def flag_signal(df: DataFrame, key: str, name: str) -> DataFrame:
    """Whether a file has rows here, and how many."""
    return df.groupBy(key).agg(F.lit(1).alias(f"has_{name}"), F.count("*").alias(f"{name}_count"))


def file_quality(files: DataFrame, signals: dict[str, tuple[DataFrame, str, Column]], key: str = "file_id", base: float = 1000.0) -> DataFrame:
    """A score for each file: the base less the penalties of its signals {name: (rows, key, penalty)}.

    Each signal is summed by file before it is joined.
    """
    out = files.select(key)
    total: Column = F.lit(base)
    for name, (rows, its_key, penalty) in signals.items():
        per = rows.groupBy(F.col(its_key).alias("_k")).agg(F.sum(penalty).alias(f"{name}_penalty"), F.count("*").alias(f"{name}_count"))
        out = out.join(per, out[key] == per["_k"], "left").drop("_k")
        out = out.withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
        total = total - F.coalesce(F.col(f"{name}_penalty"), F.lit(0.0))
    return out.withColumn("file_quality_score", total).drop(*[f"{n}_penalty" for n in signals])


def file_coverage(files: DataFrame, sources: dict[str, tuple[DataFrame, str]], key: str = "file_id") -> DataFrame:
    """Which sources have each file, as flags, and how many do."""
    out, total = files.select(key), F.lit(0)
    for name, (rows, its_key) in sources.items():
        have = rows.select(F.col(its_key).alias("_k")).where("_k is not null").distinct().withColumn(f"has_{name}", F.lit(1))
        out = out.join(have, out[key] == have["_k"], "left").drop("_k").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(0)))
        total = total + F.col(f"has_{name}")
    return out.withColumn("source_count", total)


def schema_anomalies(spark, tables: dict[str, DataFrame], contracts: dict) -> DataFrame:
    """Columns that a contract wants and a table lacks or has in another type, as rows; reads schemas alone."""
    rows = []
    for name, schema in contracts.items():
        have = dict(tables[name].dtypes) if name in tables else {}
        for f in schema:
            if f.name not in have:
                rows.append((name, f.name, "missing"))
            elif have[f.name] != f.dataType.simpleString():
                rows.append((name, f.name, f"type {have[f.name]} instead of {f.dataType.simpleString()}"))
    return spark.createDataFrame(rows, "dataset string, column_name string, issue string")


def issue_batches(reports: dict[str, tuple[DataFrame, str]], limit: int = 100) -> DataFrame:
    """The first issues of each report as rows: the limit is the feature, a batch to look at."""
    parts = [df.where(bad).select(F.lit(n).alias("report"), F.to_json(F.struct(*df.columns)).alias("issue")).orderBy("issue").limit(limit) for n, (df, bad) in reports.items()]
    return union_reports(parts)
