"""Aggregates, best-per-key and ranked views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hourly_anomalies(tracks: DataFrame, limit: float = 0.7) -> DataFrame:
    """Per hour: rows over the anomaly limit, mean score, and the positions' count and box."""
    return tracks.groupBy(F.date_trunc("hour", "time").alias("bucket")).agg(F.count_if(F.col("anomaly_score") > limit).alias("anomaly_count"), F.round(F.avg("anomaly_score"), 6).alias("avg_score"), F.count("lon").alias("n_positions"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def sorted_chunks(df: DataFrame, key: str, order: list[str], name: str, size: int = 1000) -> DataFrame:
    """(key, chunk from 0, name: at most ``size`` structs of ``order``): the rows of each key in
    order. A key's rows are sorted, not gathered: no row of the result grows with the key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    dealt = df.select(key, *order, F.floor(n / size).cast("int").alias("chunk"))
    return dealt.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))


def positions(tracks: DataFrame, size: int = 1000) -> DataFrame:
    """Per hour the multipoint of all positions, sorted, in chunks: (bucket, chunk, points)."""
    return sorted_chunks(tracks.select(F.date_trunc("hour", "time").alias("bucket"), "lon", "lat"), "bucket", ["lon", "lat"], "points", size)


def best_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """One row a key, first by ``order``; null keys are one key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def revisions(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before, with previous, new and delta."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(time))
    return df.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value))).select(key, time, "previous", F.col(value).alias("new"), F.round(F.col(value) - F.col("previous"), 6).alias("delta"))


def history(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """SCD-2 rows: each run of an unchanged value with its validity interval."""
    w = Window.partitionBy(key).orderBy(time)
    changed = df.withColumn("_new", F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))).where("_new")
    return changed.select(key, F.col(value).alias("value"), F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def cross_domain(evidence: DataFrame, key: str | list[str], kinds: tuple[str, ...], kind: str = "source_type") -> DataFrame:
    """Keys with evidence of every kind, and how much of each."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in kinds]
    got = evidence.groupBy(*([key] if isinstance(key, str) else key)).agg(*counts)
    for k in kinds:
        got = got.where(F.col(f"n_{k.lower()}") > 0)
    return got
