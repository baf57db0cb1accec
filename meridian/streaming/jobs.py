"""Structured Streaming jobs: rollup, hourly deduplication, queue and notifications."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridian.operators.relations import CAP, FIRST, KEY, MORE


def hourly_rollup(tracks: DataFrame, late: str = "3 hours", limit: float = 0.7) -> DataFrame:
    """The hourly anomaly aggregate as a stream; rows later than ``late`` are dropped."""
    timed = tracks.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    got = timed.groupBy(F.window("time", "1 hour")).agg(F.count_if(F.col("anomaly_score") > limit).alias("anomaly_count"), F.avg("anomaly_score").alias("avg_score"))
    return got.select(F.col("window.start").alias("bucket"), "anomaly_count", "avg_score")


def hourly_first(tracks: DataFrame, key: str, late: str = "3 hours") -> DataFrame:
    """At most one row of a key in a clock hour, state bounded by the watermark."""
    timed = tracks.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    return timed.withColumn("hour", F.date_trunc("hour", "time")).withColumn("slot", F.window("time", "1 hour")["end"]).dropDuplicatesWithinWatermark([key, "hour"]).drop("slot")


def first_by_hash(records: DataFrame) -> DataFrame:
    """Records of a stream whose content hash no earlier one had; those without a hash all pass. The
    state is one hash a record, as in a table with a unique index."""
    hashed = records.where("content_hash is not null").dropDuplicates(["content_hash"])
    return hashed.unionByName(records.where("content_hash is null"))


def running_counts(seen: DataFrame, key: str, time: str) -> DataFrame:
    """Per key of a stream the rows so far and their newest time: keyed state of the engine."""
    return seen.groupBy(key).agg(F.count("*").alias("mention_count"), F.max(time).alias("last_seen"))


def accrual(evidence: DataFrame) -> DataFrame:
    """``relations.accrue`` as a stream: (a, b, type, client_id, confidence, evidence_count,
    mention_count) of every relationship that a batch touches.

    State: confidence, both counts and the uids that counted. Within a batch evidence counts by time
    and uid; over batches, by arrival. Rows without a client are left to the batch job."""
    rows = evidence.where("client_id is not null").select(*KEY, F.col("uid").cast("string").alias("uid"), "ts", F.coalesce("trust", F.lit(0.5)).alias("trust"))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        confidence, mentions, uids = state.get if state.exists else (None, 0, [])
        counted = set(uids)
        for row in pd.concat(list(frames)).sort_values(["ts", "uid"]).itertuples(index=False):
            mentions += 1
            if row.uid not in counted:
                counted.add(row.uid)
                confidence = FIRST * row.trust if confidence is None else min(CAP, confidence + MORE * row.trust)
        state.update((confidence, mentions, sorted(counted)))
        yield pd.DataFrame([(*key, confidence, len(counted), mentions)], columns=[*KEY, "confidence", "evidence_count", "mention_count"])

    out = "a string, b string, type string, client_id string, confidence double, evidence_count long, mention_count long"
    return rows.groupBy(*KEY).applyInPandasWithState(fold, out, "confidence double, mentions long, uids array<string>", "update", GroupStateTimeout.NoTimeout)


def queue_rows(records: DataFrame) -> DataFrame:
    """The analysis-queue row that each new record causes; ids are the record's, so replays agree."""
    return records.select(F.concat(F.lit("q-"), F.col("uid").cast("string")).alias("queue_id"), F.col("uid").alias("uir_uid"), F.lit("NEW_UIR").alias("trigger_type"), F.coalesce("priority", F.lit("NORMAL")).alias("priority"), F.lit("PENDING").alias("status"), "domain", "client_id")


def notification(records: DataFrame) -> DataFrame:
    """(uid, payload): the JSON that subscribers get; null fields are kept, no place is null."""
    geo = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("lat", "lon"))
    body = F.struct("uid", "source_type", F.coalesce("priority", F.lit("NORMAL")).alias("priority"), "domain", F.col("content_headline").alias("headline"), geo.alias("geo"))
    return records.select("uid", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def routed(records: DataFrame) -> DataFrame:
    """(topic, uid): record ids by source type, and alerts once more."""
    by_type = records.select(F.concat(F.lit("records."), F.lower("source_type")).alias("topic"), "uid")
    alerts = records.where("priority in ('CRITICAL', 'HIGH')").select(F.lit("alerts").alias("topic"), "uid")
    return by_type.unionByName(alerts)


def claim_order(queue: DataFrame) -> DataFrame:
    """Pending jobs, CRITICAL first and then by age; HIGH is not preferred."""
    return queue.where("status = 'PENDING'").orderBy((F.col("priority") == "CRITICAL").desc(), "created_at", "queue_id")


def claim(queue: DataFrame, worker: int, workers: int) -> DataFrame:
    """The pending jobs of one of ``workers``, in claim order, marked as theirs: jobs are dealt by a
    hash of their id, so no two workers claim the same one."""
    mine = queue.where(F.pmod(F.xxhash64(F.col("queue_id").cast("string")), F.lit(workers)) == worker)
    return claim_order(mine).withColumns({"status": F.lit("PROCESSING"), "assigned_agent": F.lit(f"analyst-{worker}")})


def to_folder(rows: DataFrame, out: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Writes each batch below ``out`` in a folder of its id; a replayed batch overwrites itself."""
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, out: str, keys: list[str]) -> DataFrame:
    """The newest row a key of what ``to_folder`` wrote: the view that a refresh shows."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def stop_on_signals(queries: list[StreamingQuery]) -> None:
    """Stops the queries on SIGINT and SIGTERM; the checkpoint keeps what they have done."""

    def stop(*_):
        for q in queries:
            q.stop()

    for name in (signal.SIGINT, signal.SIGTERM):
        signal.signal(name, stop)


def start_fusion(records: DataFrame, fuse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``fuse`` on every micro-batch and writes its rows, the queue and the notifications
    below ``out``, in a folder of the batch id: a replayed batch overwrites itself. One query owns a
    job exclusively, so no job is claimed twice."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for name, rows in (("fused", fuse(df)), ("queue", queue_rows(df)), ("notifications", notification(df))):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            df.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def job_status(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """DONE or FAILED with a message for each job of a batch."""
    failed = failures.select("queue_id", "error_message")
    return jobs.join(failed, "queue_id", "left").withColumn("status", F.when(F.col("error_message").isNull(), "DONE").otherwise("FAILED"))


def reset_failed(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == "FAILED", "PENDING").otherwise(F.col("status")))


def retain(df: DataFrame, time: str, as_of, keep: str) -> DataFrame:
    """Rows younger than a retention interval such as ``INTERVAL 90 DAYS``."""
    return df.where(F.col(time) >= as_of - F.expr(keep))
