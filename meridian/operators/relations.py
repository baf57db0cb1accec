"""Relationship confidence: accrual, decay, pruning and entity merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("a", "b", "type", "client_id")
#: First sight counts 0.6 of the source's trust, every further evidence 0.2, capped (fixed values).
FIRST, MORE, CAP = 0.6, 0.2, 0.98


def accrue(evidence: DataFrame) -> DataFrame:
    """``evidence`` (a, b, type, client_id, uid, ts, trust) to one row a relationship.

    The first evidence (by ts, uid) gives 0.6 of its trust, each later distinct uid 0.2 of its own,
    capped after each step; mentions count all rows, a null client never joins another row. As
    increments are not negative the capped sequence equals a capped sum, so nothing is collected:
    sums and a minimum are combined before the shuffle.
    """
    trusted = evidence.withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    keyed = trusted.where("client_id is not null")
    once = keyed.groupBy(*KEY, "uid").agg(F.min(F.struct("ts", "trust")).alias("first"), F.count("*").alias("rows"), F.max("ts").alias("last"))
    total = once.groupBy(*KEY).agg(F.min(F.struct("first.ts", "uid", "first.trust")).alias("f"), F.sum(F.round(F.col("first.trust"), 9)).alias("t"), F.count("*").alias("evidence_count"), F.sum("rows").alias("mention_count"), F.max("last").alias("last_confirmed"))
    confidence = F.least(F.lit(CAP), (FIRST - MORE) * F.col("f.trust") + MORE * F.col("t"))
    grouped = total.select(*KEY, F.when(F.col("evidence_count") == 1, FIRST * F.col("f.trust")).otherwise(confidence).alias("confidence"), "evidence_count", "mention_count", F.col("f.ts").alias("first_observed"), "last_confirmed")
    single = trusted.where("client_id is null").select(*KEY, (FIRST * F.col("trust")).alias("confidence"), F.lit(1).cast("long").alias("evidence_count"), F.lit(1).cast("long").alias("mention_count"), F.col("ts").alias("first_observed"), F.col("ts").alias("last_confirmed"))
    return grouped.unionByName(single)


def decay(edges: DataFrame, as_of) -> DataFrame:
    """Weak edges unconfirmed for seven days lose 0.1 once and their validity."""
    old = (F.col("confidence") < 0.5) & (F.col("last_confirmed") < as_of - F.expr("INTERVAL 7 DAYS")) & F.col("still_valid")
    old = F.coalesce(old, F.lit(False))
    return edges.withColumns({"confidence": F.when(old, F.greatest(F.col("confidence") - 0.1, F.lit(0.0))).otherwise(F.col("confidence")), "still_valid": F.col("still_valid") & ~old})


def prune(edges: DataFrame) -> DataFrame:
    """Edges that stay after the sweep."""
    gone = ((F.col("confidence") < 0.2) & ~F.col("still_valid")) | (F.col("confidence") < 0.1)
    return edges.where(~F.coalesce(gone, F.lit(False)))


def purge_weak(entities: DataFrame, edges: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Entities below 0.4 not seen for a day go, with every edge that touches them."""
    weak = (F.col("confidence") < 0.4) & (F.col("last_seen") < as_of - F.expr("INTERVAL 24 HOURS"))
    weak = F.coalesce(weak, F.lit(False))
    gone = entities.where(weak).select("entity_id")
    left = edges.join(gone.withColumnRenamed("entity_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("entity_id", "b"), "b", "left_anti")
    return entities.where(~weak), left.select(*edges.columns)


def merge_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges re-pointed by ``mapping`` (secondary, primary); edges that meet become one: the larger
    confidence, summed mentions. Self-loops that a merge makes go."""
    both = edges
    for side in ("a", "b"):
        to = mapping.select(F.col("secondary").alias(side), F.col("primary").alias(f"_{side}"))
        both = both.join(to, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return both.where("a <> b").groupBy("a", "b", "type").agg(F.max("confidence").alias("confidence"), F.sum("mention_count").alias("mention_count"))


def merge_entity_rows(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entity rows after a merge by ``mapping`` (secondary, primary): a primary gains the names and
    aliases of its secondaries as aliases and their refs (sets, sorted) and mentions (summed);
    secondaries go. Mappings whose primary is unknown change nothing; no primary is a secondary."""
    known = mapping.join(entities.select(F.col("entity_id").alias("primary")), "primary", "left_semi")
    gone = known.join(entities, F.col("secondary") == F.col("entity_id"))
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array()))
    extra = gone.select(F.col("primary").alias("entity_id"), names.alias("_names"), F.coalesce("uir_refs", F.array()).alias("_refs"), "mention_count")
    gains = extra.groupBy("entity_id").agg(F.flatten(F.collect_set("_names")).alias("_names"), F.flatten(F.collect_set("_refs")).alias("_refs"), F.sum("mention_count").alias("_n"))
    left = entities.join(known.select(F.col("secondary").alias("entity_id")), "entity_id", "left_anti").join(gains, "entity_id", "left")
    joined = lambda mine, theirs: F.when(F.col(theirs).isNull(), F.col(mine)).otherwise(F.array_sort(F.array_union(F.coalesce(mine, F.array()), theirs)))
    kind = entities.schema["mention_count"].dataType
    return left.withColumns({"aliases": joined("aliases", "_names"), "uir_refs": joined("uir_refs", "_refs"), "mention_count": (F.col("mention_count") + F.coalesce("_n", F.lit(0))).cast(kind)}).select(*entities.columns)
