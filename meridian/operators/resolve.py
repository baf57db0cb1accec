"""Entity resolution: candidates, decision, counters, new entities and borrowed places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian import models
from meridian.functions import geo, vector
from meridian.operators import vectors

#: Similarity to resolve, to accept unverified, and the distance veto in metres.
RESOLVE, SURE, VETO_M = 0.45, 0.85, 100_000.0


def decide(candidates: DataFrame) -> DataFrame:
    """Adds ``best_id`` and ``best_similarity`` to mentions with a lexical candidate (lex_id,
    lex_sim), a semantic one (sem_id, sem_sim, sem_distance_m) and ``verified``.

    A lexical hit counts only with a non-null, non-zero similarity. A semantic one needs more than
    0.45, no distance over 100 km (null never vetoes) and below 0.85 verification; it wins only if
    strictly more similar. Below the threshold nothing is resolved.
    """
    lex = F.when(F.coalesce("lex_sim", F.lit(0.0)) != 0, F.col("lex_sim"))
    near = ~F.coalesce(F.col("sem_distance_m") > VETO_M, F.lit(False))
    sure = (F.col("sem_sim") >= SURE) | F.coalesce("verified", F.lit(False))
    sem = F.when((F.col("sem_sim") > RESOLVE) & near & sure, F.col("sem_sim"))
    wins = sem.isNotNull() & (lex.isNull() | (sem > lex))
    best = F.when(wins, sem).otherwise(lex)
    return candidates.withColumns({"best_similarity": F.when(best > RESOLVE, best), "best_id": F.when(best > RESOLVE, F.when(wins, F.col("sem_id")).otherwise(F.col("lex_id")))})


def deltas(resolved: DataFrame) -> DataFrame:
    """(entity_id, mentions, uir_refs) to be added to resolved entities."""
    hit = resolved.where("best_id is not null")
    return hit.groupBy(F.col("best_id").alias("entity_id")).agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("uid")).alias("uir_refs"))


#: Confidence of an entity that a mention creates (fixed value).
NEW_CONFIDENCE = 0.3


def lexical(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, lex_id, lex_sim) of ``names`` (name, embedding): the least entity whose name is equal
    apart from case, or of which the name is an alias, of any type."""
    by_name = entities.select(F.lower("name").alias("key"), F.lit(True).alias("folded"), "entity_id", F.col("embedding").alias("theirs"))
    by_alias = entities.select(F.explode("aliases").alias("key"), F.lit(False).alias("folded"), "entity_id", F.col("embedding").alias("theirs"))
    keys = by_name.unionByName(by_alias).where("key is not null")
    asked = names.select("name", "embedding", F.explode(F.array(F.struct(F.lower("name").alias("key"), F.lit(True).alias("folded")), F.struct(F.col("name").alias("key"), F.lit(False).alias("folded")))).alias("k")).select("name", "embedding", "k.*")
    hits = asked.join(keys, ["key", "folded"])
    best = hits.groupBy("name").agg(F.min("entity_id").alias("lex_id"), F.min_by(F.struct("embedding", "theirs"), "entity_id").alias("v"))
    return best.select("name", "lex_id", vector.cosine(F.col("v.embedding"), F.col("v.theirs")).alias("lex_sim"))


def resolve_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mentions`` (uid, position, name, type, embedding, lon, lat: the record's place or null) with
    ``entity_id``, ``similarity`` and ``created``.

    ``entities``: (entity_id string, name, entity_type, aliases, embedding, lon, lat). A name is
    looked up once, however often it is mentioned. Mentions without a vector are skipped. What
    resolves to nothing becomes an entity named by the hash of its lower-cased name, one for all
    mentions of that name in the batch. Candidates are those of the snapshot: entities that this
    batch creates resolve only mentions of the same name."""
    known = mentions.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0).withColumn("type", F.when(F.col("type") == "GPE", "LOCATION").otherwise(F.col("type")))
    names = known.groupBy("name").agg(F.first("embedding").alias("embedding"))
    typed = known.groupBy("name", "type").agg(F.first("embedding").alias("query")).withColumn("query_id", F.sha2(F.concat_ws("\x00", "type", "name"), 256))
    near = vectors.nearest_blocked(typed.withColumnRenamed("type", "entity_type"), entities.where("embedding is not null"), "entity_type")
    place = entities.select(F.col("entity_id").alias("sem_id"), F.col("name").alias("sem_name"), F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat"))
    semantic = typed.select("query_id", "name", "type").join(near.select("query_id", F.col("entity_id").alias("sem_id"), F.col("similarity").alias("sem_sim")), "query_id").join(place, "sem_id")
    semantic = semantic.select("name", "type", "sem_id", "sem_sim", "e_lon", "e_lat", models.same_entity(F.col("name"), F.col("sem_name")).alias("verified"))
    asked = known.join(lexical(names, entities), "name", "left").join(semantic, ["name", "type"], "left")
    asked = asked.withColumn("sem_distance_m", geo.haversine_m(F.col("lon"), F.col("lat"), F.col("e_lon"), F.col("e_lat")))
    decided = decide(asked)
    new = F.concat(F.lit("new-"), F.substring(F.sha2(F.lower("name"), 256), 1, 32))
    return decided.select(*known.columns, F.coalesce("best_id", new).alias("entity_id"), F.col("best_similarity").alias("similarity"), F.col("best_id").isNull().alias("created"))


def created_entities(resolved: DataFrame) -> DataFrame:
    """The entities that a batch creates: name, type and place of the first mention (by uid, then
    position), all mentions counted."""
    first = F.min(F.struct("uid", "position", "name", "type", "lon", "lat")).alias("_f")
    made = resolved.where("created").groupBy("entity_id").agg(first, F.count("*").alias("mention_count"), F.array_sort(F.collect_set("uid")).alias("uir_refs"))
    return made.select("entity_id", F.col("_f.name").alias("name"), F.col("_f.type").alias("entity_type"), F.lit(NEW_CONFIDENCE).alias("confidence"), "mention_count", "uir_refs", F.col("_f.lon").alias("lon"), F.col("_f.lat").alias("lat"))


def borrowed_places(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """(uid, lon, lat) for records without a place: that of the first mention, in order, whose
    known entity has one."""
    homeless = resolved.where("not created and (lon is null or lat is null)").select("uid", "position", "entity_id")
    placed = entities.where("lon is not null and lat is not null").select("entity_id", "lon", "lat")
    first = F.min(F.struct("position", "entity_id", "lon", "lat")).alias("_p")
    return homeless.join(placed, "entity_id").groupBy("uid").agg(first).select("uid", "_p.lon", "_p.lat")
