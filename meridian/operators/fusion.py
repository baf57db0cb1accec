"""The fusion job and its parts: mentions, co-mention relations, enrichment, feedback, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian import models
from meridian.operators import graph, relations, resolve, spatial
from meridian.operators.clusters import cluster_rows, cluster_updates, leader_clusters
from meridian.schemas import GLOBAL_CLIENT


#: So many names of a gazetteer are sent to every task.
SMALL_NAMES = 500_000


def mentions(records: DataFrame, gazetteer: DataFrame, text: str = "content_raw") -> DataFrame:
    """(uid, entity_id, position): first mention of each one-word gazetteer name (name, entity_id)
    in a record, by an equi-join on its lower-cased words. Words that are no name are dropped where
    they are read, so that only names are shuffled; a gazetteer beyond what is broadcast by itself
    is joined by a shuffle."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    at = records.select("uid", F.posexplode(words).alias("position", "word")).where("word <> ''")
    names = gazetteer.select(F.lower("name").alias("word"), "entity_id")
    known = names.select("word").distinct()
    known = F.broadcast(known) if known.limit(SMALL_NAMES + 1).count() <= SMALL_NAMES else known
    first = at.join(known, "word", "left_semi").groupBy("uid", "word").agg(F.min("position").alias("position"))
    return first.join(names, "word").select("uid", "entity_id", "position")


def co_mentions(found: DataFrame, span: int = 3) -> DataFrame:
    """(uid, a, b): entities whose first mentions follow each other within ``span`` mentions of one
    record, in order of position: linear in the mentions, not their square."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("uid").orderBy("position", "entity_id")
    nxt = F.array(*(F.lead("entity_id", k).over(w) for k in range(1, span + 1)))
    pairs = found.withColumn("n", nxt).select("uid", F.col("entity_id").alias("a"), F.explode(F.array_compact("n")).alias("b"))
    return pairs.where("a <> b").distinct()


def evidence_of(pairs: DataFrame, records: DataFrame, sources: DataFrame, predicate: str = "ASSOCIATED_WITH") -> DataFrame:
    """Evidence rows of co-mentions: a predicate outside the vocabulary is dropped, the trust is the
    source's, 0.5 where unknown."""
    if predicate not in models.VOCABULARY:
        return pairs.limit(0)
    r = records.join(sources, "source_name", "left").select("uid", "client_id", F.col("created_at").alias("ts"), F.coalesce("trust_score", F.lit(0.5)).alias("trust"))
    return pairs.join(r, "uid").select("a", "b", F.lit(predicate).alias("type"), "client_id", "uid", "ts", "trust")


def fuse(jobs: DataFrame, records: DataFrame, gazetteer: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch of claimed jobs (queue_id, uir_uid): statuses, and accrued relationships. A job
    without its record fails with a message."""
    known = records.select(F.col("uid").alias("uir_uid"), F.lit(True).alias("found"))
    status = jobs.join(known, "uir_uid", "left").select("queue_id", F.when(F.col("found"), "DONE").otherwise("FAILED").alias("status"), F.when(F.col("found").isNull(), "UIR record missing").alias("error_message"))
    mine = records.join(jobs.select(F.col("uir_uid").alias("uid")).distinct(), "uid", "left_semi")
    pairs = co_mentions(mentions(mine, gazetteer))
    return status, relations.accrue(evidence_of(pairs, mine, sources))


def in_vocabulary(relations_: DataFrame, predicate: str = "predicate") -> DataFrame:
    """Rows whose predicate is one of the vocabulary's verbs, exactly."""
    return relations_.where(F.col(predicate).isin(*sorted(models.VOCABULARY)))


def fusion_job(queue: DataFrame, records: DataFrame, entities: DataFrame, clusters: DataFrame, missions: DataFrame, sources: DataFrame, gazetteer: DataFrame, embed=None, metres: float = 50_000.0, similar: float = 0.35) -> dict[str, DataFrame]:
    """One batch of the whole fusion job over all pending rows of ``queue`` (queue_id, uir_uid, status).

    ``records``: uid, created_at, client_id, domain, priority, source_name, mission_id,
    content_headline, content_raw, lon, lat. ``entities``: as in ``resolve.resolve_mentions``.
    ``clusters``: as in ``leader_clusters``, with status, uir_count and updated_at. ``gazetteer``:
    (name, type) of one-word names. ``embed``: a function of a text column to a vector column.

    Gives ``queue`` (queue_id, status, error_message, result_cluster), ``records`` (uid, cluster_id,
    entities, lon, lat), ``new_clusters``, ``clusters`` (the old ones, counted on), ``mentions``
    (resolved), ``new_entities`` and ``relations`` (accrued co-mentions). A job whose record is
    missing fails. Intermediate results are written once.
    """
    embed = embed or models.embedder()
    jobs = queue.where("status = 'PENDING'").select("queue_id", "uir_uid")
    wanted = jobs.select(F.col("uir_uid").alias("uid")).distinct()
    mission = missions.select(F.col("focus_id").alias("mission_id"), F.lower("category").alias("_category"), F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower).alias("_keywords"))
    mine = records.join(wanted, "uid", "left_semi").join(mission, "mission_id", "left")
    low = F.lower(F.coalesce("content_headline", F.lit("")))
    hit = F.exists(F.coalesce("_keywords", F.array().cast("array<string>")), lambda k: F.contains(F.col("_low"), k)) | F.coalesce(F.contains(F.col("_low"), F.col("_category")), F.lit(False))
    mine = mine.withColumn("_low", low).withColumn("keyword_hit", hit).withColumn("embedding", embed(F.col("_low")).cast("array<double>"))
    mine = graph._cut(mine.drop("_low", "_category", "_keywords").withColumn("uid", F.col("uid").cast("string")))
    places = entities.where("entity_type = 'LOCATION'").select("entity_id", "lon", "lat")
    anchors = spatial.nearest(mine.select("uid", "lon", "lat"), places, "uid", "entity_id", 100_000)
    cities = anchors.join(entities.select("entity_id", F.col("name").alias("city")), "entity_id").select("uid", "city")
    assigned = graph._cut(leader_clusters(mine, metres, similar, existing=clusters.where("status = 'ACTIVE'")))
    # entities: mentions in the order of the text, resolved against the snapshot
    words = gazetteer.withColumn("entity_id", F.concat_ws("\x00", "name", "type"))
    said = mentions(mine, words).select("uid", "position", F.split("entity_id", "\x00")[0].alias("name"), F.split("entity_id", "\x00")[1].alias("type"))
    named = said.select("name").distinct().withColumn("embedding", embed(F.col("name")).cast("array<double>"))
    asked = said.join(named, "name").join(mine.select("uid", "lon", "lat"), "uid")
    found = graph._cut(resolve.resolve_mentions(asked, entities))
    borrowed = resolve.borrowed_places(found, entities).withColumnsRenamed({"lon": "b_lon", "lat": "b_lat"})
    names = found.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("entities"))
    written = mine.select("uid", "lon", "lat").join(assigned.select("uid", "cluster_id"), "uid", "left").join(names, "uid", "left").join(borrowed, "uid", "left")
    written = written.select("uid", "cluster_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("lon", "b_lon").alias("lon"), F.coalesce("lat", "b_lat").alias("lat"))
    done = jobs.withColumn("uid", F.col("uir_uid").cast("string")).join(written.select("uid", F.col("cluster_id").alias("result_cluster"), F.lit(True).alias("_hit")), "uid", "left")
    status = done.select("queue_id", F.when(F.col("_hit"), "DONE").otherwise("FAILED").alias("status"), F.when(F.col("_hit").isNull(), "UIR record missing").alias("error_message"), "result_cluster")
    pairs = co_mentions(found.select("uid", "entity_id", "position"))
    return {
        "queue": status, "records": written, "mentions": found,
        "new_clusters": cluster_rows(mine.join(cities, "uid", "left"), assigned),
        "clusters": cluster_updates(clusters, mine, assigned),
        "new_entities": resolve.created_entities(found),
        "relations": relations.accrue(evidence_of(pairs, mine, sources)),
    }


def without_rejected(edges: DataFrame, feedback: DataFrame) -> DataFrame:
    """Edges whose (subject, predicate, object) no client rejected."""
    bad = feedback.where(F.startswith("feedback_type", F.lit("REJECTED"))).select(F.col("original_subject").alias("a"), F.col("original_predicate").alias("type"), F.col("original_object").alias("b")).distinct()
    return edges.join(bad, ["a", "type", "b"], "left_anti")


def enrich(entities: DataFrame, found: DataFrame) -> DataFrame:
    """A snapshot with enrichment results (entity_id, description, aliases): description replaced,
    aliases appended, duplicates kept, confidence 0.8."""
    new = found.select("entity_id", F.col("description").alias("_d"), F.coalesce("aliases", F.array()).alias("_a"), F.lit(True).alias("_hit"))
    both = entities.join(new, "entity_id", "left")
    hit = F.col("_hit").isNotNull()
    return both.withColumns({"description": F.when(hit, F.col("_d")).otherwise(F.col("description")), "aliases": F.when(hit, F.concat(F.coalesce("aliases", F.array()), "_a")).otherwise(F.col("aliases")), "confidence": F.when(hit, F.lit(0.8)).otherwise(F.col("confidence"))}).drop("_d", "_a", "_hit")


def backfill_embeddings(entities: DataFrame, size: int = 500) -> DataFrame:
    """Embeddings for the first ``size`` entities without one: text ``name: description``."""
    todo = entities.where("embedding is null").orderBy("entity_id").limit(size)
    return todo.withColumn("embedding", models.embedder()(F.concat_ws(": ", "name", "description")))


def deactivate(missions: DataFrame) -> DataFrame:
    return missions.withColumn("is_active", F.lit(False))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, how: str = "delete") -> DataFrame:
    """Children whose parent is gone are deleted, or lose the reference (``how='null'``)."""
    alive = parents.select(F.col(parent_key).alias(child_key)).distinct()
    if how == "delete":
        return children.join(alive, child_key, "left_semi")
    marked = children.join(alive.withColumn("_alive", F.lit(True)), child_key, "left")
    return marked.withColumn(child_key, F.when(F.col("_alive"), F.col(child_key))).drop("_alive").select(*children.columns)


def derived_records(clusters: DataFrame, least: int = 3) -> DataFrame:
    """A DERIVED record for each active cluster of enough records."""
    big = clusters.where((F.col("uir_count") >= least) & (F.col("status") == "ACTIVE"))
    return big.select(F.sha2(F.concat(F.lit("derived:"), "cluster_id"), 256).alias("uid"), F.lit("DERIVED").alias("source_type"), F.concat("domain", F.lit(" activity: "), F.col("uir_count").cast("string"), F.lit(" reports")).alias("content_headline"), "lon", "lat", F.coalesce("client_id", F.lit(GLOBAL_CLIENT)).alias("client_id"))


def mixed_pattern(edges: DataFrame, root: str, labels: list[str], last: str) -> DataFrame:
    """Nodes one or two steps from ``root`` over ``labels`` and then one step over ``last``."""
    both = graph.symmetric(edges)
    step = both.where(F.col("type").isin(labels)).select("src", "dst").distinct()
    one = step.where(F.col("src") == root).select(F.col("dst").alias("node"))
    two = one.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
    end = edges.where(F.col("type") == last).select(F.col("a").alias("node"), F.col("b").alias("target"))
    return one.union(two).distinct().join(end, "node").select("node", "target").distinct()


def density_groups(points: DataFrame, metres: float, least: int, id_col: str = "uid", rounds: int = 60) -> DataFrame:
    """DBSCAN: (id_col, group_id, core). A core point has ``least`` points (itself included) within
    ``metres``; cores that reach each other share the smallest core's id; a border point goes to its
    nearest core's group; others are noise with a null group."""
    # rows at one place are one place of that weight: pairs are of places, however many rows they have
    rows = points.select(F.col(id_col).alias("uid"), "lon", "lat")
    spots = rows.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min("uid").alias("i"), F.count("*").alias("w"))
    # the table is small and its pairs are many: it is kept in as many files as a shuffle has parts
    spots = graph._cut(spots.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i"))
    left = spots.select("i", "lon", "lat")
    near = graph._cut(spatial.radius_join(left, left.withColumnRenamed("i", "j"), metres).select("i", "j", "distance_m"))
    weights = spots.select(F.col("i").alias("j"), "w")
    cores = near.join(weights, "j").groupBy("i").agg(F.sum("w").alias("n")).where(F.col("n") >= least).select("i")
    links = near.join(cores, "i").join(cores.withColumnRenamed("i", "j"), "j").select("i", "j")
    label = graph._cut(graph.smallest_label(cores, links, rounds))
    border = near.join(label.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min(F.struct("distance_m", "j", "g")).alias("b"))
    found = spots.join(label, "i", "left").join(border, "i", "left").select("lon", "lat", F.coalesce("g", "b.g").alias("group_id"), F.col("g").isNotNull().alias("core"))
    return rows.join(found, ["lon", "lat"], "left").select(F.col("uid").alias(id_col), "group_id", F.coalesce("core", F.lit(False)).alias("core"))


def session_start(clusters: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """One row: open jobs, unread critical clusters and the last day's clusters."""
    jobs = queue.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    seen = clusters.agg(F.count_if((F.col("priority") == "CRITICAL") & (F.col("status") == "ACTIVE")).alias("critical"), F.count_if(F.col("updated_at") > as_of - F.expr("INTERVAL 24 HOURS")).alias("last_day"))
    return jobs.crossJoin(seen)
