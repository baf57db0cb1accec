"""Sources read back from files, streams run to their end, and the tools, as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian import models
from meridian.functions import text as tx
from meridian.operators import fusion, graph, ingest
from meridian.plans import fixtures as fx
from meridian.plans.analytics import _hav
from meridian.plans.registry import query
from meridian.sources import readers
from meridian.streaming import jobs
from meridian.tools import Tools

_NOW = f"TIMESTAMP '{fx.AS_OF}'"

# -- sources: rows of a table written in a feed's format and read by its reader -------------------


def _folder(s, name: str) -> str:
    return f"{graph.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _lines(s, df: DataFrame, name: str) -> str:
    """Rows of one string column, in order of a small table, as one text file."""
    path = _folder(s, name)
    df.coalesce(1).write.text(path)
    return path


_K = "n_nationkey"


@query("source_geojson", f"SELECT 'q' || {_K} AS usgs_id, CASE WHEN {_K} % 5 > 0 THEN {_K} / 3.0::DOUBLE END AS magnitude, n_name AS place, {_K} * 2.5::DOUBLE AS lon, {_K} - 10.0::DOUBLE AS lat, {_K} % 2 = 1 AS tsunami FROM nation WHERE {_K} % 7 <> 3")
def source_geojson(s, d):
    k = F.col(_K)
    # a seventh of the features has no coordinates and is left out by the reader
    coordinates = F.when(k % 7 != 3, F.array(k * 2.5, k - 10.0, F.lit(8.0)))
    f = F.struct(F.concat(F.lit("q"), k).alias("id"), F.struct(F.when(k % 5 > 0, k / 3.0).alias("mag"), F.col("n_name").alias("place"), (k * 1000).cast("long").alias("time"), (k % 2).alias("tsunami")).alias("properties"), F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    feed = fx.read(s, d, "nation").agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("value"))
    return readers.seismic_feed(s, _lines(s, feed, "geojson")).select("usgs_id", "magnitude", "place", "lon", "lat", "tsunami")


@query("source_rss", "SELECT 'http://news.example/' || n_nationkey AS source_url, n_name AS title, CASE WHEN n_nationkey % 3 > 0 THEN 'about ' || n_name END AS description FROM nation WHERE n_nationkey % 4 <> 2")
def source_rss(s, d):
    k = F.col(_K)
    about = F.when(k % 3 > 0, F.concat(F.lit("<description>about "), "n_name", F.lit("</description>"))).otherwise("")
    link = F.when(k % 4 != 2, F.concat(F.lit("<link>http://news.example/"), k, F.lit("</link>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit("</title>"), link, about, F.lit("</item>"))
    items = fx.read(s, d, "nation").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    return readers.rss_feed(s, _lines(s, items, "rss")).select("source_url", "title", "description")


@query("source_text_folder", "SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region")
def source_text_folder(s, d):
    names = fx.read(s, d, "region").coalesce(1).sortWithinPartitions("r_regionkey").select(F.col("r_name").alias("value"))
    return readers.text_documents(s, _lines(s, names, "texts")).select("text")


@query("source_gazetteer", "SELECT 'geo:' || c_custkey AS entity_id, c_name AS name, 'City in C' || (c_nationkey % 10) || '. Population: ' || (c_custkey * 100) AS description, round(c_nationkey * 7.0::DOUBLE - 90, 4) AS lon, round(c_nationkey * 3.0::DOUBLE - 40, 4) AS lat, c_custkey * 100 AS population FROM customer")
def source_gazetteer(s, d):
    n = F.col("c_nationkey")
    cols = [F.col("c_custkey"), F.col("c_name"), F.col("c_name"), F.concat("c_name", F.lit(",alias")), n * 3.0 - 40, n * 7.0 - 90, F.lit("P"), F.lit("PPL"), F.concat(F.lit("C"), n % 10), *[F.lit("")] * 5, F.col("c_custkey") * 100, F.lit(""), F.lit("1"), F.lit("UTC"), F.lit("2024-01-01")]
    path = _folder(s, "gazetteer")
    fx.read(s, d, "customer").select(F.concat_ws("\t", *(c.cast("string") for c in cols)).alias("value")).write.text(path)
    return readers.geonames(s, path).select("entity_id", "name", "description", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "population")


@query("source_kb_entities", "SELECT 'Q' || s_suppkey AS qid, s_name AS name, CASE WHEN s_suppkey % 2 = 1 THEN 'about' END AS description FROM supplier WHERE s_suppkey % 10 > 0")
def source_kb_entities(s, d):
    k = F.col("s_suppkey")
    path = _folder(s, "kb")
    fx.read(s, d, "supplier").select(F.concat(F.lit("Q"), k, F.lit("\t"), F.when(k % 10 > 0, F.col("s_name")).otherwise(" "), F.when(k % 2 == 1, "\tabout").otherwise("")).alias("value")).write.text(path)
    return readers.kb_entities(s, path).select("qid", "name", "description")


_CODES = ("P17", "P131", "P999", "P361", "P108")
_KINDS = {c: readers.PROPERTIES[c] for c in _CODES if c in readers.PROPERTIES}


@query("source_kb_triples", f"SELECT 'S' || l_suppkey AS s, CASE l_orderkey % 5 {' '.join(f'''WHEN {i} THEN '{_KINDS[c]}' ''' for i, c in enumerate(_CODES) if c in _KINDS)} END AS type, 'P' || l_partkey AS o FROM lineitem WHERE l_orderkey % 5 <> {_CODES.index('P999')}")
def source_kb_triples(s, d):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_orderkey") % 5 + 1).cast("int"))
    path = _folder(s, "triples")
    fx.read(s, d, "lineitem").select(F.concat_ws("\t", F.concat(F.lit("S"), "l_suppkey"), code, F.concat(F.lit("P"), "l_partkey")).alias("value")).write.text(path)
    return readers.kb_triples(s, path).select("s", "type", "o")


@query("source_delimited", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_delimited(s, d):
    path = _folder(s, "csv")
    fx.read(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True, sep=";")
    return readers.delimited(s, path, "c_custkey bigint, c_name string, c_acctbal double", ";")


@query("source_indicators", "SELECT event_id, value FROM events WHERE event_id % 9 > 0")
def source_indicators(s, d):
    path = _folder(s, "json")
    # a ninth of the lines is malformed and dropped by the reader
    line = F.when(F.col("event_id") % 9 > 0, F.to_json(F.struct("event_id", "value"))).otherwise("{broken")
    fx.read(s, d, "events").select(line.alias("value")).write.text(path)
    return readers.indicators(s, path, "event_id bigint, value double")


@query("source_simulated", "SELECT 'FLIGHT' AS kind, * FROM (VALUES ('a00001', 48.1::DOUBLE, 11.5::DOUBLE), ('a00002', 51.0, 3.2), ('a00003', 40.4, -3.7)) t(id, lat, lon) UNION ALL SELECT 'VESSEL', * FROM (VALUES ('200000001', 51.9::DOUBLE, 4.1::DOUBLE), ('200000002', 37.9, 23.6), ('200000003', 60.4, 5.3)) t(id, lat, lon)")
def source_simulated(s, d):
    rows = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return rows(readers.simulated_flights(s), "FLIGHT", "icao24").unionByName(rows(readers.simulated_vessels(s), "VESSEL", "mmsi"))


@query("bulk_append", "SELECT entity_id, count(*) AS n FROM (SELECT 'S' || s_suppkey AS entity_id FROM supplier UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY entity_id")
def bulk_append(s, d):
    path = _folder(s, "bulk")
    rows = fx.read(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), "s_suppkey")
    rows.write.mode("append").parquet(path)
    rows.where("s_suppkey % 2 = 0").write.mode("append").parquet(path)
    return s.read.parquet(path).groupBy("entity_id").agg(F.count("*").alias("n"))


# -- streams: files read as a stream until they are used up ---------------------------------------


def _stream(s, d, name: str) -> DataFrame:
    # a pattern, as a path without one has to be a folder
    return s.readStream.schema(fx.read(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _ran(s, rows: DataFrame, name: str, mode: str) -> str:
    out = _folder(s, name)
    jobs.to_folder(rows, f"{out}/rows", f"{out}/checkpoint", mode).awaitTermination()
    return f"{out}/rows"


def _tracks(s, d) -> DataFrame:
    return _stream(s, d, "events").select(F.col("ts").alias("time"), F.col("user_id").cast("string").alias("icao24"), "event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("anomaly_score"))


@query("stream_hourly_rollup", fx.with_sql("flights", "SELECT date_trunc('hour', time) AS bucket, count(*) FILTER (anomaly_score > 0.7) AS anomaly_count, round(avg(anomaly_score), 6) AS avg_score FROM flights GROUP BY 1"))
def stream_hourly_rollup(s, d):
    out = _ran(s, jobs.hourly_rollup(_tracks(s, d), "40 days"), "rollup", "update")
    return jobs.latest(s, out, ["bucket"]).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "anomaly_count", F.round("avg_score", 6).alias("avg_score"))


@query("stream_hourly_first", fx.with_sql("flights", "SELECT DISTINCT icao24, date_trunc('hour', time) AS hour FROM flights"))
def stream_hourly_first(s, d):
    out = _ran(s, jobs.hourly_first(_tracks(s, d), "icao24", "40 days"), "first", "append")
    return s.read.parquet(out).select("icao24", F.col("hour").cast("timestamp_ntz").alias("hour"))


@query("stream_global_dedupe", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_global_dedupe(s, d):
    rows = _stream(s, d, "documents").select(F.sha2("text", 256).alias("content_hash"))
    return s.read.parquet(_ran(s, jobs.first_by_hash(rows), "dedupe", "append")).select("content_hash")


@query("stream_running_counts", "SELECT user_id, count(*) AS mention_count, max(ts) AS last_seen FROM events GROUP BY user_id")
def stream_running_counts(s, d):
    out = _ran(s, jobs.running_counts(_stream(s, d, "events").select("user_id", "ts"), "user_id", "ts"), "counts", "update")
    return jobs.latest(s, out, ["user_id"])


@query("stream_accrual", """WITH e AS (SELECT 'U' || (user_id % 40) AS a, 'K' || (user_id % 7) AS b, event_type AS type, 'global' AS client_id, event_id // 2 AS uid, ts, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS trust FROM events),
k AS (SELECT a, b, type, uid, min(ts) AS ts, arg_min(trust, ts) AS trust, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, type ORDER BY ts, CAST(uid AS VARCHAR)) AS i FROM k)
SELECT a, b, type, round(least(0.98, max(CASE WHEN i = 1 THEN 0.6 * trust END) + 0.2 * sum(CASE WHEN i > 1 THEN trust ELSE 0 END)), 6) AS confidence, count(*) AS evidence_count, sum(n)::BIGINT AS mention_count FROM r GROUP BY a, b, type""")
def stream_accrual(s, d):
    e = _stream(s, d, "events")
    u = F.col("user_id")
    evidence = e.select(F.concat(F.lit("U"), u % 40).alias("a"), F.concat(F.lit("K"), u % 7).alias("b"), F.col("event_type").alias("type"), F.lit("global").alias("client_id"), F.expr("event_id div 2").alias("uid"), "ts", F.least(F.col("value") / 500.0, F.lit(1.0)).alias("trust"))
    out = _ran(s, jobs.accrual(evidence), "accrual", "update")
    return jobs.latest(s, out, ["a", "b", "type"]).select("a", "b", "type", F.round("confidence", 6).alias("confidence"), "evidence_count", "mention_count")


@query("stream_signal_path", fx.with_sql("records", "SELECT 'q-' || uid AS queue_id, uid AS uir_uid, 'NEW_UIR' AS trigger_type, coalesce(priority, 'NORMAL') AS priority, 'PENDING' AS status FROM records"))
def stream_signal_path(s, d):
    """News to queue: records arrive as a stream; each causes one queue row and one notification."""
    out = _folder(s, "signals")
    source = _folder(s, "arrivals")
    fx.records(s, d).select("uid", "created_at", "source_type", "priority", "domain", "client_id", "content_headline", "lon", "lat").write.parquet(source)
    arrivals = s.readStream.schema(s.read.parquet(source).schema).parquet(source)
    jobs.start_fusion(arrivals, lambda df: df.select("uid"), out, f"{out}/checkpoint").awaitTermination()
    told = s.read.parquet(f"{out}/notifications").select("uid")
    return s.read.parquet(f"{out}/queue").join(told.withColumnRenamed("uid", "uir_uid"), "uir_uid", "left_semi").select("queue_id", "uir_uid", "trigger_type", "priority", "status")


@query("worker_claims", fx.with_sql("queue", "SELECT queue_id, 1 AS claims FROM queue WHERE status = 'PENDING'"))
def worker_claims(s, d):
    """Three workers claim at once: every pending job once."""
    q = fx.queue(s, d)
    got = jobs.claim(q, 0, 3).unionByName(jobs.claim(q, 1, 3)).unionByName(jobs.claim(q, 2, 3))
    return got.groupBy("queue_id").agg(F.count("*").cast("int").alias("claims"))


@query("retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def retention(s, d):
    return jobs.retain(fx.read(s, d, "events"), "ts", fx.as_of(), "INTERVAL 7 DAYS").select("event_id")


@query("seed_deck", "SELECT 'seed-' || substr(sha256(lower(name)), 1, 16) AS entity_id, name, entity_type, len(aliases)::INT AS n_aliases FROM (VALUES " + ", ".join(f"('{n}', '{t}', {list(a)}::VARCHAR[])" for n, t, a, _ in readers.SEEDS) + ") t(name, entity_type, aliases)")
def seed_deck(s, d):
    deck = readers.seed_deck(s)
    seeded = ingest.insert_if_absent(deck.union(deck), deck.where("false"), ["entity_id"], "name")
    return seeded.select("entity_id", "name", "entity_type", F.size("aliases").alias("n_aliases"))


@query("json_set", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS reason FROM events")
def json_set(s, d):
    e = fx.read(s, d, "events")
    props = tx.json_set(F.col("props"), "reason", F.col("event_type"))
    return e.select("event_id", F.get_json_object(props, "$.k").alias("k"), F.get_json_object(props, "$.reason").alias("reason"))


@query("text_fallback", fx.with_sql("records", "SELECT uid, CASE WHEN uid % 3 = 0 THEN content_headline WHEN content_raw <> '' THEN substr(content_raw, 1, 20) ELSE '' END AS shown FROM records"))
def text_fallback(s, d):
    r = fx.records(s, d)
    summary = F.when(F.col("uid") % 3 == 0, F.col("content_headline")).when(F.col("uid") % 3 == 1, "")
    return r.select("uid", tx.first_text(summary, F.substring("content_raw", 1, 20)).alias("shown"))


@query("graph_sync_batch", fx.with_sql("edges entities", "SELECT x.name AS subject, type AS predicate, y.name AS object FROM (SELECT * FROM edges ORDER BY edge_id, a, b, type, confidence LIMIT 1000) e JOIN entities x ON e.a = x.entity_id JOIN entities y ON e.b = y.entity_id GROUP BY ALL"))
def graph_sync_batch(s, d):
    # one batch: at most a thousand edges, no gate; ordered, so that it is the same batch
    batch = fx.edges(s, d).orderBy("edge_id", "a", "b", "type", "confidence").limit(1000)
    return graph.edge_view(batch, fx.entities(s, d).select("entity_id", "name"))


@query("compaction", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def compaction(s, d):
    path = _folder(s, "small-files")
    fx.read(s, d, "events").repartition(16).write.parquet(path)
    return ingest.compact(s, path, _folder(s, "compacted")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("entity_extraction")
def entity_extraction(s, d):
    found = models.extractor({"the": "CONCEPT", "que": "CONCEPT", "und": "GPE"})
    return fx.read(s, d, "documents").select("doc_id", F.explode(found("text")).alias("e")).groupBy("e.name", "e.type").agg(F.count("*").alias("n"))


# -- the whole fusion job --------------------------------------------------------------------------


def fusion_tables(s, d) -> dict[str, DataFrame]:
    """The fusion job's inputs: all records queued, places and organisations as entities."""
    from meridian.plans.composite import _NAMES
    from meridian.plans.resolution import _orgs

    orgs = _orgs(s, d)
    places = fx.entities(s, d).where("entity_type = 'LOCATION'").select("entity_id", "name", "entity_type", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("array<double>").alias("embedding"), "lon", "lat")
    records = fx.records(s, d)
    queue = records.select(F.col("uid").alias("queue_id"), F.when(F.col("uid") % 50 == 49, -F.col("uid")).otherwise(F.col("uid")).alias("uir_uid"), F.lit("PENDING").alias("status"))
    return {"queue": queue, "records": records, "entities": orgs.unionByName(places), "clusters": fx.clusters(s, d).withColumn("embedding", F.array(*[F.lit(0.125)] * 64)), "missions": fx.missions(s, d), "sources": fx.sources(s, d), "gazetteer": s.createDataFrame([(n, "ORGANIZATION") for n, _ in _NAMES], "name string, type string")}


@query("fusion_job", fx.with_sql("records", "SELECT uid AS queue_id, CASE WHEN uid % 50 = 49 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN uid % 50 = 49 THEN 'UIR record missing' END AS error_message, uid % 50 <> 49 AS clustered FROM records"))
def fusion_job(s, d):
    """The queue after the whole job; every record that was found has a cluster."""
    done = fusion.fusion_job(**fusion_tables(s, d), metres=2_000_000.0, similar=0.0)
    return done["queue"].select("queue_id", "status", "error_message", F.col("result_cluster").isNotNull().alias("clustered"))


@query("embedding_backfill")
def embedding_backfill(s, d):
    e = fx.entities(s, d).select("entity_id", "name", F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<double>").alias("embedding"))
    return fusion.backfill_embeddings(e).select("entity_id", F.size("embedding").alias("dimensions"))


# -- the tools -------------------------------------------------------------------------------------

_RECORDS = "tr AS (SELECT records.* EXCLUDE (content_raw, client_id), CASE WHEN domain IS NOT NULL AND lon IS NOT NULL THEN domain || '_' || client_id || '_' || CAST(floor(lon / 30) AS BIGINT) || '_' || CAST(floor(lat / 30) AS BIGINT) END AS cluster_id, uid % 5 = 0 AS historical FROM records)"


def _tools(s, d, as_of: str = fx.AS_OF) -> Tools:
    v = fx.read(s, d, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")
    first = [float(x) for x in v.where("uid = 0").first().embedding]
    place = F.col("domain").isNotNull() & F.col("lon").isNotNull()
    records = fx.records(s, d).withColumn("cluster_id", F.when(place, fx.cluster_cell())).withColumn("tags", F.when(F.col("uid") % 5 == 0, F.array(F.lit("historical"))).otherwise(F.array().cast("array<string>")))
    records = records.drop("client_id", "content_raw").join(v, "uid", "left")
    clusters = fx.clusters(s, d)
    from meridian.plans.resolution import _orgs

    vectors = _orgs(s, d).select("entity_id", "aliases", "embedding")
    queue = fx.queue(s, d)
    return Tools({
        "records": records, "clusters": clusters.drop("client_id"), "edges": fx.edges(s, d), "entities": fx.entities(s, d).join(vectors, "entity_id", "left"), "flights": fx.flights(s, d), "queue": queue,
        "tasks": queue.select("agent", "status", "created_at", F.when(F.col("status") == "DONE", F.col("created_at")).alias("completed_at")),
        "revisions": clusters.select("cluster_id", F.col("updated_at").alias("revised_at"), (F.col("uir_count") / 10.0).alias("new_confidence")),
        "digests": records.groupBy(F.date_trunc("day", "created_at").alias("period_end")).agg(F.count("*").alias("uir_count")).withColumns({"digest_type": F.lit("DAILY_BRIEF"), "digest_id": F.col("period_end").cast("string")}),
    }, as_of=F.lit(as_of).cast("timestamp_ntz"), embed=lambda _: first)


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@query("tool_entity_profile", fx.with_sql("entities edges", "+ e AS (SELECT * FROM entities WHERE name ILIKE '%Supplier#00000001%' ORDER BY entity_id LIMIT 1) SELECT entity_id, name, (SELECT count(*) FROM edges, e WHERE a = e.entity_id OR b = e.entity_id) AS relationship_count, (SELECT string_agg(confidence || '', ',' ORDER BY confidence DESC) FROM (SELECT round(edges.confidence * 50)::INT AS confidence FROM edges, e WHERE a = e.entity_id ORDER BY edges.confidence DESC, edge_id LIMIT 10)) AS surest FROM e"))
def tool_entity_profile(s, d):
    got = _tools(s, d).call("get_entity_profile", name="Supplier#00000001")
    surest = F.array_join(F.transform("relationships", lambda r: F.round(r["confidence"] * 50).cast("int").cast("string")), ",")
    return got.select("entity_id", "name", "relationship_count", surest.alias("surest"))


@query("tool_entities_semantic", f"SELECT 'S' || s_suppkey AS entity_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM supplier JOIN embeddings ON vec_id = s_suppkey, {_Q} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, entity_id LIMIT 10")
def tool_entities_semantic(s, d):
    return _tools(s, d).call("search_entities_semantic", query="any", entity_type="ORGANIZATION").select("entity_id", F.round("similarity", 6).alias("similarity"))


@query("tool_traverse", fx.with_sql("edges entities", "+ y AS (SELECT a AS src, b AS dst FROM edges WHERE type IN ('A', 'R') UNION SELECT b, a FROM edges WHERE type IN ('A', 'R')), r AS (SELECT entity_id FROM entities WHERE name = 'Supplier#000000003'), o AS (SELECT DISTINCT dst AS node FROM y, r WHERE src = r.entity_id AND dst <> r.entity_id), t AS (SELECT node, 1 AS distance FROM o UNION ALL SELECT DISTINCT y.dst, 2 FROM o JOIN y ON src = node WHERE y.dst NOT IN (SELECT node FROM o) AND y.dst NOT IN (SELECT entity_id FROM r)) SELECT node AS entity_id, name, distance::INT AS distance FROM t JOIN entities ON entity_id = node ORDER BY threat_score DESC, distance, entity_id LIMIT 50"))
def tool_traverse(s, d):
    return _tools(s, d).call("traverse_entity_graph", entity_name="Supplier#000000003", hops=2, relationship_types=["A", "R"]).select("entity_id", "name", "distance")


@query("tool_records_semantic", fx.with_sql("records", f"SELECT uid, round(sim, 6) AS similarity FROM (SELECT uid, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM records JOIN embeddings ON vec_id = uid, {_Q} WHERE created_at > {_NOW} - INTERVAL 30 DAY AND source_type IN ('OSINT', 'GEOINT') AND domain = 'MARITIME') WHERE sim > 0.02 ORDER BY sim DESC, uid LIMIT 20"))
def tool_records_semantic(s, d):
    return _tools(s, d).call("search_intelligence_semantic", query="any", source_types=["OSINT", "GEOINT"], domain="MARITIME", least=0.02).select("uid", F.round("similarity", 6).alias("similarity"))


@query("tool_records_spatial", fx.with_sql("records", f"SELECT uid, round(m / 1000, 3) AS distance_km FROM (SELECT uid, {_hav('10.0', '20.0', 'lon', 'lat')} AS m FROM records WHERE created_at > {_NOW} - INTERVAL 31 DAY AND source_type = 'SIGINT') WHERE m <= 4000000 ORDER BY m, uid LIMIT 50"))
def tool_records_spatial(s, d):
    return _tools(s, d).call("search_intelligence_spatial", lat=20.0, lon=10.0, radius_km=4000.0, days_back=31, source_type="SIGINT").select("uid", F.round("distance_km", 3).alias("distance_km"))


@query("tool_search_spatial", fx.with_sql("clusters records", f"SELECT kind, id, round(m / 1000, 3) AS distance_km FROM (SELECT 'CLUSTER' AS kind, cluster_id AS id, {_hav('10.0', '20.0', 'lon', 'lat')} AS m FROM clusters WHERE status = 'ACTIVE' UNION ALL SELECT 'RECORD', CAST(uid AS VARCHAR), {_hav('10.0', '20.0', 'lon', 'lat')} FROM records WHERE created_at > {_NOW} - INTERVAL 7 DAY) WHERE m <= 3000000 ORDER BY m, kind, id LIMIT 20"))
def tool_search_spatial(s, d):
    return _tools(s, d).call("search_spatial", lat=20.0, lon=10.0, radius_km=3000.0).select("kind", "id", F.round("distance_km", 3).alias("distance_km"))


_ONE = "MARITIME_c2_-4_1"


@query("tool_cluster_detail", fx.with_sql("records clusters", f"+ {_RECORDS} SELECT 'RECORD' AS kind, created_at AS at, CAST(uid AS VARCHAR) AS id, confidence FROM tr WHERE cluster_id = '{_ONE}' UNION ALL SELECT 'REVISION', updated_at, cluster_id, uir_count / 10.0::DOUBLE FROM clusters WHERE cluster_id = '{_ONE}'"))
def tool_cluster_detail(s, d):
    return _tools(s, d).call("get_cluster_detail", cluster_id=_ONE)


@query("tool_cluster_details", fx.with_sql("records clusters", f"+ {_RECORDS} SELECT cluster_id, uir_count, (SELECT string_agg(CAST(uid AS VARCHAR), ',' ORDER BY created_at, uid) FROM (SELECT * FROM tr WHERE cluster_id = '{_ONE}' ORDER BY created_at DESC, uid LIMIT 5)) AS evidence FROM clusters WHERE cluster_id = '{_ONE}'"))
def tool_cluster_details(s, d):
    got = _tools(s, d).call("get_cluster_details", cluster_id=_ONE)
    return got.select("cluster_id", "uir_count", F.array_join(F.transform("supporting_evidence", lambda x: x["uid"].cast("string")), ",").alias("evidence"))


@query("tool_historical", fx.with_sql("records", f"+ {_RECORDS} SELECT uid, round(sim, 6) AS similarity FROM (SELECT uid, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM tr JOIN embeddings ON vec_id = uid, {_Q} WHERE historical AND year(created_at) < 2025) WHERE sim > 0.02 ORDER BY sim DESC, uid LIMIT 15"))
def tool_historical(s, d):
    return _tools(s, d).call("search_historical_intelligence", query="any", before_year=2025, least=0.02).select("uid", F.round("similarity", 6).alias("similarity"))


@query("tool_location_history", fx.with_sql("records clusters entities", f"+ {_RECORDS}, p AS (SELECT lon, lat FROM entities WHERE entity_type = 'LOCATION' AND name ILIKE '%tion_12%' ORDER BY entity_id LIMIT 1) SELECT * FROM (SELECT 'HISTORY' AS kind, CAST(uid AS VARCHAR) AS id, created_at AS at FROM tr r, p WHERE historical AND {_hav('p.lon', 'p.lat', 'r.lon', 'r.lat')} <= 3000000 ORDER BY created_at DESC, uid LIMIT 10) UNION ALL SELECT 'CLUSTER', cluster_id, updated_at FROM clusters c, p WHERE status = 'ACTIVE' AND {_hav('p.lon', 'p.lat', 'c.lon', 'c.lat')} <= 3000000"))
def tool_location_history(s, d):
    return _tools(s, d).call("get_location_history", location_name="tion_12", radius_km=3000.0)


@query("tool_morning_brief", fx.with_sql("records", "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS period_end, count(*) AS uir_count FROM records GROUP BY 1 HAVING date_trunc('day', min(created_at)) = TIMESTAMP '2024-01-01 00:00:00'"))
def tool_morning_brief(s, d):
    return _tools(s, d, "2024-01-01 18:00:00").call("get_morning_brief").select(F.col("period_end").cast("timestamp_ntz").alias("period_end"), "uir_count")


@query("tool_active_anomalies", fx.with_sql("clusters", "SELECT cluster_id, priority, uir_count FROM clusters WHERE status IN ('ACTIVE', 'ESCALATING') AND priority = 'CRITICAL' AND domain = 'MILITARY'"))
def tool_active_anomalies(s, d):
    return _tools(s, d).call("get_active_anomalies", priority="CRITICAL", domain="MILITARY").select("cluster_id", "priority", "uir_count")


@query("tool_flight_anomalies", fx.with_sql("flights", f"SELECT icao24, event_id, anomaly_score FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY anomaly_score DESC, time, event_id) AS n FROM flights WHERE time > {_NOW} - INTERVAL 72 HOUR AND anomaly_score > 0.7) WHERE n = 1"))
def tool_flight_anomalies(s, d):
    return _tools(s, d).call("get_flight_anomalies", hours_back=72).select("icao24", "event_id", "anomaly_score")


@query("tool_agent_health", fx.with_sql("queue", f"SELECT agent, max(CASE WHEN status = 'DONE' THEN created_at END) AS last_active, count(*) FILTER (status = 'FAILED') AS failures_24h FROM queue WHERE created_at > {_NOW} - INTERVAL 24 HOUR GROUP BY agent"))
def tool_agent_health(s, d):
    return _tools(s, d).call("get_agent_health")


@query("tool_director_task", "SELECT sha256('Deep dive on NATION_3') AS uid, 'HUMINT' AS source_type, 'HIGH' AS priority, 'DIRECTOR_TASKED' AS trigger_type, 'PENDING' AS status, 'NATION_3' AS target_id")
def tool_director_task(s, d):
    return _tools(s, d).call("director_task", instruction="Deep dive on NATION_3", target_entity="NATION_3", priority="HIGH").select("uid", "source_type", "priority", "trigger_type", "status", "target_id")


@query("tool_entities_in_box", fx.with_sql("entities", "SELECT entity_id, lon, lat FROM entities WHERE lon BETWEEN -20 AND 30 AND lat BETWEEN 10 AND 40 ORDER BY entity_id LIMIT 500"))
def tool_entities_in_box(s, d):
    return _tools(s, d).call("entities_in_box", west=-20.0, south=10.0, east=30.0, north=40.0).select("entity_id", "lon", "lat")


@query("tool_page", fx.with_sql("entities", "SELECT entity_id FROM entities ORDER BY entity_id LIMIT 100 OFFSET 200"))
def tool_page(s, d):
    return _tools(s, d).call("page", table="entities", order="entity_id", size=100, number=2).select("entity_id")


@query("seismic_records", "SELECT 'q' || event_id AS usgs_id, CASE WHEN value / 50 >= 5.0 THEN 'HIGH' ELSE 'NORMAL' END AS priority, 0.95::DOUBLE AS confidence FROM events WHERE event_type <> 'view' AND event_type <> 'error'")
def seismic_records(s, d):
    e = fx.read(s, d, "events").select(F.concat(F.lit("q"), "event_id").alias("usgs_id"), F.col("ts").alias("time"), F.when(F.col("event_type") != "view", F.col("value") / 50).alias("magnitude"), "event_type")
    return ingest.seismic_records(e.drop("event_type"), e.where("event_type = 'error'").select("usgs_id")).select("usgs_id", "priority", "confidence")


@query("flight_hits", "WITH t AS (SELECT ts AS time, CAST(user_id AS VARCHAR) AS icao24, event_id, CASE WHEN event_type = 'error' THEN '7700' END AS squawk, 'CS' || (user_id % 9) AS callsign FROM events) SELECT icao24, event_id, CASE WHEN squawk = '7700' THEN 'CRITICAL' WHEN callsign = 'CS4' THEN 'HIGH' ELSE 'NORMAL' END AS priority, sha256(icao24 || '_' || strftime(time, '%Y%m%d%H')) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY icao24, date_trunc('hour', time) ORDER BY time, callsign, event_id) AS n FROM t) WHERE n = 1")
def flight_hits(s, d):
    tracks = fx.read(s, d, "events").select(F.col("ts").alias("time"), F.col("user_id").cast("string").alias("icao24"), F.concat(F.lit("CS"), F.col("user_id") % 9).alias("callsign"), "event_id", F.when(F.col("event_type") == "error", "7700").alias("squawk"))
    return ingest.flight_records(tracks, "CS4").select("icao24", "event_id", "priority", "content_hash")
