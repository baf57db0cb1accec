"""Scans, filters, deduplication, joins, ranking, aggregates and views over the adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from meridian import tools
from meridian.functions import text as tx
from meridian.operators import ingest, rollup
from meridian.plans import fixtures as fx
from meridian.plans.registry import query
from meridian.sources import readers
from meridian.streaming import jobs

_R7 = f"TIMESTAMP '{fx.AS_OF}'"


@query("scan_filter_recent", fx.with_sql("records", f"SELECT uid, source_name, lon, lat, coalesce(priority, 'NORMAL') AS priority FROM records WHERE created_at > {_R7} - INTERVAL 30 DAY AND confidence >= 0.5 AND lon IS NOT NULL"))
def scan_filter_recent(s, d):
    r = fx.records(s, d).where((F.col("created_at") > fx.as_of() - F.expr("INTERVAL 30 DAYS")) & (F.col("confidence") >= 0.5) & F.col("lon").isNotNull())
    return r.select("uid", "source_name", "lon", "lat", F.coalesce("priority", F.lit("NORMAL")).alias("priority"))


@query("ilike_any_names", fx.with_sql("entities", "SELECT entity_id, upper(name) AS name FROM entities WHERE name ILIKE '%00001%' OR name ILIKE '%united%' OR name ILIKE '%ch_na%'"))
def ilike_any_names(s, d):
    e = fx.entities(s, d)
    return e.where(reduce(lambda a, b: a | b, (F.col("name").ilike(p) for p in ("%00001%", "%united%", "%ch_na%")))).select("entity_id", F.upper("name").alias("name"))


@query("array_membership", fx.with_sql("evidence", "SELECT b AS entity_id, count(DISTINCT uid) AS n_refs FROM evidence GROUP BY b HAVING list_contains(list(DISTINCT uid), 1) OR list_contains(list(DISTINCT uid), 3)"))
def array_membership(s, d):
    refs = fx.evidence(s, d).groupBy(F.col("b").alias("entity_id")).agg(F.collect_set("uid").alias("uir_refs"))
    return refs.where(F.array_contains("uir_refs", 1) | F.array_contains("uir_refs", 3)).select("entity_id", F.size("uir_refs").cast("long").alias("n_refs"))


@query("json_prop_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 3 AND 5")
def json_prop_filter(s, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return fx.read(s, d, "events").select("event_id", k.alias("k")).where("k between 3 and 5")


@query("keyword_containment", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thonin') OR contains(lower(text), 'elleau')")
def keyword_containment(s, d):
    return fx.read(s, d, "documents").where(tx.contains_any(F.col("text"), ("thonin", "ELLEAU"))).select("doc_id")


@query("partial_views", fx.with_sql("records edges queue flights", """
SELECT 'review_queue' AS view, count(*) AS n FROM records WHERE NOT verified AND priority IN ('CRITICAL', 'HIGH')
UNION ALL SELECT 'invalid_edges', count(*) FROM edges WHERE NOT still_valid
UNION ALL SELECT 'strong_edges', count(*) FROM edges WHERE confidence > 0.8
UNION ALL SELECT 'open_tasks', count(*) FROM queue WHERE status IN ('PENDING', 'PROCESSING')
UNION ALL SELECT 'failed_tasks', count(*) FROM queue WHERE status = 'FAILED'
UNION ALL SELECT 'anomalies', count(*) FROM flights WHERE anomaly_score > 0.7
UNION ALL SELECT 'emergencies', count(*) FROM flights WHERE squawk IN ('7500', '7600', '7700')"""))
def partial_views(s, d):
    edges, queue, tracks = fx.edges(s, d), fx.queue(s, d), fx.flights(s, d)
    views = {
        "review_queue": fx.records(s, d).where("not verified and priority in ('CRITICAL', 'HIGH')"),
        "invalid_edges": edges.where("not still_valid"), "strong_edges": edges.where("confidence > 0.8"),
        "open_tasks": queue.where("status in ('PENDING', 'PROCESSING')"), "failed_tasks": queue.where("status = 'FAILED'"),
        "anomalies": tracks.where("anomaly_score > 0.7"), "emergencies": tracks.where(F.col("squawk").isin(*ingest.SQUAWKS)),
    }
    return reduce(lambda a, b: a.unionByName(b), (v.agg(F.count("*").alias("n")).select(F.lit(k).alias("view"), "n") for k, v in views.items()))


@query("dedupe_by_hash", fx.with_sql("records", "SELECT content_hash, min(uid) AS uid FROM records GROUP BY content_hash"))
def dedupe_by_hash(s, d):
    return ingest.first_by(fx.records(s, d).select("content_hash", "uid"), ["content_hash"], "uid")


@query("anti_join_new_records", fx.with_sql("records", "SELECT content_hash, min(uid) AS uid FROM records WHERE uid % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM records WHERE uid % 2 = 0) GROUP BY content_hash"))
def anti_join_new_records(s, d):
    r = fx.records(s, d).select("content_hash", "uid")
    return ingest.insert_if_absent(r.where("uid % 2 = 1"), r.where("uid % 2 = 0"), ["content_hash"], "uid")


@query("or_key_anti_join", fx.with_sql("records", "SELECT uid FROM records r WHERE uid % 2 = 1 AND NOT EXISTS (SELECT 1 FROM records o WHERE o.uid % 2 = 0 AND o.content_hash = r.content_hash) AND NOT EXISTS (SELECT 1 FROM records o WHERE o.uid % 2 = 0 AND o.content_headline = r.content_headline)"))
def or_key_anti_join(s, d):
    r = fx.records(s, d).select("uid", "content_hash", "content_headline")
    old = r.where("uid % 2 = 0")
    return reduce(lambda df, k: df.join(old.select(k).distinct(), k, "left_anti"), ("content_hash", "content_headline"), r.where("uid % 2 = 1")).select("uid")


@query("hourly_dedupe", fx.with_sql("flights", "SELECT icao24, time, event_id FROM (SELECT *, row_number() OVER (PARTITION BY icao24, date_trunc('hour', time) ORDER BY time, event_id) AS n FROM flights) WHERE n = 1"))
def hourly_dedupe(s, d):
    return ingest.first_in_hour(fx.flights(s, d).select("icao24", "time", "event_id"), "icao24", "time", "event_id")


_NEWS = """
+ t AS (SELECT uid, trim(lower(content_headline || ' ' || content_raw), ' ' || chr(9) || chr(10) || chr(13)) AS norm FROM records),
m AS (SELECT uid, norm, (SELECT min(focus_id) FROM missions WHERE is_active AND len(list_filter(list_concat(keywords, target_entities), lambda x: contains(norm, lower(x)))) > 0) AS mission_id FROM t)
SELECT uid, sha256(norm) AS content_hash, mission_id,
  CASE WHEN regexp_matches(norm, 'war|military|missile|strike|troop|navy') THEN 'MILITARY' WHEN regexp_matches(norm, 'market|bank|stock|trade|econom') THEN 'FINANCIAL' ELSE 'POLITICAL' END AS domain,
  CASE WHEN mission_id IS NOT NULL OR regexp_matches(norm, 'attack|explosion|urgent|breaking|killed|emergency') THEN 'HIGH' ELSE 'NORMAL' END AS priority
FROM m"""


@query("news_mission_match", fx.with_sql("records missions", _NEWS))
def news_mission_match(s, d):
    norm = tx.strip(F.lower(F.concat_ws(" ", "content_headline", "content_raw")))
    r = ingest.match_mission(fx.records(s, d).select("uid", norm.alias("norm")), fx.missions(s, d), "norm", "uid")
    return r.select("uid", F.sha2("norm", 256).alias("content_hash"), "mission_id", ingest.domain_of(F.col("norm")).alias("domain"), ingest.priority_of(F.col("norm"), F.col("mission_id").isNotNull()).alias("priority"))


@query("doc_chunks", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, (i // 1300 + 1)::INT AS part, sha256(substr(t, i::INT + 1, 1500)) AS content_hash FROM t, range(0, length(t), 1300) r(i) WHERE length(t) > 0")
def doc_chunks(s, d):
    return ingest.document_chunks(fx.read(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "part", "content_hash")


@query("token_passages", r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, ceil(len(w) / 2000.0)::INT AS passages, len(w)::BIGINT AS tokens FROM t")
def token_passages(s, d):
    p = tx.token_passages(F.col("text"))
    n = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(x, " ")))
    return fx.read(s, d, "documents").select("doc_id", F.size(p).alias("passages"), n.alias("tokens"))


@query("rss_extract", r"SELECT page_id, url AS source_url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages WHERE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' AND url IS NOT NULL")
def rss_extract(s, d):
    return readers.html_items(fx.read(s, d, "pages")).select("page_id", "source_url", "title")


@query("left_enrich_trust", fx.with_sql("records sources missions", "SELECT uid, category, coalesce(trust_score, 0.5::DOUBLE) AS trust FROM records LEFT JOIN missions ON mission_id = focus_id LEFT JOIN sources USING (source_name)"))
def left_enrich_trust(s, d):
    r = fx.records(s, d).join(fx.missions(s, d), F.col("mission_id") == F.col("focus_id"), "left").join(fx.sources(s, d), "source_name", "left")
    return r.select("uid", "category", F.coalesce("trust_score", F.lit(0.5)).alias("trust"))


@query("edge_names_join", fx.with_sql("edges entities", "SELECT edge_id, a.name AS name_a, type, b.name AS name_b FROM edges JOIN entities a ON a.entity_id = edges.a JOIN entities b ON b.entity_id = edges.b"))
def edge_names_join(s, d):
    e, n = fx.edges(s, d), fx.entities(s, d)
    side = lambda k: n.select(F.col("entity_id").alias(k), F.col("name").alias(f"name_{k}"))
    return e.join(side("a"), "a").join(side("b"), "b").select("edge_id", "name_a", "type", "name_b")


@query("triple_resolve_join", fx.with_sql("entities evidence", "SELECT DISTINCT a.entity_id AS a, b.entity_id AS b, type FROM evidence JOIN entities a ON a.entity_id = evidence.a JOIN entities b ON b.entity_id = evidence.b"))
def triple_resolve_join(s, d):
    e = fx.evidence(s, d).select("a", "b", "type").distinct()
    n = fx.entities(s, d)
    return e.join(n.select(F.col("entity_id").alias("a")), "a", "left_semi").join(n.select(F.col("entity_id").alias("b")), "b", "left_semi").select("a", "b", "type")


@query("or_join_degree", fx.with_sql("edges entities", "SELECT entity_id, count(*) AS degree FROM entities JOIN edges ON a = entity_id OR b = entity_id GROUP BY entity_id"))
def or_join_degree(s, d):
    from meridian.operators import graph

    return graph.degree(fx.edges(s, d)).join(fx.entities(s, d), F.col("node") == F.col("entity_id")).select("entity_id", "degree")


@query("mission_counts", fx.with_sql("records missions", "SELECT category, count(*) AS n FROM records JOIN missions ON mission_id = focus_id GROUP BY category"))
def mission_counts(s, d):
    n = fx.records(s, d).groupBy("mission_id").agg(F.count("*").alias("n"))
    return n.join(fx.missions(s, d), F.col("mission_id") == F.col("focus_id")).groupBy("category").agg(F.sum("n").alias("n"))


@query("hourly_anomalies", fx.with_sql("flights", "SELECT date_trunc('hour', time) AS bucket, count(*) FILTER (anomaly_score > 0.7) AS anomaly_count, round(avg(anomaly_score), 6) AS avg_score, count(lon) AS n_positions, min(lon) AS min_lon, max(lon) AS max_lon FROM flights GROUP BY 1"))
def hourly_anomalies(s, d):
    return rollup.hourly_anomalies(fx.flights(s, d))


@query("hourly_positions", fx.with_sql("flights", "SELECT bucket, chunk, string_agg(printf('%.1f', lon) || ' ' || printf('%.1f', lat), ',' ORDER BY lon, lat) AS points FROM (SELECT date_trunc('hour', time) AS bucket, lon, lat, ((row_number() OVER (PARTITION BY date_trunc('hour', time) ORDER BY lon, lat) - 1) // 1000)::INT AS chunk FROM flights) GROUP BY ALL"))
def hourly_positions(s, d):
    p = rollup.positions(fx.flights(s, d))
    return p.select("bucket", "chunk", F.array_join(F.transform("points", lambda x: F.concat_ws(" ", F.format_string("%.1f", x["lon"]), F.format_string("%.1f", x["lat"]))), ",").alias("points"))


@query("system_health", fx.with_sql("records entities edges queue", "SELECT (SELECT count(*) FROM records) AS n_records, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM queue WHERE status = 'PENDING') AS n_pending"))
def system_health(s, d):
    return rollup.health({"n_records": fx.records(s, d), "n_entities": fx.entities(s, d), "n_edges": fx.edges(s, d), "n_pending": fx.queue(s, d).where("status = 'PENDING'")})


@query("status_counts", fx.with_sql("queue", "SELECT status, count(*) AS n FROM queue GROUP BY status"))
def status_counts(s, d):
    return fx.queue(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("agent_heartbeats", fx.with_sql("queue", f"SELECT agent, max(created_at) FILTER (status = 'DONE') AS last_done, count(*) FILTER (status = 'FAILED' AND created_at > {_R7} - INTERVAL 24 HOUR) AS failures, coalesce(max(created_at) FILTER (status = 'DONE') < {_R7} - INTERVAL 30 MINUTE, true) AS stale FROM queue GROUP BY agent"))
def agent_heartbeats(s, d):
    done = F.max(F.when(F.col("status") == "DONE", F.col("created_at")))
    g = fx.queue(s, d).groupBy("agent").agg(done.alias("last_done"), F.count_if((F.col("status") == "FAILED") & (F.col("created_at") > fx.as_of() - F.expr("INTERVAL 24 HOURS"))).alias("failures"))
    return g.withColumn("stale", F.coalesce(F.col("last_done") < fx.as_of() - F.expr("INTERVAL 30 MINUTES"), F.lit(True)))


@query("triple_domain_having", fx.with_sql("records", "SELECT source_name, count(*) FILTER (source_type = 'OSINT') AS n_osint, count(*) FILTER (source_type = 'GEOINT') AS n_geoint, count(*) FILTER (source_type = 'SIGINT') AS n_sigint FROM records GROUP BY source_name HAVING n_osint > 0 AND n_geoint > 0 AND n_sigint > 0"))
def triple_domain_having(s, d):
    return rollup.cross_domain(fx.records(s, d), "source_name", ("OSINT", "GEOINT", "SIGINT"))


@query("entity_deep_dive", fx.with_sql("edges entities", "SELECT entity_id, name, chunk, string_agg(edge_id || ':' || type, ',' ORDER BY edge_id, type) AS history, count(*) AS n_edges FROM (SELECT *, ((row_number() OVER (PARTITION BY a ORDER BY edge_id, type) - 1) // 1000)::INT AS chunk FROM edges) JOIN entities ON a = entity_id WHERE entity_type = 'ORGANIZATION' GROUP BY entity_id, name, chunk"))
def entity_deep_dive(s, d):
    h = rollup.sorted_chunks(fx.edges(s, d).select(F.col("a").alias("entity_id"), "edge_id", "type"), "entity_id", ["edge_id", "type"], "h")
    e = fx.entities(s, d).where("entity_type = 'ORGANIZATION'").join(h, "entity_id")
    return e.select("entity_id", "name", "chunk", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["edge_id"].cast("string"), x["type"])), ",").alias("history"), F.size("h").cast("long").alias("n_edges"))


@query("best_row_per_key", fx.with_sql("flights", "SELECT icao24, event_id, anomaly_score FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY anomaly_score DESC, time, event_id) AS n FROM flights) WHERE n = 1"))
def best_row_per_key(s, d):
    return rollup.best_per_key(fx.flights(s, d), "icao24", F.desc("anomaly_score"), "time", "event_id").select("icao24", "event_id", "anomaly_score")


@query("revision_delta", fx.with_sql("records", "SELECT source_name, uid, previous, confidence AS new, round(confidence - previous, 6) AS delta FROM (SELECT source_name, uid, confidence, lag(confidence) OVER (PARTITION BY source_name ORDER BY uid) AS previous FROM records) WHERE previous IS NOT NULL AND previous <> confidence"))
def revision_delta(s, d):
    return rollup.revisions(fx.records(s, d), "source_name", "uid", "confidence")


@query("profile_history", fx.with_sql("queue", "SELECT agent, value, valid_from, lead(valid_from) OVER (PARTITION BY agent ORDER BY valid_from) AS valid_to FROM (SELECT agent, status AS value, queue_id AS valid_from, lag(status) OVER (PARTITION BY agent ORDER BY queue_id) AS p FROM queue) WHERE p IS NULL OR p <> value"))
def profile_history(s, d):
    return rollup.history(fx.queue(s, d), "agent", "queue_id", "status")


@query("active_clusters", fx.with_sql("clusters", "SELECT cluster_id, domain, uir_count, priority, updated_at FROM clusters WHERE status = 'ACTIVE' ORDER BY priority = 'CRITICAL' DESC, updated_at DESC NULLS FIRST, cluster_id LIMIT 10"))
def active_clusters(s, d):
    return tools.Tools({"clusters": fx.clusters(s, d).drop("client_id")}).get_active_clusters().select("cluster_id", "domain", "uir_count", "priority", "updated_at")


@query("cluster_evidence", fx.with_sql("records", "SELECT domain, uid FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, uid) AS n FROM records WHERE domain IS NOT NULL) WHERE n <= 5"))
def cluster_evidence(s, d):
    # the newest five a group: sorted slices of combined lists would grow, a window sorts and stops
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("created_at"), "uid"))
    return fx.records(s, d).where("domain is not null").select("domain", "uid", n.alias("n")).where("n <= 5").select("domain", "uid")


@query("claim_order", fx.with_sql("queue", "SELECT queue_id, priority FROM queue WHERE status = 'PENDING' ORDER BY priority = 'CRITICAL' DESC, created_at, queue_id LIMIT 50"))
def claim_order(s, d):
    return jobs.claim_order(fx.queue(s, d)).select("queue_id", "priority").limit(50)


@query("enrichment_pick", fx.with_sql("entities", "SELECT entity_id, confidence, mention_count FROM entities WHERE confidence < 0.5 ORDER BY mention_count DESC, entity_id LIMIT 1"))
def enrichment_pick(s, d):
    return fx.entities(s, d).where("confidence < 0.5").orderBy(F.desc("mention_count"), "entity_id").select("entity_id", "confidence", "mention_count").limit(1)


@query("recent_rejections", "SELECT client, doc_id FROM (SELECT 'c' || (doc_id % 3) AS client, doc_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id DESC) AS n FROM labels WHERE quality = 0) WHERE n <= 5")
def recent_rejections(s, d):
    from pyspark.sql.window import Window

    f = fx.read(s, d, "labels").where("quality = 0").select(F.concat(F.lit("c"), F.col("doc_id") % 3).alias("client"), "doc_id")
    return f.withColumn("n", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("doc_id")))).where("n <= 5").drop("n")


@query("tenant_rows", fx.with_sql("records", "SELECT uid, client_id FROM records WHERE client_id IN ('c1', 'global')"))
def tenant_rows(s, d):
    from meridian.schemas import GLOBAL_CLIENT

    r = fx.records(s, d).select("uid", F.when(F.col("client_id") == "global", GLOBAL_CLIENT).otherwise(F.col("client_id")).alias("client_id"))
    return tools.tenant_view(r, "c1").select("uid", F.when(F.col("client_id") == GLOBAL_CLIENT, "global").otherwise(F.col("client_id")).alias("client_id"))


@query("union_all_feed", fx.with_sql("clusters records", "SELECT 'CLUSTER' AS kind, cluster_id AS id FROM clusters WHERE status = 'ACTIVE' UNION ALL SELECT 'RECORD', CAST(uid AS VARCHAR) FROM records WHERE priority = 'CRITICAL'"))
def union_all_feed(s, d):
    c = fx.clusters(s, d).where("status = 'ACTIVE'").select(F.lit("CLUSTER").alias("kind"), F.col("cluster_id").alias("id"))
    return c.unionByName(fx.records(s, d).where("priority = 'CRITICAL'").select(F.lit("RECORD").alias("kind"), F.col("uid").cast("string").alias("id")))


@query("notification_json", fx.with_sql("records", "SELECT uid, json_object('uid', uid, 'source_type', source_type, 'priority', coalesce(priority, 'NORMAL'), 'domain', domain)::VARCHAR AS payload, lon IS NULL AS no_place FROM records"))
def notification_json(s, d):
    r = fx.records(s, d)
    n = jobs.notification(r)
    head = F.to_json(F.struct("uid", F.get_json_object("payload", "$.source_type").alias("source_type"), F.get_json_object("payload", "$.priority").alias("priority"), F.get_json_object("payload", "$.domain").alias("domain")), {"ignoreNullFields": "false"})
    return n.select("uid", head.alias("payload"), F.get_json_object("payload", "$.geo.lat").isNull().alias("no_place"))


@query("watchlist_view", fx.with_sql("entities", "SELECT entity_id, name, threat_score, mention_count FROM entities WHERE threat_score >= 0.8 ORDER BY threat_score DESC, mention_count DESC, entity_id LIMIT 200"))
def watchlist_view(s, d):
    return fx.entities(s, d).where("threat_score >= 0.8").orderBy(F.desc("threat_score"), F.desc("mention_count"), "entity_id").select("entity_id", "name", "threat_score", "mention_count").limit(200)


@query("globe_state_view", fx.with_sql("clusters", "SELECT cluster_id, lon, lat, priority, uir_count FROM clusters WHERE status IN ('ACTIVE', 'ESCALATING')"))
def globe_state_view(s, d):
    return fx.clusters(s, d).where("status in ('ACTIVE', 'ESCALATING')").select("cluster_id", "lon", "lat", "priority", "uir_count")


@query("topic_routing", fx.with_sql("records", "SELECT topic, count(*) AS n FROM (SELECT 'records.' || lower(source_type) AS topic FROM records UNION ALL SELECT 'alerts' FROM records WHERE priority IN ('CRITICAL', 'HIGH')) GROUP BY topic"))
def topic_routing(s, d):
    return jobs.routed(fx.records(s, d)).groupBy("topic").agg(F.count("*").alias("n"))


@query("daily_digest", fx.with_sql("records", "SELECT date_trunc('day', created_at) AS period_start, count(*) AS n_records, count(DISTINCT domain) AS n_domains, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM records GROUP BY 1"))
def daily_digest(s, d):
    return fx.records(s, d).groupBy(F.date_trunc("day", "created_at").alias("period_start")).agg(F.count("*").alias("n_records"), F.count_distinct("domain").alias("n_domains"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


@query("morning_brief", fx.with_sql("records", "SELECT uid, domain, created_at FROM records WHERE created_at = (SELECT max(created_at) FROM records WHERE domain = 'MILITARY') AND domain = 'MILITARY' ORDER BY uid LIMIT 1"))
def morning_brief(s, d):
    return fx.records(s, d).where("domain = 'MILITARY'").orderBy(F.desc("created_at"), "uid").select("uid", "domain", "created_at").limit(1)


@query("supersedes_view", fx.with_sql("records", "SELECT uid FROM records WHERE uid NOT IN (SELECT uid // 3 FROM records WHERE uid % 9 = 0)"))
def supersedes_view(s, d):
    r = fx.records(s, d).select("uid")
    return r.join(r.where("uid % 9 = 0").select(F.expr("uid div 3").alias("uid")), "uid", "left_anti")


@query("dangling_links", fx.with_sql("records", "SELECT uid, link FROM (SELECT uid, unnest([uid + 1, uid * 2]) AS link FROM records) WHERE link NOT IN (SELECT uid FROM records)"))
def dangling_links(s, d):
    r = fx.records(s, d)
    return r.select("uid", F.explode(F.array(F.col("uid") + 1, F.col("uid") * 2)).alias("link")).join(r.select(F.col("uid").alias("link")), "link", "left_anti").select("uid", "link")


@query("noise_filter", fx.with_sql("entities edges", "SELECT entity_id FROM entities WHERE mention_count > 10 OR entity_type = 'LOCATION' OR entity_id IN (SELECT a FROM edges)"))
def noise_filter(s, d):
    near = fx.edges(s, d).select(F.col("a").alias("entity_id"), F.lit(True).alias("near")).distinct()
    e = fx.entities(s, d).join(near, "entity_id", "left")
    return e.where((F.col("mention_count") > 10) | (F.col("entity_type") == "LOCATION") | F.col("near")).select("entity_id")


@query("contested_profiles", fx.with_sql("entities evidence", "SELECT entity_id, round(avg(trust), 6) AS recomputed, avg(trust) < 0.29 AS contested FROM entities JOIN evidence ON b = entity_id GROUP BY entity_id"))
def contested_profiles(s, d):
    # trust comes in whole tenths: sums of doubles would depend on the order of rows and decide ties by noise
    t = fx.evidence(s, d).groupBy(F.col("b").alias("entity_id")).agg(F.sum(F.round(F.col("trust") * 10).cast("long")).alias("t"), F.nullif(F.count("trust"), F.lit(0)).alias("n"))
    millionths = F.expr("(200000 * t + n) div (2 * n)")
    return fx.entities(s, d).join(t, "entity_id").select("entity_id", (millionths / F.lit(1e6)).alias("recomputed"), (F.col("t") * 10 < F.col("n") * 29).alias("contested"))


@query("director_tasks", "SELECT conv_id, turn, sha256(text) AS uid FROM conversations WHERE role = 'user'")
def director_tasks(s, d):
    return fx.read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2("text", 256).alias("uid"))
