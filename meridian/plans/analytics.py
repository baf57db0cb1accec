"""Spatial, vector, graph, relation and fusion queries over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import clusters, graph, ingest, relations, resolve, rollup, spatial, vectors
from meridian.plans import fixtures as fx
from meridian.plans.registry import query


def _hav(lon1, lat1, lon2, lat2):
    h = f"pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2)"
    return f"(CASE WHEN {lon1} + {lat1} + {lon2} + {lat2} IS NOT NULL THEN 2 * 6371008.8 * asin(sqrt(least(1.0, {h}))) END)"


_NOW = f"TIMESTAMP '{fx.AS_OF}'"


@query("radius_search_topk", fx.with_sql("clusters records", f"SELECT kind, id, round(m / 1000, 3) AS distance_km FROM (SELECT 'CLUSTER' AS kind, cluster_id AS id, {_hav('10.0', '20.0', 'lon', 'lat')} AS m FROM clusters WHERE status = 'ACTIVE' UNION ALL SELECT 'RECORD', CAST(uid AS VARCHAR), {_hav('10.0', '20.0', 'lon', 'lat')} FROM records WHERE created_at > {_NOW} - INTERVAL 30 DAY) WHERE m <= 3000000 ORDER BY m, kind, id LIMIT 20"))
def radius_search_topk(s, d):
    c = fx.clusters(s, d).where("status = 'ACTIVE'").select(F.lit("CLUSTER").alias("kind"), F.col("cluster_id").alias("id"), "lon", "lat")
    r = fx.records(s, d).where(F.col("created_at") > fx.as_of() - F.expr("INTERVAL 30 DAYS")).select(F.lit("RECORD").alias("kind"), F.col("uid").cast("string").alias("id"), "lon", "lat")
    found = spatial.within(c.unionByName(r), 10.0, 20.0, 3_000_000).orderBy("distance_m", "kind", "id").limit(20)
    return found.select("kind", "id", F.round(F.col("distance_m") / 1000, 3).alias("distance_km"))


def _anchors(s, d):
    return fx.entities(s, d).where("entity_type = 'ORGANIZATION'").select("entity_id", "lon", "lat")


@query("nearest_anchor", fx.with_sql("records entities", f"SELECT uid, entity_id, round(m, 3) AS distance_m FROM (SELECT uid, entity_id, {_hav('r.lon', 'r.lat', 'e.lon', 'e.lat')} AS m, row_number() OVER (PARTITION BY uid ORDER BY {_hav('r.lon', 'r.lat', 'e.lon', 'e.lat')}, entity_id) AS n FROM records r JOIN entities e ON entity_type = 'ORGANIZATION' AND {_hav('r.lon', 'r.lat', 'e.lon', 'e.lat')} <= 500000) WHERE n = 1"))
def nearest_anchor(s, d):
    r = fx.records(s, d).select("uid", "lon", "lat")
    return spatial.nearest(r, _anchors(s, d), "uid", "entity_id", 500_000).select("uid", "entity_id", F.round("distance_m", 3).alias("distance_m"))


@query("bbox_latest", fx.with_sql("records", "SELECT uid, created_at, lon, lat FROM records WHERE lon BETWEEN -41 AND 39 AND lat BETWEEN -30 AND 50 ORDER BY created_at DESC, uid LIMIT 1"))
def bbox_latest(s, d):
    return fx.records(s, d).where(spatial.in_envelope(-1.0, 10.0, 40.0)).orderBy(F.desc("created_at"), "uid").select("uid", "created_at", "lon", "lat").limit(1)


@query("polygon_filter", fx.with_sql("flights", "SELECT event_id FROM flights WHERE (((0.0 > lat) <> (0.0 > lat))::INT + (((0.0 > lat) <> (40.0 > lat)) AND lon < 50.0 + (lat - 0.0) * -0.625)::INT + (((40.0 > lat) <> (0.0 > lat)) AND lon < 25.0 + (lat - 40.0) * 0.625)::INT) % 2 = 1"))
def polygon_filter(s, d):
    return fx.flights(s, d).where(spatial.in_polygon([(0.0, 0.0), (50.0, 0.0), (25.0, 40.0)])).select("event_id")


@query("flight_record_join", fx.with_sql("flights records", f"SELECT event_id, uid FROM (SELECT * FROM flights WHERE anomaly_score > 0.7 AND squawk = '7700') f LEFT JOIN records r ON {_hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} <= 200000"))
def flight_record_join(s, d):
    f = fx.flights(s, d).where("anomaly_score > 0.7 and squawk = '7700'").select("event_id", "lon", "lat")
    return spatial.radius_join(f, fx.records(s, d).select("uid", "lon", "lat"), 200_000, how="left").select("event_id", "uid")


@query("planar_parity", fx.with_sql("clusters", "SELECT cluster_id, round(sqrt(pow(lon - 10.0, 2) + pow(lat - 20.0, 2)), 6) AS degrees FROM clusters"))
def planar_parity(s, d):
    return fx.clusters(s, d).select("cluster_id", F.round(geo.planar_deg(F.lit(10.0), F.lit(20.0), F.col("lon"), F.col("lat")), 6).alias("degrees"))


@query("spatiotemporal_pairs", fx.with_sql("records", f"SELECT a.uid AS uid_a, b.uid AS uid_b FROM records a JOIN records b ON a.uid < b.uid AND a.domain = b.domain AND abs(date_diff('minute', a.created_at, b.created_at)) <= 4320 AND {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 600000"))
def spatiotemporal_pairs(s, d):
    # records meet by cell, domain and span of 72 hours, each with the two spans beside it
    span = F.floor(F.unix_timestamp(F.col("created_at").cast("timestamp")) / (72 * 3600))
    r = fx.records(s, d).where("domain is not null").select("uid", "domain", "created_at", "lon", "lat", span.alias("span"))
    o = r.withColumnsRenamed({"uid": "uid_b", "domain": "domain_b", "created_at": "at_b"}).withColumn("span_b", F.explode(F.sequence(F.col("span") - 1, F.col("span") + 1))).drop("span")
    gap = F.abs(F.timestamp_diff("MINUTE", F.col("created_at"), F.col("at_b"))) <= 4320
    same = (F.col("span") == F.col("span_b")) & (F.col("domain") == F.col("domain_b"))
    return spatial.radius_join(r, o, 600_000, same & (F.col("uid") < F.col("uid_b")) & gap).select(F.col("uid").alias("uid_a"), "uid_b")


@query("orgs_near_clusters", fx.with_sql("clusters entities", f"SELECT DISTINCT cluster_id, entity_id FROM clusters c JOIN entities e ON entity_type = 'ORGANIZATION' AND status = 'ACTIVE' AND {_hav('c.lon', 'c.lat', 'e.lon', 'e.lat')} <= 1000000"))
def orgs_near_clusters(s, d):
    c = fx.clusters(s, d).where("status = 'ACTIVE'").select("cluster_id", "lon", "lat")
    return spatial.radius_join(c, _anchors(s, d), 1_000_000).select("cluster_id", "entity_id").distinct()


def _vectors(s, d):
    return fx.read(s, d, "embeddings")


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _first(s, d):
    return F.array(*(F.lit(float(x)) for x in _vectors(s, d).where("vec_id = 0").first().embedding))


@query("cosine_topk", f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, {_Q} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20")
def cosine_topk(s, d):
    return vectors.top_k(_vectors(s, d), _first(s, d), 20, "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("cosine_threshold", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, {_Q} WHERE list_cosine_similarity(embedding::DOUBLE[], q) > 0.35")
def cosine_threshold(s, d):
    return vectors.above(_vectors(s, d), _first(s, d), 0.35).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("cosine_topk_per_type", "SELECT q AS query_id, e AS entity_id, round(sim, 6) AS similarity FROM (SELECT a.vec_id AS q, b.vec_id AS e, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id) WHERE n = 1")
def cosine_topk_per_type(s, d):
    v = _vectors(s, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query"))
    b = v.select(F.col("vec_id").alias("entity_id"), "label", "embedding")
    return vectors.nearest_by_type(q, b, "label", others=True).select("query_id", "entity_id", F.round("similarity", 6).alias("similarity"))


@query("resolve_decision", """WITH c AS (SELECT vec_id AS uid, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 7 END AS lex_id, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 10 / 10.0::DOUBLE END AS lex_sim, vec_id % 11 AS sem_id, vec_id % 13 / 12.0::DOUBLE AS sem_sim, CASE WHEN vec_id % 5 > 0 THEN vec_id % 5 * 40000.0::DOUBLE END AS dist, vec_id % 2 = 0 AS verified FROM embeddings),
s AS (SELECT *, CASE WHEN lex_sim <> 0 THEN lex_sim END AS l, CASE WHEN sem_sim > 0.45 AND NOT coalesce(dist > 100000, false) AND (sem_sim >= 0.85 OR verified) THEN sem_sim END AS m FROM c),
b AS (SELECT *, m IS NOT NULL AND (l IS NULL OR m > l) AS w FROM s)
SELECT uid, CASE WHEN CASE WHEN w THEN m ELSE l END > 0.45 THEN CASE WHEN w THEN sem_id ELSE lex_id END END AS best_id, round(CASE WHEN CASE WHEN w THEN m ELSE l END > 0.45 THEN CASE WHEN w THEN m ELSE l END END, 6) AS best_similarity FROM b""")
def resolve_decision(s, d):
    k = F.col("vec_id")
    c = _vectors(s, d).select(k.alias("uid"), F.when(k % 3 != 0, k % 7).alias("lex_id"), F.when(k % 3 != 0, k % 10 / 10.0).alias("lex_sim"), (k % 11).alias("sem_id"), (k % 13 / 12.0).alias("sem_sim"), F.when(k % 5 > 0, k % 5 * 40000.0).alias("sem_distance_m"), (k % 2 == 0).alias("verified"))
    return resolve.decide(c).select("uid", "best_id", F.round("best_similarity", 6).alias("best_similarity"))


_ACCRUE = """+ k AS (SELECT a, b, type, uid, min(ts) AS ts, arg_min(trust, ts) AS trust, count(*) AS n FROM evidence GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, type ORDER BY ts, uid) AS i FROM k)
SELECT a, b, type, round(least(0.98, max(CASE WHEN i = 1 THEN 0.6 * trust END) + 0.2 * sum(CASE WHEN i > 1 THEN trust ELSE 0 END)), 6) AS confidence, count(*) AS evidence_count, sum(n)::BIGINT AS mention_count FROM r GROUP BY a, b, type"""


@query("accrual_confidence", fx.with_sql("evidence", _ACCRUE))
def accrual_confidence(s, d):
    return relations.accrue(fx.evidence(s, d)).select("a", "b", "type", F.round("confidence", 6).alias("confidence"), "evidence_count", "mention_count")


@query("decay_prune", fx.with_sql("edges", f"SELECT edge_id, round(c, 6) AS confidence, v AS still_valid FROM (SELECT edge_id, CASE WHEN o THEN greatest(confidence - 0.1::DOUBLE, 0) ELSE confidence END AS c, still_valid AND NOT o AS v FROM (SELECT *, confidence < 0.5 AND last_confirmed < {_NOW} - INTERVAL 7 DAY AND still_valid AS o FROM edges)) WHERE NOT ((c < 0.2 AND NOT v) OR c < 0.1)"))
def decay_prune(s, d):
    kept = relations.prune(relations.decay(fx.edges(s, d), fx.as_of()))
    return kept.select("edge_id", F.round("confidence", 6).alias("confidence"), "still_valid")


@query("purge_weak", fx.with_sql("entities edges", f"+ g AS (SELECT entity_id FROM entities WHERE confidence < 0.4 AND last_seen < {_NOW} - INTERVAL 24 HOUR) SELECT edge_id FROM edges WHERE a NOT IN (SELECT entity_id FROM g) AND b NOT IN (SELECT entity_id FROM g)"))
def purge_weak(s, d):
    return relations.purge_weak(fx.entities(s, d), fx.edges(s, d), fx.as_of())[1].select("edge_id")


@query("entity_merge", fx.with_sql("edges", "+ m AS (SELECT 'S' || (CAST(substr(a, 2) AS BIGINT) - CASE WHEN CAST(substr(a, 2) AS BIGINT) % 10 = 1 THEN 1 ELSE 0 END) AS a, 'S' || (CAST(substr(b, 2) AS BIGINT) - CASE WHEN CAST(substr(b, 2) AS BIGINT) % 10 = 1 THEN 1 ELSE 0 END) AS b, type, confidence, mention_count FROM edges) SELECT a, b, type, max(confidence) AS confidence, sum(mention_count)::BIGINT AS mention_count FROM m WHERE a <> b GROUP BY a, b, type"))
def entity_merge(s, d):
    n = fx.read(s, d, "supplier").select("s_suppkey").union(fx.read(s, d, "lineitem").select("l_suppkey")).distinct().toDF("k").where("k % 10 = 1")
    return relations.merge_entities(fx.edges(s, d), n.select(F.concat(F.lit("S"), "k").alias("secondary"), F.concat(F.lit("S"), F.col("k") - 1).alias("primary")))


@query("edges_gt_half", fx.with_sql("edges entities", "SELECT DISTINCT x.name AS subject, type AS predicate, y.name AS object FROM edges JOIN entities x ON a = x.entity_id JOIN entities y ON b = y.entity_id WHERE edges.confidence > 0.5"))
def edges_gt_half(s, d):
    return graph.edge_view(fx.edges(s, d), fx.entities(s, d).select("entity_id", "name"), 0.5)


_SYM = "y AS (SELECT edge_id, a AS src, b AS dst, type FROM edges UNION ALL SELECT edge_id, b, a, type FROM edges WHERE a <> b)"


@query("khop_network", fx.with_sql("edges", f"+ {_SYM}, t AS (SELECT 'S5' AS root, dst AS spot, type AS first_type, [edge_id] AS path, 1 AS length FROM y WHERE src = 'S5' UNION ALL SELECT root, dst, first_type, list_append(path, edge_id), length + 1 FROM t JOIN y ON spot = src WHERE length < 2 AND NOT list_contains(path, edge_id)) SELECT root, spot AS connected, first_type, length FROM t", True))
def khop_network(s, d):
    return graph.trails(fx.edges(s, d), s.createDataFrame([("S5",)], "root string"), 2)


_TYPED = """, z AS (SELECT edge_id, src, dst FROM y WHERE type IN ('A', 'R')),
t1 AS (SELECT dst AS spot, edge_id AS e1 FROM z WHERE src = 'S3'),
t2 AS (SELECT z.dst AS spot, e1, z.edge_id AS e2 FROM t1 JOIN z ON spot = src WHERE z.edge_id <> e1),
w AS (SELECT src, dst, count(*) AS w FROM z GROUP BY src, dst),
t3 AS (SELECT w.dst AS spot, sum(c * w) AS n FROM (SELECT spot, count(*) AS c FROM t2 GROUP BY spot) JOIN w ON spot = src GROUP BY w.dst
  UNION ALL SELECT z.dst, -count(*) FROM t2 JOIN z ON spot = src AND z.edge_id IN (e1, e2) GROUP BY z.dst)
SELECT spot AS connected, min(length)::INT AS distance, sum(n)::BIGINT AS n_paths FROM (SELECT spot, 1 AS length, count(*) AS n FROM t1 GROUP BY spot UNION ALL SELECT spot, 2, count(*) FROM t2 GROUP BY spot UNION ALL SELECT spot, 3, sum(n) FROM t3 GROUP BY spot HAVING sum(n) > 0) GROUP BY spot"""


@query("typed_traversal", fx.with_sql("edges", f"+ {_SYM}{_TYPED}"))
def typed_traversal(s, d):
    t = graph.trail_counts(fx.edges(s, d), s.createDataFrame([("S3",)], "root string"), 3, ["A", "R"])
    return t.groupBy("connected").agg(F.min("length").alias("distance"), F.sum("n").alias("n_paths"))


@query("reachable_nodes", fx.with_sql("edges", f"+ {_SYM}, t AS (SELECT 'S5' AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM t JOIN y ON node = src WHERE distance < 3) SELECT 'S5' AS root, node, min(distance) AS distance FROM t GROUP BY node", True))
def reachable_nodes(s, d):
    return graph.reach(fx.edges(s, d), s.createDataFrame([("S5",)], "root string"), 3)


@query("recursive_expansion", fx.with_sql("edges", "+ t AS (SELECT edge_id, a, b, type, [a, b] AS path, 1 AS hop FROM edges WHERE a = 'S7' OR b = 'S7' UNION SELECT e.edge_id, e.a, e.b, e.type, list_concat(path, [e.a, e.b]), hop + 1 FROM t JOIN edges e ON e.a IN (t.a, t.b) OR e.b IN (t.a, t.b) WHERE hop < 2 AND NOT (list_contains(path, e.a) AND list_contains(path, e.b))) SELECT DISTINCT edge_id, a, b, type, hop FROM t", True))
def recursive_expansion(s, d):
    return graph.expansion(fx.edges(s, d), s.createDataFrame([("S7",)], "root string"), 2)


@query("edge_fanout", fx.with_sql("edges", "SELECT a, edge_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, edge_id) AS n FROM edges) WHERE n <= 10"))
def edge_fanout(s, d):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "edge_id"))
    return fx.edges(s, d).select("a", "edge_id", "confidence", n.alias("n")).where("n <= 10").drop("n")


_FLAG = fx.with_sql("records sources entities", f"""+ u AS (SELECT content_hash, min(uid) AS uid FROM records GROUP BY content_hash),
x AS (SELECT r.uid, coalesce(trust_score, 0.5::DOUBLE) AS trust, lon, lat, coalesce(priority, 'NORMAL') AS priority FROM records r JOIN u ON r.uid = u.uid LEFT JOIN sources USING (source_name)),
n AS (SELECT x.uid, entity_id, {_hav('x.lon', 'x.lat', 'e.lon', 'e.lat')} AS m, row_number() OVER (PARTITION BY x.uid ORDER BY {_hav('x.lon', 'x.lat', 'e.lon', 'e.lat')}, entity_id) AS i FROM x JOIN entities e ON entity_type = 'ORGANIZATION' AND {_hav('x.lon', 'x.lat', 'e.lon', 'e.lat')} <= 500000)
SELECT x.uid, x.priority, x.trust, entity_id, round(m, 3) AS distance_m FROM x JOIN n ON x.uid = n.uid AND i = 1 ORDER BY x.priority = 'CRITICAL' DESC, x.trust DESC, x.uid LIMIT 100""")


@query("fusion_flagship", _FLAG)
def fusion_flagship(s, d):
    r = ingest.first_by(fx.records(s, d).select("content_hash", "uid", "source_name", "lon", "lat", "priority"), ["content_hash"], "uid")
    x = r.join(fx.sources(s, d), "source_name", "left").select("uid", F.coalesce("trust_score", F.lit(0.5)).alias("trust"), "lon", "lat", F.coalesce("priority", F.lit("NORMAL")).alias("priority"))
    n = spatial.nearest(x, _anchors(s, d), "uid", "entity_id", 500_000, keep=("priority", "trust"))
    top = n.orderBy((F.col("priority") == "CRITICAL").desc(), F.desc("trust"), "uid").limit(100)
    return top.select("uid", "priority", "trust", "entity_id", F.round("distance_m", 3).alias("distance_m"))


@query("leader_clusters")
def leader_clusters(s, d):
    v = _vectors(s, d).select(F.col("vec_id").alias("vid"), "embedding")
    r = fx.records(s, d).select("uid", "client_id", "domain", "created_at", "lon", "lat")
    return clusters.leader_clusters(r.join(v, F.col("uid") == F.col("vid"), "left"), 2_000_000, 0.0).select("uid", "cluster_id")


@query("lsh_topk")
def lsh_topk(s, d):
    v = _vectors(s, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.lsh_top_k(v, q, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("cluster_revisions", fx.with_sql("records", "SELECT domain, slot, previous, new, round(new - previous, 6) AS delta FROM (SELECT domain, slot, new, lag(new) OVER (PARTITION BY domain ORDER BY slot) AS previous FROM (SELECT domain, date_trunc('hour', created_at) AS slot, round(avg(confidence), 4) AS new FROM records WHERE domain IS NOT NULL GROUP BY ALL)) WHERE previous IS NOT NULL AND previous <> new"))
def cluster_revisions(s, d):
    g = fx.records(s, d).where("domain is not null").groupBy("domain", F.date_trunc("hour", "created_at").alias("slot")).agg(F.round(F.avg("confidence"), 4).alias("c"))
    return rollup.revisions(g, "domain", "slot", "c")


@query("vector_duplicates", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3")
def vector_duplicates(s, d):
    return vectors.similar_pairs(_vectors(s, d), 0.3, "vec_id")


@query("vector_duplicate_classes", "WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.38), t AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a), n AS (SELECT a, count(*) AS links FROM p GROUP BY a) SELECT t.a AS vec_id, coalesce(any_value(links), 0)::BIGINT AS links, min(t.b) AS class_id FROM t LEFT JOIN n ON n.a = t.a GROUP BY t.a")
def vector_duplicate_classes(s, d):
    return vectors.duplicate_classes(_vectors(s, d), 0.38, "vec_id")
