"""Entity resolution, merges, document records and filtered searches over the adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from meridian import models, schemas
from meridian.functions import geo, vector
from meridian.operators import graph, ingest, relations, resolve, rollup, spatial, vectors
from meridian.plans import fixtures as fx
from meridian.plans.analytics import _hav
from meridian.plans.registry import query

_NOW = f"TIMESTAMP '{fx.AS_OF}'"

# -- fixtures: organisations with vectors and aliases, and mentions of them ----------------------

_ORGS = """o AS (SELECT 'S' || s_suppkey AS entity_id, s_name AS name, 'ORGANIZATION' AS entity_type, ['alias-' || s_suppkey] AS aliases, embedding::DOUBLE[] AS v,
  CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 97 % 3600 / 10.0::DOUBLE - 180.0::DOUBLE END AS lon, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 41 % 1600 / 10.0::DOUBLE - 80.0::DOUBLE END AS lat
  FROM supplier JOIN embeddings ON vec_id = s_suppkey),
m AS (SELECT vec_id % 100 AS uid, vec_id AS position, CASE vec_id % 4 WHEN 0 THEN upper('Supplier#' || lpad(CAST(vec_id % 90 + 1 AS VARCHAR), 9, '0')) WHEN 1 THEN 'alias-' || (vec_id % 60) WHEN 2 THEN 'Unknown ' || (vec_id % 37) ELSE 'Supplier ' || (vec_id % 50) END AS name,
  'ORGANIZATION' AS type, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 100 % 3 > 0 THEN vec_id % 100 * 37 % 3600 / 10.0::DOUBLE - 180.0::DOUBLE END AS lon, CASE WHEN vec_id % 100 % 3 > 0 THEN vec_id % 100 * 53 % 1700 / 10.0::DOUBLE - 85.0::DOUBLE END AS lat FROM embeddings),
mm AS (SELECT uid, position, name, type, arg_min(v, position) OVER (PARTITION BY name) AS v, lon, lat FROM m)"""


def _orgs(s, d):
    k = F.col("s_suppkey")
    v = fx.read(s, d, "embeddings").select(F.col("vec_id").alias("s_suppkey"), F.col("embedding").cast("array<double>").alias("embedding"))
    at = lambda c: F.when(k % 4 > 0, c)
    return fx.read(s, d, "supplier").join(v, "s_suppkey").select(F.concat(F.lit("S"), k).alias("entity_id"), F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("entity_type"), F.array(F.concat(F.lit("alias-"), k)).alias("aliases"), "embedding", at(k * 97 % 3600 / 10.0 - 180.0).alias("lon"), at(k * 41 % 1600 / 10.0 - 80.0).alias("lat"))


def _mentions(s, d):
    k = F.col("vec_id")
    u = k % 100
    name = F.when(k % 4 == 0, F.upper(F.concat(F.lit("Supplier#"), F.lpad((k % 90 + 1).cast("string"), 9, "0")))).when(k % 4 == 1, F.concat(F.lit("alias-"), k % 60)).when(k % 4 == 2, F.concat(F.lit("Unknown "), k % 37)).otherwise(F.concat(F.lit("Supplier "), k % 50))
    rows = fx.read(s, d, "embeddings").select(u.alias("uid"), k.alias("position"), name.alias("name"), F.lit("ORGANIZATION").alias("type"), F.col("embedding").cast("array<double>").alias("embedding"), F.when(u % 3 > 0, u * 37 % 3600 / 10.0 - 180.0).alias("lon"), F.when(u % 3 > 0, u * 53 % 1700 / 10.0 - 85.0).alias("lat"))
    # a name has one vector: that of its first mention
    first = rows.groupBy("name").agg(F.min_by("embedding", "position").alias("embedding"))
    return rows.drop("embedding").join(first, "name").select(*rows.columns)


_RESOLVED = _ORGS + f""",
n AS (SELECT DISTINCT name, v FROM mm),
lx AS (SELECT n.name, arg_min(o.entity_id, o.entity_id) AS lex_id, arg_min(list_cosine_similarity(n.v, o.v), o.entity_id) AS lex_sim FROM n JOIN o ON lower(o.name) = lower(n.name) OR list_contains(o.aliases, n.name) GROUP BY n.name),
sx AS (SELECT name, sem_id, sem_sim, sem_name, e_lon, e_lat FROM (SELECT n.name, o.entity_id AS sem_id, list_cosine_similarity(n.v, o.v) AS sem_sim, o.name AS sem_name, o.lon AS e_lon, o.lat AS e_lat, row_number() OVER (PARTITION BY n.name ORDER BY list_cosine_similarity(n.v, o.v) DESC, o.entity_id) AS i FROM n, o) WHERE i = 1),
c AS (SELECT mm.*, CASE WHEN lex_sim <> 0 THEN lex_sim END AS l, lex_id, sem_id, CASE WHEN sem_sim > 0.45 AND NOT coalesce({_hav('lon', 'lat', 'e_lon', 'e_lat')} > 100000, false) AND (sem_sim >= 0.85 OR lower(trim(name)) = lower(trim(sem_name)) OR levenshtein(lower(trim(name)), lower(trim(sem_name))) <= greatest(1, floor(least(length(trim(name)), length(trim(sem_name))) / 5))) THEN sem_sim END AS s FROM mm LEFT JOIN lx USING (name) LEFT JOIN sx USING (name)),
b AS (SELECT *, s IS NOT NULL AND (l IS NULL OR s > l) AS w FROM c),
r AS (SELECT uid, position, name, lon, lat, CASE WHEN CASE WHEN w THEN s ELSE l END > 0.45 THEN CASE WHEN w THEN sem_id ELSE lex_id END END AS best, CASE WHEN w THEN s ELSE l END AS sim FROM b),
z AS (SELECT uid, position, name, lon, lat, coalesce(best, 'new-' || substr(sha256(lower(name)), 1, 32)) AS entity_id, CASE WHEN best IS NOT NULL THEN round(sim, 6) END AS similarity, best IS NULL AS created FROM r)"""


@query("entity_resolution", f"WITH {_RESOLVED} SELECT uid, position, entity_id, similarity, created FROM z")
def entity_resolution(s, d):
    return resolve.resolve_mentions(_mentions(s, d), _orgs(s, d)).select("uid", "position", "entity_id", F.round("similarity", 6).alias("similarity"), "created")


@query("entity_creation", f"WITH {_RESOLVED} SELECT entity_id, arg_min(name, uid * 100000 + position) AS name, count(*) AS mention_count, string_agg(DISTINCT CAST(uid AS VARCHAR), ',' ORDER BY CAST(uid AS VARCHAR)) AS uir_refs, 0.3::DOUBLE AS confidence FROM z WHERE created GROUP BY entity_id")
def entity_creation(s, d):
    made = resolve.created_entities(resolve.resolve_mentions(_mentions(s, d), _orgs(s, d)))
    return made.select("entity_id", "name", "mention_count", F.array_join(F.array_sort(F.col("uir_refs").cast("array<string>")), ",").alias("uir_refs"), "confidence")


@query("geo_fallback", f"WITH {_RESOLVED} SELECT uid, lon, lat FROM (SELECT z.uid, o.lon, o.lat, row_number() OVER (PARTITION BY uid ORDER BY position) AS i FROM z JOIN o USING (entity_id) WHERE NOT created AND z.lon IS NULL AND o.lon IS NOT NULL) WHERE i = 1")
def geo_fallback(s, d):
    orgs = _orgs(s, d)
    return resolve.borrowed_places(resolve.resolve_mentions(_mentions(s, d), orgs), orgs)


@query("entity_counters", f"""WITH {_RESOLVED} SELECT entity_id, (count(uid) + 5)::BIGINT AS mention_count, count(DISTINCT uid) AS n_refs, max(CASE WHEN uid IS NOT NULL THEN position END) AS last_seen FROM o LEFT JOIN (SELECT * FROM z WHERE NOT created) USING (entity_id) GROUP BY entity_id""")
def entity_counters(s, d):
    orgs = _orgs(s, d)
    old = orgs.select("entity_id", F.lit(5).cast("long").alias("mention_count"), F.array().cast("array<bigint>").alias("uir_refs"), F.lit(None).cast("long").alias("last_seen"))
    seen = resolve.resolve_mentions(_mentions(s, d), orgs).where("not created").select("entity_id", "uid", F.col("position").alias("ts"))
    return ingest.update_counts(old, seen, "entity_id", "mention_count", "uir_refs", "last_seen").select("entity_id", "mention_count", F.size("uir_refs").cast("long").alias("n_refs"), "last_seen")


_ROWS = """e AS (SELECT 'S' || s_suppkey AS entity_id, s_suppkey AS k, s_name AS name, ['a' || (s_suppkey % 7), 'b' || (s_suppkey // 10)] AS aliases, [s_suppkey % 5, s_suppkey] AS refs, s_suppkey * 3 % 50 AS n FROM supplier),
p AS (SELECT 'S' || s_suppkey AS secondary, 'S' || (s_suppkey - s_suppkey % 10) AS target FROM supplier WHERE s_suppkey % 10 IN (1, 2, 3)),
g AS (SELECT p.* FROM p JOIN e ON e.entity_id = target),
x AS (SELECT target AS entity_id, list_distinct(flatten(list(list_prepend(name, aliases)))) AS names, list_distinct(flatten(list(refs))) AS xrefs, sum(n) AS xn FROM g JOIN e ON e.entity_id = secondary GROUP BY target)"""


@query("entity_merge_rows", f"WITH {_ROWS} SELECT e.entity_id, name, array_to_string(CASE WHEN names IS NULL THEN aliases ELSE list_sort(list_distinct(list_concat(aliases, names))) END, ',') AS aliases, CASE WHEN names IS NULL THEN len(refs) ELSE len(list_distinct(list_concat(refs, xrefs))) END::BIGINT AS n_refs, (n + coalesce(xn, 0))::BIGINT AS mention_count FROM e LEFT JOIN x USING (entity_id) WHERE e.entity_id NOT IN (SELECT secondary FROM g)")
def entity_merge_rows(s, d):
    k = F.col("s_suppkey")
    e = fx.read(s, d, "supplier").select(F.concat(F.lit("S"), k).alias("entity_id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("a"), k % 7), F.concat(F.lit("b"), F.expr("s_suppkey div 10"))).alias("aliases"), F.array(k % 5, k).alias("uir_refs"), (k * 3 % 50).alias("mention_count"))
    pairs = fx.read(s, d, "supplier").where((k % 10).isin(1, 2, 3)).select(F.concat(F.lit("S"), k).alias("secondary"), F.concat(F.lit("S"), k - k % 10).alias("primary"))
    got = relations.merge_entity_rows(e, pairs)
    return got.select("entity_id", "name", F.array_join("aliases", ",").alias("aliases"), F.size("uir_refs").cast("long").alias("n_refs"), "mention_count")


_CHUNKS = r"t AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, source, (i // 1300 + 1)::INT AS part, ceil(length(t) / 1300.0)::INT AS parts, sha256(substr(t, i::INT + 1, 1500)) AS h FROM t, range(0, length(t), 1300) r(i) WHERE length(t) > 0)"


@query("document_records", f"WITH {_CHUNKS}, k AS (SELECT h FROM c WHERE source = 'src0') SELECT h AS uid, doc_id, part, source || ' - part ' || part || '/' || parts AS content_headline, 'HUMINT' AS source_type, 'HIGH' AS priority, 0.8::DOUBLE AS confidence, 'INVESTIGATIVE' AS domain FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, part) AS n FROM c WHERE h NOT IN (SELECT h FROM k)) WHERE n = 1")
def document_records(s, d):
    docs = fx.read(s, d, "documents").select("doc_id", "source", "text")
    known = ingest.document_chunks(docs.where("source = 'src0'"), "text").select("content_hash")
    return ingest.document_records(docs, known).select("uid", "doc_id", "part", "content_headline", "source_type", "priority", "confidence", "domain")


@query("vessel_hits", "WITH t AS (SELECT ts AS time, CAST(user_id AS VARCHAR) AS mmsi, event_id FROM events) SELECT mmsi, event_id, 'NORMAL' AS priority, 'MILITARY' AS domain, sha256(mmsi || '_' || strftime(time, '%Y%m%d%H')) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, date_trunc('hour', time) ORDER BY time, event_id) AS n FROM t) WHERE n = 1")
def vessel_hits(s, d):
    tracks = fx.read(s, d, "events").select(F.col("ts").alias("time"), F.col("user_id").cast("string").alias("mmsi"), "event_id")
    return ingest.vessel_records(tracks).select("mmsi", "event_id", "priority", "domain", "content_hash")


# -- filtered searches --------------------------------------------------------------------------

_QUERY = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _first(s, d):
    return F.array(*(F.lit(float(x)) for x in fx.read(s, d, "embeddings").where("vec_id = 0").first().embedding))


def _records_with_vectors(s, d):
    v = fx.read(s, d, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")
    return fx.records(s, d).drop("content_raw", "content_headline").join(v, "uid")


@query("semantic_search_filtered", fx.with_sql("records", f"SELECT uid, domain, round(sim, 6) AS similarity FROM (SELECT uid, domain, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM records JOIN embeddings ON vec_id = uid, {_QUERY} WHERE created_at > {_NOW} - INTERVAL 31 DAY AND source_type IN ('OSINT', 'SIGINT') AND domain = 'MILITARY') WHERE sim > 0.05 ORDER BY sim DESC, uid LIMIT 20"))
def semantic_search_filtered(s, d):
    wanted = (F.col("created_at") > fx.as_of() - F.expr("INTERVAL 31 DAYS")) & F.col("source_type").isin("OSINT", "SIGINT") & (F.col("domain") == "MILITARY")
    found = vectors.search(_records_with_vectors(s, d), _first(s, d), 20, "uid", 0.05, wanted)
    return found.select("uid", "domain", F.round("similarity", 6).alias("similarity"))


@query("similarity_to_named", f"SELECT s_name AS name, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM supplier JOIN embeddings ON vec_id = s_suppkey, {_QUERY} WHERE s_name ILIKE '%0000007'")
def similarity_to_named(s, d):
    named = _orgs(s, d).where(F.col("name").ilike("%0000007"))
    return named.select("name", F.round(vector.cosine(F.col("embedding"), _first(s, d)), 6).alias("similarity"))


@query("spatial_by_confidence", fx.with_sql("records", f"SELECT uid, confidence, round(m / 1000, 3) AS distance_km FROM (SELECT uid, confidence, {_hav('10.0', '20.0', 'lon', 'lat')} AS m FROM records WHERE created_at > TIMESTAMP '2024-01-01 16:00:00' - INTERVAL 48 HOUR) WHERE m <= 4000000 ORDER BY confidence DESC, m, uid LIMIT 50"))
def spatial_by_confidence(s, d):
    # 48 hours before the last of the records, which all lie in the first days
    recent = fx.records(s, d).where(F.col("created_at") > F.lit("2024-01-01 16:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 48 HOURS")).select("uid", "confidence", "lon", "lat")
    found = spatial.within(recent, 10.0, 20.0, 4_000_000).orderBy(F.desc("confidence"), "distance_m", "uid").limit(50)
    return found.select("uid", "confidence", F.round(F.col("distance_m") / 1000, 3).alias("distance_km"))


@query("location_dossier", fx.with_sql("entities records clusters", f"+ p AS (SELECT lon, lat FROM entities WHERE entity_type = 'LOCATION' AND name ILIKE 'nation#_12' ESCAPE '#' ORDER BY entity_id LIMIT 1) SELECT * FROM (SELECT 'HISTORY' AS kind, CAST(uid AS VARCHAR) AS id FROM records r, p WHERE source_type = 'OSINT' AND {_hav('p.lon', 'p.lat', 'r.lon', 'r.lat')} <= 2000000 ORDER BY created_at DESC, uid LIMIT 10) UNION ALL SELECT 'CLUSTER', cluster_id FROM clusters c, p WHERE status = 'ACTIVE' AND {_hav('p.lon', 'p.lat', 'c.lon', 'c.lat')} <= 2000000"))
def location_dossier(s, d):
    place = fx.entities(s, d).where((F.col("entity_type") == "LOCATION") & F.col("name").ilike("nation\\_12")).orderBy("entity_id").limit(1).select(F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    near = lambda df: df.crossJoin(F.broadcast(place)).where(geo.haversine_m(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat")) <= 2_000_000)
    past = near(fx.records(s, d).where("source_type = 'OSINT'").select("uid", "created_at", "lon", "lat")).orderBy(F.desc("created_at"), "uid").limit(10)
    live = near(fx.clusters(s, d).where("status = 'ACTIVE'"))
    return past.select(F.lit("HISTORY").alias("kind"), F.col("uid").cast("string").alias("id")).unionByName(live.select(F.lit("CLUSTER").alias("kind"), F.col("cluster_id").alias("id")))


# -- ranked and filtered lists ------------------------------------------------------------------


@query("recent_entities", fx.with_sql("entities", "SELECT entity_id, name, last_seen FROM entities ORDER BY last_seen DESC, entity_id LIMIT 10"))
def recent_entities(s, d):
    return fx.entities(s, d).orderBy(F.desc("last_seen"), "entity_id").select("entity_id", "name", "last_seen").limit(10)


_SIMILAR = ("%nation%", "supplier%1", "%000000002")
_LISTED = ("NATION_1", "NATION_7", "SUPPLIER#000000001", "SUPPLIER#000000002", "SUPPLIER#000000003", "CUSTOMER#000000002")


@query("listed_duplicates", fx.with_sql("entities", f"SELECT upper(name) AS name, count(*) AS n, sum(mention_count)::BIGINT AS mentions FROM entities WHERE ({' OR '.join(f'''name ILIKE '{p}' ''' for p in _SIMILAR)}) AND upper(name) IN {_LISTED} GROUP BY upper(name) ORDER BY mentions DESC, name LIMIT 20"))
def listed_duplicates(s, d):
    like = reduce(lambda a, b: a | b, (F.col("name").ilike(p) for p in _SIMILAR))
    kept = fx.entities(s, d).where(like & F.upper("name").isin(*_LISTED))
    return kept.groupBy(F.upper("name").alias("name")).agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(20)


@query("co_occurrence_top", fx.with_sql("edges", "SELECT entity_id, count(DISTINCT other) AS n FROM (SELECT a AS entity_id, b AS other FROM edges UNION ALL SELECT b, a FROM edges) WHERE entity_id <> other GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 20"))
def co_occurrence_top(s, d):
    both = graph.symmetric(fx.edges(s, d)).where("src <> dst").select("src", "dst").distinct()
    return both.groupBy(F.col("src").alias("entity_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(20)


@query("one_hop_directed", fx.with_sql("edges entities", "SELECT DISTINCT x.name AS subject, y.name AS object FROM edges JOIN entities x ON a = x.entity_id JOIN entities y ON b = y.entity_id WHERE x.name = 'Supplier#000000007' AND type = 'R'"))
def one_hop_directed(s, d):
    names = fx.entities(s, d).select("entity_id", "name")
    return graph.one_hop(fx.edges(s, d), names, "Supplier#000000007", "R")


@query("strategic_top", fx.with_sql("entities", "SELECT entity_id, name, threat_score, confidence FROM entities WHERE confidence >= 0.5 AND lon IS NOT NULL ORDER BY threat_score DESC, mention_count DESC, entity_id LIMIT 200"))
def strategic_top(s, d):
    e = fx.entities(s, d).where("confidence >= 0.5 and lon is not null")
    return e.orderBy(F.desc("threat_score"), F.desc("mention_count"), "entity_id").select("entity_id", "name", "threat_score", "confidence").limit(200)


@query("ilike_joined_columns", fx.with_sql("records missions", "SELECT uid, category FROM records LEFT JOIN missions ON mission_id = focus_id WHERE content_headline ILIKE '%tion%' OR category ILIKE '%finan%' OR content_headline ILIKE '%heit%'"))
def ilike_joined_columns(s, d):
    r = fx.records(s, d).join(fx.missions(s, d), F.col("mission_id") == F.col("focus_id"), "left")
    return r.where(F.col("content_headline").ilike("%tion%") | F.col("category").ilike("%finan%") | F.col("content_headline").ilike("%heit%")).select("uid", "category")


@query("in_array_parameter", fx.with_sql("queue records", "SELECT queue_id, status FROM queue WHERE queue_id IN (SELECT uid FROM records WHERE priority = 'CRITICAL')"))
def in_array_parameter(s, d):
    wanted = fx.records(s, d).where("priority = 'CRITICAL'").select(F.col("uid").alias("queue_id"))
    return fx.queue(s, d).join(wanted, "queue_id", "left_semi").select("queue_id", "status")


_VERBS = "CASE event_id % 6 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'LIKES' WHEN 2 THEN 'AT_WAR_WITH' WHEN 3 THEN 'EMPLOYED_BY' WHEN 4 THEN 'owns' ELSE 'BOMBED' END"


@query("vocabulary_filter", f"SELECT event_id, {_VERBS} AS predicate FROM events WHERE {_VERBS} IN {tuple(sorted(models.VOCABULARY))}")
def vocabulary_filter(s, d):
    said = fx.read(s, d, "events").select("event_id", F.expr(_VERBS).alias("predicate"))
    return said.where(F.col("predicate").isin(*sorted(models.VOCABULARY)))


@query("fulltext_names", fx.with_sql("entities", r"SELECT entity_id, name FROM entities WHERE list_contains(regexp_split_to_array(lower(name), '\W+'), 'united') OR list_contains(regexp_split_to_array(lower(name), '\W+'), '000000012')"))
def fulltext_names(s, d):
    words = F.split(F.lower("name"), r"\W+")
    return fx.entities(s, d).where(F.arrays_overlap(words, F.array(F.lit("united"), F.lit("000000012")))).select("entity_id", "name")


@query("cluster_of_record", fx.with_sql("clusters records", "SELECT cluster_id, domain, uir_count FROM clusters WHERE cluster_id = (SELECT domain || '_' || client_id || '_' || CAST(floor(lon / 30) AS BIGINT) || '_' || CAST(floor(lat / 30) AS BIGINT) FROM records WHERE uid = 7)"))
def cluster_of_record(s, d):
    own = fx.records(s, d).where("uid = 7").select(fx.cluster_cell().alias("cluster_id"))
    return fx.clusters(s, d).join(own, "cluster_id", "left_semi").select("cluster_id", "domain", "uir_count")


@query("cross_domain_clusters", fx.with_sql("clusters records", "SELECT c.cluster_id, c.uir_count, count(*) FILTER (source_type = 'OSINT') AS n_osint, count(*) FILTER (source_type = 'GEOINT') AS n_geoint, count(*) FILTER (source_type = 'SIGINT') AS n_sigint FROM clusters c JOIN records r ON r.domain = c.domain AND floor(r.lon / 30) = floor(c.lon / 30) AND floor(r.lat / 30) = floor(c.lat / 30) GROUP BY c.cluster_id, c.uir_count HAVING n_osint > 0 AND n_geoint > 0 AND n_sigint > 0"))
def cross_domain_clusters(s, d):
    cell = lambda df, *more: df.where("domain is not null and lon is not null").select(*more, "domain", F.floor(F.col("lon") / 30).alias("x"), F.floor(F.col("lat") / 30).alias("y"))
    met = cell(fx.clusters(s, d), "cluster_id", "uir_count").join(cell(fx.records(s, d), "source_type"), ["domain", "x", "y"])
    return rollup.cross_domain(met, ["cluster_id", "uir_count"], ("OSINT", "GEOINT", "SIGINT"))


@query("polygon_flights", fx.with_sql("flights records", f"SELECT event_id, uid, round(m / 1000, 3) AS distance_km FROM (SELECT event_id, uid, anomaly_score, {_hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} AS m FROM (SELECT * FROM flights WHERE anomaly_score > 0.7 AND ((((0.0 > lat) <> (40.0 > lat)) AND lon < 50.0 + (lat - 0.0) * -0.625)::INT + (((40.0 > lat) <> (0.0 > lat)) AND lon < 25.0 + (lat - 40.0) * 0.625)::INT) % 2 = 1) f LEFT JOIN records r ON {_hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} <= 300000) ORDER BY anomaly_score DESC, event_id, m NULLS FIRST, uid LIMIT 20"))
def polygon_flights(s, d):
    odd = fx.flights(s, d).where(spatial.in_polygon([(0.0, 0.0), (50.0, 0.0), (25.0, 40.0)]) & (F.col("anomaly_score") > 0.7)).select("event_id", "anomaly_score", "lon", "lat")
    met = spatial.radius_join(odd, fx.records(s, d).select("uid", "lon", "lat"), 300_000, how="left")
    return met.orderBy(F.desc("anomaly_score"), "event_id", F.col("distance_m").asc_nulls_first(), "uid").limit(20).select("event_id", "uid", F.round(F.col("distance_m") / 1000, 3).alias("distance_km"))


@query("cluster_titles", fx.with_sql("clusters entities", f"SELECT cluster_id, domain || CASE WHEN name IS NULL THEN ' activity' ELSE ' activity near ' || name END AS title FROM (SELECT c.cluster_id, c.domain, e.name, row_number() OVER (PARTITION BY cluster_id ORDER BY {_hav('c.lon', 'c.lat', 'e.lon', 'e.lat')}, entity_id) AS n FROM clusters c LEFT JOIN entities e ON entity_type = 'LOCATION' AND {_hav('c.lon', 'c.lat', 'e.lon', 'e.lat')} <= 1500000) WHERE n = 1"))
def cluster_titles(s, d):
    places = fx.entities(s, d).where("entity_type = 'LOCATION'")
    near = spatial.nearest(fx.clusters(s, d).select("cluster_id", "lon", "lat"), places.select("entity_id", "lon", "lat"), "cluster_id", "entity_id", 1_500_000)
    named = fx.clusters(s, d).join(near, "cluster_id", "left").join(places.select("entity_id", "name"), "entity_id", "left")
    return named.select("cluster_id", F.concat("domain", F.when(F.col("name").isNull(), " activity").otherwise(F.concat(F.lit(" activity near "), "name"))).alias("title"))


# -- writes -------------------------------------------------------------------------------------


@query("point_update", fx.with_sql("queue", "SELECT queue_id, CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'FAILED' THEN 'retry' END AS note FROM queue"))
def point_update(s, d):
    q = fx.queue(s, d).select("queue_id", "status", F.lit(None).cast("string").alias("note"))
    change = q.where("status = 'FAILED'").select("queue_id", F.lit("PENDING").alias("status"), F.lit("retry").alias("note"))
    return ingest.upsert(q, change.union(change), "queue_id")


@query("upsert_by_name", "SELECT name, max(n)::BIGINT AS n FROM (SELECT n_name AS name, n_nationkey AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_name, n_nationkey + 100 FROM nation WHERE n_regionkey < 3) GROUP BY name")
def upsert_by_name(s, d):
    rows = fx.read(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("n"), "n_regionkey")
    new = rows.where("n_regionkey < 3").select("name", (F.col("n") + 100).alias("n"))
    return ingest.upsert(rows.where("n_regionkey <> 1").select("name", "n"), new.union(new.withColumn("n", F.col("n") - 200)), "name")


@query("mission_by_category", fx.with_sql("missions", "SELECT category, min(focus_id) FILTER (is_active) AS active, bool_or(false) AS is_active FROM missions GROUP BY category"))
def mission_by_category(s, d):
    from meridian.operators import fusion

    m = fx.missions(s, d)
    picked = m.groupBy("category").agg(F.min(F.when(F.col("is_active"), F.col("focus_id"))).alias("active"))
    off = fusion.deactivate(m).groupBy("category").agg(F.max("is_active").alias("is_active"))
    return picked.join(off, "category")


@query("tenant_edges", fx.with_sql("edges", "SELECT edge_id, type FROM edges WHERE ['c1', 'c2', 'global'][mention_count % 3 + 1] IN ('c1', 'global')"))
def tenant_edges(s, d):
    from meridian.tools import tenant_view

    owner = F.element_at(F.array(F.lit("c1"), F.lit("c2"), F.lit(schemas.GLOBAL_CLIENT)), (F.col("mention_count") % 3 + 1).cast("int"))
    return tenant_view(fx.edges(s, d).withColumn("client_id", owner), "c1").select("edge_id", "type")
