"""Adapters from the driver's tables to domain tables, and the same arithmetic as SQL.

``frame(name)`` builds a DataFrame; ``with_sql(names, body)`` prefixes a query with the matching
common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The moment that stands for "now" in every query.
AS_OF = "2024-01-31 00:00:00"
MISSIONS = (("m1", "MILITARY", ("the onth", "was er"), ("thon",), True), ("m2", "FINANCIAL", ("aux quel",), (), True), ("m3", "POLITICAL", ("der ver",), ("heit",), False))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def flights(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("ts").alias("time"), F.col("user_id").cast("string").alias("icao24"), "event_id", ((F.col("user_id") * 37 + F.col("event_id") * 11) % 3600 / 10.0 - 180.0).alias("lon"), ((F.col("user_id") * 53 + F.col("event_id") * 7) % 1700 / 10.0 - 85.0).alias("lat"), F.when(F.col("event_type") == "error", "7700").alias("squawk"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("anomaly_score"))


def records(spark, d):
    r, k = read(spark, d, "documents"), F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (k % n + 1).cast("int"))
    return r.select(k.alias("uid"), F.timestamp_add("MINUTE", k, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"), F.substring("text", 1, 60).alias("content_headline"), F.col("text").alias("content_raw"), F.col("source").alias("source_name"), F.sha2("text", 256).alias("content_hash"), pick(("OSINT", "GEOINT", "SIGINT"), 3).alias("source_type"), pick(("global", "c1", "c2"), 3).alias("client_id"), pick(("MILITARY", "FINANCIAL", "POLITICAL", "MARITIME", None), 5).alias("domain"), pick(("CRITICAL", "HIGH", "NORMAL", "LOW", "NORMAL", "HIGH", None), 7).alias("priority"), pick(("m1", "m2", "m3", None), 4).alias("mission_id"), (k % 100 / 100.0).alias("confidence"), (k % 2 == 0).alias("verified"), F.when(k % 11 != 0, (k * 37) % 3600 / 10.0 - 180.0).alias("lon"), F.when(k % 11 != 0, (k * 53) % 1700 / 10.0 - 85.0).alias("lat"))


def sources(spark, d):
    s = read(spark, d, "documents").select("source").distinct()
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return s.where(n % 4 != 3).select(F.col("source").alias("source_name"), (n % 10 / 10.0).alias("trust_score"))


def missions(spark, d):
    return spark.createDataFrame([(a, b, list(c), list(t), e) for a, b, c, t, e in MISSIONS], "focus_id string, category string, keywords array<string>, target_entities array<string>, is_active boolean")


def entities(spark, d):
    part = lambda t, p, key, name, nation, bal, kind: read(spark, d, t).select(F.concat(F.lit(p), F.col(key)).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), (F.col(key) * 7 % 100 / 100.0).alias("confidence"), (F.col(key) * 13 % 100 / 100.0).alias("threat_score"), (F.col(key) * 3 % 50).cast("long").alias("mention_count"), F.timestamp_add("HOUR", F.col(key) % 720, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("last_seen"), (F.col(key) * 97 % 3600 / 10.0 - 180.0).alias("lon"), (F.col(key) * 41 % 1600 / 10.0 - 80.0).alias("lat"))
    return part("nation", "N", "n_nationkey", "n_name", "n_regionkey", None, "LOCATION").unionByName(part("supplier", "S", "s_suppkey", "s_name", "s_nationkey", "s_acctbal", "ORGANIZATION")).unionByName(part("customer", "C", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "PERSON"))


def evidence(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return j.select(F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"), F.col("l_returnflag").alias("type"), F.lit("global").alias("client_id"), F.col("o_orderkey").alias("uid"), F.col("o_orderdate").alias("ts"), (F.substring("o_orderpriority", 1, 1).cast("int") / 10.0).alias("trust"))


def edges(spark, d):
    """Stored relationships: a supplier pair of each two successive lines of every order. The id
    tells order and first line: pairs that start at line 1 have the order's key."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", F.dense_rank().over(order).alias("i"))
    one = li.select("l_orderkey", "i", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("x"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("type"))
    two = li.select("l_orderkey", (F.col("i") - 1).alias("i"), F.col("l_suppkey").alias("y"))
    edge_id = F.col("l_orderkey") + (F.col("line").cast("long") - 1) * F.lit(1 << 40)
    return one.join(two, ["l_orderkey", "i"]).select(edge_id.alias("edge_id"), F.concat(F.lit("S"), "x").alias("a"), F.concat(F.lit("S"), "y").alias("b"), "type", (F.col("q") / 50.0).alias("confidence"), (F.col("l_orderkey") % 3 != 0).alias("still_valid"), F.timestamp_add("HOUR", F.col("l_orderkey") % 720, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("last_confirmed"), (F.col("l_orderkey") % 7).alias("mention_count"))


def queue(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "PROCESSING").otherwise("PENDING")
    level = F.when(F.col("value") > 200, "CRITICAL").when(F.col("value") > 80, "HIGH").otherwise("NORMAL")
    return e.select(F.col("event_id").alias("queue_id"), F.col("ts").alias("created_at"), status.alias("status"), level.alias("priority"), F.concat(F.lit("agent"), F.col("user_id") % 5).alias("agent"))


def cluster_cell():
    """The id of a record's cluster."""
    return F.concat_ws("_", "domain", "client_id", F.floor(F.col("lon") / 30).cast("string"), F.floor(F.col("lat") / 30).cast("string"))


def clusters(spark, d):
    """One cluster a cell of thirty degrees, domain and client of records with a place and domain."""
    r = records(spark, d).where("lon is not null and domain is not null")
    g = r.groupBy(cluster_cell().alias("cluster_id"), "domain", "client_id").agg(F.count("*").alias("uir_count"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.max("created_at").alias("updated_at"), F.max(F.coalesce(F.col("priority") == "CRITICAL", F.lit(False))).alias("hot"))
    return g.select("cluster_id", "domain", "client_id", "uir_count", "lon", "lat", "updated_at", F.when(F.col("hot"), "CRITICAL").otherwise("NORMAL").alias("priority"), F.when(F.col("uir_count") >= 2, "ACTIVE").otherwise("DORMANT").alias("status"))


_T0 = "TIMESTAMP '2024-01-01 00:00:00'"
_LINES = "SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem"


def _entity_sql(table, prefix, key, name, kind):
    return f"SELECT '{prefix}' || {key} AS entity_id, '{kind}' AS entity_type, {name} AS name, {key} * 7 % 100 / 100.0::DOUBLE AS confidence, {key} * 13 % 100 / 100.0::DOUBLE AS threat_score, ({key} * 3 % 50)::BIGINT AS mention_count, {_T0} + to_hours(({key} % 720)::BIGINT) AS last_seen, {key} * 97 % 3600 / 10.0::DOUBLE - 180.0::DOUBLE AS lon, {key} * 41 % 1600 / 10.0::DOUBLE - 80.0::DOUBLE AS lat FROM {table}"


SQL = {
    "flights": "SELECT ts AS time, CAST(user_id AS VARCHAR) AS icao24, event_id, (user_id * 37 + event_id * 11) % 3600 / 10.0::DOUBLE - 180.0::DOUBLE AS lon, (user_id * 53 + event_id * 7) % 1700 / 10.0::DOUBLE - 85.0::DOUBLE AS lat, CASE WHEN event_type = 'error' THEN '7700' END AS squawk, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS anomaly_score FROM events",
    "records": f"SELECT doc_id AS uid, {_T0} + to_minutes(doc_id) AS created_at, substr(text, 1, 60) AS content_headline, text AS content_raw, source AS source_name, sha256(text) AS content_hash, ['OSINT', 'GEOINT', 'SIGINT'][doc_id % 3 + 1] AS source_type, ['global', 'c1', 'c2'][doc_id % 3 + 1] AS client_id, ['MILITARY', 'FINANCIAL', 'POLITICAL', 'MARITIME', NULL][doc_id % 5 + 1] AS domain, ['CRITICAL', 'HIGH', 'NORMAL', 'LOW', 'NORMAL', 'HIGH', NULL][doc_id % 7 + 1] AS priority, ['m1', 'm2', 'm3', NULL][doc_id % 4 + 1] AS mission_id, doc_id % 100 / 100.0::DOUBLE AS confidence, doc_id % 2 = 0 AS verified, CASE WHEN doc_id % 11 <> 0 THEN doc_id * 37 % 3600 / 10.0::DOUBLE - 180.0::DOUBLE END AS lon, CASE WHEN doc_id % 11 <> 0 THEN doc_id * 53 % 1700 / 10.0::DOUBLE - 85.0::DOUBLE END AS lat FROM documents",
    "sources": "SELECT source AS source_name, n % 10 / 10.0::DOUBLE AS trust_score FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS n FROM documents) WHERE n % 4 <> 3",
    "missions": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {list(c)}::VARCHAR[], {list(t)}::VARCHAR[], {str(e).lower()})" for a, b, c, t, e in MISSIONS) + ") AS t(focus_id, category, keywords, target_entities, is_active)",
    "entities": " UNION ALL ".join((_entity_sql("nation", "N", "n_nationkey", "n_name", "LOCATION"), _entity_sql("supplier", "S", "s_suppkey", "s_name", "ORGANIZATION"), _entity_sql("customer", "C", "c_custkey", "c_name", "PERSON"))),
    "evidence": "SELECT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, l_returnflag AS type, 'global' AS client_id, o_orderkey AS uid, o_orderdate AS ts, CAST(substr(o_orderpriority, 1, 1) AS INT) / 10.0::DOUBLE AS trust FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "edges": f"SELECT o.l_orderkey + (o.l_linenumber - 1)::BIGINT * 1099511627776 AS edge_id, 'S' || o.l_suppkey AS a, 'S' || t.l_suppkey AS b, o.l_returnflag AS type, o.l_quantity / 50.0::DOUBLE AS confidence, o.l_orderkey % 3 <> 0 AS still_valid, {_T0} + to_hours(o.l_orderkey % 720) AS last_confirmed, o.l_orderkey % 7 AS mention_count FROM ({_LINES}) o JOIN ({_LINES}) t ON o.l_orderkey = t.l_orderkey AND t.i = o.i + 1",
    "queue": "SELECT event_id AS queue_id, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING' ELSE 'PENDING' END AS status, CASE WHEN value > 200 THEN 'CRITICAL' WHEN value > 80 THEN 'HIGH' ELSE 'NORMAL' END AS priority, 'agent' || (user_id % 5) AS agent FROM events",
}
SQL["clusters"] = f"SELECT cluster_id, domain, client_id, uir_count, lon, lat, updated_at, CASE WHEN hot THEN 'CRITICAL' ELSE 'NORMAL' END AS priority, CASE WHEN uir_count >= 2 THEN 'ACTIVE' ELSE 'DORMANT' END AS status FROM (SELECT domain || '_' || client_id || '_' || CAST(floor(lon / 30) AS BIGINT) || '_' || CAST(floor(lat / 30) AS BIGINT) AS cluster_id, domain, client_id, count(*) AS uir_count, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, max(created_at) AS updated_at, bool_or(coalesce(priority = 'CRITICAL', false)) AS hot FROM ({SQL['records']}) WHERE lon IS NOT NULL AND domain IS NOT NULL GROUP BY ALL)"


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the adapters in ``names`` (blank-separated) as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().removeprefix('+')}"
