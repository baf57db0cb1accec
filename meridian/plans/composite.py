"""Composite pipelines over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.operators import fusion
from meridian.plans import fixtures as fx
from meridian.plans.analytics import _hav
from meridian.plans.registry import query

_NAMES = (("tion", "E1"), ("thing", "E2"), ("ches", "E3"), ("euxque", "E4"), ("hein", "E5"), ("ofer", "E6"), ("andor", "E7"), ("lynt", "E8"), ("with", "E9"))
_GAZ = "gaz AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NAMES) + ") AS t(word, entity_id))"
_MENTIONS = _GAZ + r""", mention AS (SELECT uid, entity_id, min(i) AS position FROM (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT uid, regexp_split_to_array(lower(content_raw), '[^\p{L}\p{N}]+') AS w FROM records)) JOIN gaz USING (word) GROUP BY uid, entity_id),
o AS (SELECT uid, entity_id, row_number() OVER (PARTITION BY uid ORDER BY position, entity_id) AS n FROM mention),
pairs AS (SELECT DISTINCT x.uid, x.entity_id AS a, y.entity_id AS b FROM o x JOIN o y ON x.uid = y.uid AND y.n BETWEEN x.n + 1 AND x.n + 3)"""


def _gazetteer(s):
    return s.createDataFrame(list(_NAMES), "name string, entity_id string")


@query("entity_mentions", fx.with_sql("records", "+ " + _MENTIONS + " SELECT entity_id, count(*) AS n, sum(position)::BIGINT AS positions FROM mention GROUP BY entity_id"))
def entity_mentions(s, d):
    return fusion.mentions(fx.records(s, d), _gazetteer(s)).groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


@query("fusion_relations", fx.with_sql("records sources", "+ " + _MENTIONS + """,
e AS (SELECT a, b, client_id, r.uid, created_at AS ts, coalesce(trust_score, 0.5::DOUBLE) AS trust FROM pairs JOIN records r USING (uid) LEFT JOIN sources USING (source_name)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, client_id ORDER BY ts, uid) AS i FROM e)
SELECT a, b, client_id, round(least(0.98, max(CASE WHEN i = 1 THEN 0.6 * trust END) + 0.2 * sum(CASE WHEN i > 1 THEN trust ELSE 0 END)), 6) AS confidence, count(*) AS evidence_count FROM f GROUP BY a, b, client_id"""))
def fusion_relations(s, d):
    r = fx.records(s, d)
    jobs = r.select(F.col("uid").alias("queue_id"), F.col("uid").alias("uir_uid"))
    _, found = fusion.fuse(jobs, r, _gazetteer(s), fx.sources(s, d))
    return found.select("a", "b", "client_id", F.round("confidence", 6).alias("confidence"), "evidence_count")


@query("fusion_job_status", fx.with_sql("queue records", "SELECT queue_id, CASE WHEN uid IS NULL THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN uid IS NULL THEN 'UIR record missing' END AS error_message FROM queue LEFT JOIN records ON uid = queue_id * 2 WHERE queue.status = 'PENDING'"))
def fusion_job_status(s, d):
    jobs = fx.queue(s, d).where("status = 'PENDING'").select("queue_id", (F.col("queue_id") * 2).alias("uir_uid"))
    return fusion.fuse(jobs, fx.records(s, d), _gazetteer(s), fx.sources(s, d))[0]


@query("feedback_filter", fx.with_sql("edges", "SELECT edge_id FROM edges WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 0 AND a = 'S' || (l.doc_id % 97) AND b = 'S' || (l.doc_id % 89))"))
def feedback_filter(s, d):
    bad = fx.read(s, d, "labels").where("quality = 0")
    f = bad.select(F.lit("REJECTED_WRONG").alias("feedback_type"), F.concat(F.lit("S"), F.col("doc_id") % 97).alias("original_subject"), F.explode(F.array(*map(F.lit, "ANR"))).alias("original_predicate"), F.concat(F.lit("S"), F.col("doc_id") % 89).alias("original_object"))
    return fusion.without_rejected(fx.edges(s, d), f).select("edge_id")


@query("derived_records", fx.with_sql("clusters", "SELECT sha256('derived:' || cluster_id) AS uid, 'DERIVED' AS source_type, domain || ' activity: ' || uir_count || ' reports' AS content_headline, client_id FROM clusters WHERE uir_count >= 3 AND status = 'ACTIVE'"))
def derived_records(s, d):
    return fusion.derived_records(fx.clusters(s, d)).select("uid", "source_type", "content_headline", "client_id")


@query("mixed_pattern", fx.with_sql("edges", "+ y AS (SELECT a AS src, b AS dst FROM edges WHERE type IN ('A', 'R') UNION SELECT b, a FROM edges WHERE type IN ('A', 'R')), n AS (SELECT dst AS node FROM y WHERE src = 'S9' UNION SELECT q.dst FROM y p JOIN y q ON p.src = 'S9' AND p.dst = q.src) SELECT DISTINCT node, b AS target FROM n JOIN edges ON a = node AND type = 'N'"))
def mixed_pattern(s, d):
    return fusion.mixed_pattern(fx.edges(s, d), "S9", ["A", "R"], "N")


@query("cascade_delete", fx.with_sql("edges entities", "SELECT edge_id FROM edges WHERE a IN (SELECT entity_id FROM entities WHERE confidence >= 0.4) AND b IN (SELECT entity_id FROM entities WHERE confidence >= 0.4)"))
def cascade_delete(s, d):
    keep = fx.entities(s, d).where("confidence >= 0.4")
    return fusion.cascade(fusion.cascade(fx.edges(s, d), keep, "a", "entity_id"), keep, "b", "entity_id").select("edge_id")


@query("cascade_null", fx.with_sql("records missions", "SELECT uid, focus_id AS mission_id FROM records LEFT JOIN missions ON mission_id = focus_id AND is_active"))
def cascade_null(s, d):
    return fusion.cascade(fx.records(s, d).select("uid", "mission_id"), fx.missions(s, d).where("is_active"), "mission_id", "focus_id", "null")


@query("session_start", fx.with_sql("clusters queue", f"SELECT (SELECT count(*) FROM queue WHERE status = 'PENDING') AS pending, (SELECT count(*) FROM queue WHERE status = 'FAILED') AS failed, count(*) FILTER (priority = 'CRITICAL' AND status = 'ACTIVE') AS critical, count(*) FILTER (updated_at > TIMESTAMP '{fx.AS_OF}' - INTERVAL 24 HOUR) AS last_day FROM clusters"))
def session_start(s, d):
    return fusion.session_start(fx.clusters(s, d), fx.queue(s, d), fx.as_of())


_NEAR = _hav("a.lon", "a.lat", "b.lon", "b.lat")


@query("density_groups", fx.with_sql("records", f"""+ n AS (SELECT a.uid AS i, b.uid AS j, {_NEAR} AS m FROM records a JOIN records b ON {_NEAR} <= 700000),
c AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 4), l AS (SELECT n.i, n.j FROM n JOIN c x ON x.i = n.i JOIN c y ON y.i = n.j),
t AS (SELECT i, i AS g FROM c UNION SELECT t.i, l.j FROM t JOIN l ON t.g = l.i), g AS (SELECT i, min(g) AS g FROM t GROUP BY i),
b AS (SELECT i, g FROM (SELECT n.i, g.g, row_number() OVER (PARTITION BY n.i ORDER BY m, j) AS k FROM n JOIN g ON g.i = n.j) WHERE k = 1)
SELECT uid, coalesce(g.g, b.g) AS group_id, g.g IS NOT NULL AS core FROM records LEFT JOIN g ON g.i = uid LEFT JOIN b ON b.i = uid""", True))
def density_groups(s, d):
    return fusion.density_groups(fx.records(s, d).select("uid", "lon", "lat"), 700_000, 4)
