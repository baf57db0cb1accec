"""Fusion parts on small frames: mentions, jobs, enrichment, density groups, cascades."""

import math
import random

from pyspark.sql import functions as F

from meridian.functions.geo import EARTH_M
from meridian.operators import fusion


def test_mentions_pairs_and_jobs(spark):
    r = spark.createDataFrame([(1, "Acme met Zeta. acme left.", "s", "c", 1), (2, None, "s", "c", 2), (3, "zeta ACME", "t", None, 3)], "uid long, content_raw string, source_name string, client_id string, created_at int")
    gaz = spark.createDataFrame([("Acme", "E1"), ("Zeta", "E2")], "name string, entity_id string")
    got = sorted(map(tuple, fusion.mentions(r, gaz).collect()))
    assert got == [(1, "E1", 0), (1, "E2", 2), (3, "E1", 1), (3, "E2", 0)]
    jobs = spark.createDataFrame([(10, 1), (11, 99)], "queue_id long, uir_uid long")
    src = spark.createDataFrame([("s", 0.2)], "source_name string, trust_score double")
    status, edges = fusion.fuse(jobs, r, gaz, src)
    assert sorted(map(tuple, status.collect())) == [(10, "DONE", None), (11, "FAILED", "UIR record missing")]
    assert [(e.a, e.b, round(e.confidence, 6)) for e in edges.collect()] == [("E1", "E2", 0.12)]
    assert fusion.evidence_of(fusion.co_mentions(fusion.mentions(r, gaz)), r, src, "INVENTED").count() == 0


def test_enrich_backfill_cascade(spark):
    e = spark.createDataFrame([("a", "Acme", None, None, 0.3, None), ("b", "Beta", "old", ["x"], 0.9, [1.0])], "entity_id string, name string, description string, aliases array<string>, confidence double, embedding array<double>")
    got = {r.entity_id: (r.description, r.aliases, r.confidence) for r in fusion.enrich(e, spark.createDataFrame([("a", "new", ["y", "y"])], "entity_id string, description string, aliases array<string>")).collect()}
    assert got == {"a": ("new", ["y", "y"], 0.8), "b": ("old", ["x"], 0.9)}
    assert [(r.entity_id, len(r.embedding)) for r in fusion.backfill_embeddings(e).collect()] == [("a", 64)]
    kids = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "k int, p string")
    assert sorted(r.k for r in fusion.cascade(kids, e, "p", "entity_id").collect()) == [1]
    assert sorted((r.k, r.p) for r in fusion.cascade(kids, e, "p", "entity_id", "null").collect()) == [(1, "a"), (2, None), (3, None)]
    m = spark.createDataFrame([(1, True)], "id int, is_active boolean")
    assert not fusion.deactivate(m).first().is_active


def test_density_groups_equal_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 3), rng.uniform(50, 52)) for i in range(60)] + [(99, None, 1.0)]
    df = spark.createDataFrame(pts, "uid long, lon double, lat double")

    def dist(p, q):
        x = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * EARTH_M * math.asin(math.sqrt(x))

    ok = [p for p in pts if p[1] is not None]
    near = {p[0]: [q for q in ok if dist(p, q) <= 25_000] for p in ok}
    core = {i for i, n in near.items() if len(n) >= 4}
    label = {i: i for i in core}
    for _ in range(60):
        label = {i: min([label[i], *(label[q[0]] for q in near[i] if q[0] in core)]) for i in core}
    want = {}
    for p in pts:
        i = p[0]
        close = [(dist(p, q), q[0]) for q in near.get(i, ()) if q[0] in core]
        want[i] = label[i] if i in core else label[min(close)[1]] if close else None
    got = {r.uid: r.group_id for r in fusion.density_groups(df, 25_000, 4).collect()}
    assert got == want and len(set(filter(None, want.values()))) > 1


def test_session_start_and_derived(spark):
    c = spark.sql("SELECT 'k' AS cluster_id, 'MILITARY' AS domain, 'g' AS client_id, 5L AS uir_count, 1.0D AS lon, 2.0D AS lat, timestamp_ntz'2024-01-01 00:00:00' AS updated_at, 'CRITICAL' AS priority, 'ACTIVE' AS status")
    q = spark.createDataFrame([("PENDING",), ("FAILED",), ("PENDING",)], "status string")
    assert tuple(fusion.session_start(c, q, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).first()) == (2, 1, 1, 1)
    assert fusion.derived_records(c).first().content_headline == "MILITARY activity: 5 reports"


def test_density_groups_pair_places_and_not_rows(spark, monkeypatch):
    spots = [(i, float(i % 4 // 2) * 5, 50.0 + i % 2 * 0.01) for i in range(400)] + [(400, 40.0, 10.0), (401, None, 1.0)]
    seen, join = [], fusion.spatial.radius_join
    monkeypatch.setattr(fusion.spatial, "radius_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    got = {r.uid: (r.group_id, r.core) for r in fusion.density_groups(spark.createDataFrame(spots, "uid long, lon double, lat double"), 25_000, 4).collect()}
    assert got == {i: (i % 4 // 2 * 2, True) for i in range(400)} | {400: (None, False), 401: (None, False)}
    assert seen[0].count() == 9


def test_mentions_shuffle_names_only(spark):
    texts = [(1, "Oslo and acme, ACME"), (2, "nothing"), (3, None), (4, "acme oslo")]
    df = spark.createDataFrame(texts, "uid long, content_raw string")
    found = fusion.mentions(df, spark.createDataFrame([("Acme", "E1"), ("Oslo", "E2"), ("acme", "E3")], "name string, entity_id string"))
    assert sorted(map(tuple, found.collect())) == [(1, "E1", 2), (1, "E2", 0), (1, "E3", 2), (4, "E1", 0), (4, "E2", 1), (4, "E3", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Aggregate")
