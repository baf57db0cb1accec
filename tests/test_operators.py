"""Core operators on tiny hand-made frames with exact results, nulls and ties included."""

import math

from pyspark.sql import functions as F

from meridian import models, tools
from meridian.functions import geo, text, vector
from meridian.operators import clusters, graph, ingest, relations, resolve, rollup, spatial
from meridian.schemas import GLOBAL_CLIENT, validate


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_validate_splits_and_null_passes(spark):
    df = spark.createDataFrame([("a", "HIGH", 0.5), ("b", "URGENT", 0.5), ("c", None, None), ("d", "LOW", 1.5)], "uid string, priority string, confidence double")
    good, bad = validate(df)
    assert rows(good, "uid") == [("a",), ("c",)]
    assert rows(bad, "uid", F.array_join("violations", ",")) == [("b", "priority"), ("d", "confidence")]


def test_insert_if_absent_keeps_null_hashes(spark):
    old = spark.createDataFrame([("h1",)], "h string")
    new = spark.createDataFrame([("h1", 1), ("h2", 3), ("h2", 2), (None, 4), (None, 5)], "h string, uid int")
    assert rows(ingest.insert_if_absent(new, old, ["h"], "uid"), "h", "uid") == [("h2", 2), (None, 4), (None, 5)]


def test_insert_if_absent_any_key(spark):
    old = spark.createDataFrame([("u1", "h9")], "source_url string, content_hash string")
    new = spark.createDataFrame([("u1", "h1"), ("u2", "h9"), ("u3", "h3"), ("u4", "h3")], "source_url string, content_hash string")
    assert rows(ingest.insert_if_absent_any(new, old, ["source_url", "content_hash"], "source_url"), "source_url") == [("u3",)]


def test_news_records(spark):
    items = spark.createDataFrame([("u1", "War near Port", None), ("u2", "Bank results", "good"), ("u3", "Quiet day", "x"), ("u3b", "quiet DAY x", None), (None, "lost", "y")], "source_url string, title string, description string")
    missions = spark.createDataFrame([("m2", ["port"], None, True), ("m1", ["bank"], None, False)], "focus_id string, keywords array<string>, target_entities array<string>, is_active boolean")
    known = spark.createDataFrame([], "source_url string, content_hash string")
    got = rows(ingest.news_records(items, missions, known), "source_url", "mission_id", "domain", "priority")
    assert got == [("u1", "m2", "MILITARY", "HIGH"), ("u2", None, "FINANCIAL", "NORMAL"), ("u3", None, "POLITICAL", "NORMAL")]


def test_seismic_and_flights(spark):
    e = spark.createDataFrame([("a", 5.0, 1), ("b", 4.9, 1), ("c", None, 1), ("k", 7.0, 1)], "usgs_id string, magnitude double, time int")
    got = ingest.seismic_records(e, spark.createDataFrame([("k",)], "usgs_id string"))
    assert rows(got, "usgs_id", "priority") == [("a", "HIGH"), ("b", "NORMAL")]
    t = spark.sql("SELECT * FROM VALUES ('x', timestamp'2024-01-01 10:05:00', NULL, 'A'), ('x', timestamp'2024-01-01 10:55:00', '7700', 'A'), ('x', timestamp'2024-01-01 11:00:00', '7700', 'A') AS t(icao24, time, squawk, callsign)")
    assert rows(ingest.flight_records(t, "A"), F.hour("time"), "priority") == [(10, "HIGH"), (11, "CRITICAL")]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "ab " * 700), (2, ""), (3, None), (4, "  x ")], "id int, t string")
    got = rows(ingest.document_chunks(df, "t"), "id", "part", "parts", F.length("chunk"))
    assert got == [(1, 1, 2, 1500), (1, 2, 2, 799), (4, 1, 1, 1)]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id int, n string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 6.0)], "id int, n string, v double")
    assert rows(ingest.upsert(old, new, "id"), "id", "n", "v") == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 6.0)]
    assert rows(ingest.delete_where(old, F.col("v") < 2), "id") == [(2,)]


def _hav(a, b, c, d):
    x = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, x)))


def test_radius_join_equals_brute_force_at_edges(spark):
    pts = [(i, lon, lat) for i, (lon, lat) in enumerate([(179.9, 0.0), (-179.9, 0.1), (0.0, 89.5), (120.0, 89.6), (0.0, -90.0), (10.0, 60.0), (11.0, 60.2), (9.2, 59.9), (None, 1.0), (0.0, 0.0), (0.4, 0.4)])]
    left = spark.createDataFrame(pts, "i int, lon double, lat double")
    right = spark.createDataFrame([(i, x, y) for i, x, y in pts], "j int, lon double, lat double")
    got = rows(spatial.radius_join(left, right, 100_000), "i", "j")
    want = sorted((a[0], b[0]) for a in pts for b in pts if None not in (*a, *b) and _hav(a[1], a[2], b[1], b[2]) <= 100_000)
    assert got == sorted(want, key=repr)
    near = rows(spatial.nearest(left.where("i = 5"), right.where("j <> 5"), "i", "j", 100_000), "i", "j")
    assert near == [(5, 7)]


def test_resolve_rules(spark):
    c = spark.createDataFrame([("a", 1, 0.0, 2, 0.5, None, True), ("b", 1, 0.9, 2, 0.9, None, True), ("c", 1, 0.5, 2, 0.8, 200000.0, True), ("d", None, None, 2, 0.6, None, False), ("e", 1, 0.45, None, None, None, None), ("f", None, None, 2, 0.86, 99.0, False)], "uid string, lex_id int, lex_sim double, sem_id int, sem_sim double, sem_distance_m double, verified boolean")
    got = rows(resolve.decide(c), "uid", "best_id")
    assert got == [("a", 2), ("b", 1), ("c", 1), ("d", None), ("e", None), ("f", 2)]
    assert rows(resolve.deltas(resolve.decide(c)), "entity_id", "mentions") == [(1, 2), (2, 2)]


def test_accrual_matches_sequential_fold(spark):
    ev = [("a", "b", "T", "g", u, t, tr) for u, t, tr in ((1, 1, 0.2), (2, 2, None), (2, 3, 0.9), (3, 4, 1.0))] + [("a", "b", "T", None, 1, 1, 0.5)] * 2
    got = rows(relations.accrue(spark.createDataFrame(ev, "a string, b string, type string, client_id string, uid int, ts int, trust double")), F.round("confidence", 9), "evidence_count", "mention_count")
    assert got == [(0.3, 1, 1), (0.3, 1, 1), (0.42, 3, 4)]


def test_decay_prune_first_sweep_traps(spark):
    e = spark.sql("SELECT id, c, timestamp'2024-01-01' AS last_confirmed, v FROM VALUES (1, 0.05D, true), (2, 0.1D, true), (3, 0.2D, true), (4, 0.3D, true), (5, 0.5D, true), (6, 0.35D, false) AS t(id, c, v)").withColumnRenamed("c", "confidence").withColumnRenamed("v", "still_valid")
    at = F.lit("2024-01-08 00:00:01").cast("timestamp")
    assert rows(relations.prune(relations.decay(e, at)), "id") == [(5,), (6,)]
    exactly = F.lit("2024-01-08 00:00:00").cast("timestamp")
    assert rows(relations.prune(relations.decay(e, exactly)), "id") == [(2,), (3,), (4,), (5,), (6,)]


def test_merge_entities(spark):
    e = spark.createDataFrame([("x", "y", "T", 0.4, 1), ("z", "y", "T", 0.6, 2), ("x", "z", "T", 0.9, 1)], "a string, b string, type string, confidence double, mention_count int")
    got = relations.merge_entities(e, spark.createDataFrame([("z", "x")], "secondary string, primary string"))
    assert rows(got, "a", "b", "confidence", "mention_count") == [("x", "y", 0.6, 3)]


def test_trails_and_expansion(spark):
    e = spark.createDataFrame([(1, "A", "B", "T", 0.9), (2, "B", "C", "T", 0.5), (3, "C", "D", "U", 0.6), (4, "A", "A", "S", 0.9)], "edge_id long, a string, b string, type string, confidence double")
    roots = spark.createDataFrame([("A",)], "root string")
    assert rows(graph.trails(e, roots, 3), "connected", "first_type", "length") == sorted([("B", "T", 1), ("A", "S", 1), ("C", "T", 2), ("B", "S", 2), ("C", "S", 3), ("D", "T", 3)], key=repr)
    assert rows(graph.reach(e, roots, 2), "node", "distance") == [("A", 0), ("B", 1), ("C", 2)]
    assert (3, 3) in rows(graph.expansion(e, roots, 3), "edge_id", "hop")
    names = spark.createDataFrame([(x, "n" + x) for x in "ABCD"], "entity_id string, name string")
    assert rows(graph.edge_view(e, names, 0.5), "subject", "object") == [("nA", "nA"), ("nA", "nB"), ("nC", "nD")]


def test_leader_clusters(spark):
    recs = [(1, "c", "M", 1, 10.0, 50.0, [1.0, 0.0]), (2, "c", "M", 2, 10.1, 50.0, [1.0, 0.1]), (3, "c", "M", 3, 10.1, 50.0, [0.0, 1.0]), (4, "c", "M", 4, 40.0, 50.0, [1.0, 0.0]), (5, "c", None, 5, 10.0, 50.0, [1.0, 0.0]), (6, "d", "M", 6, 10.0, 50.0, [1.0, 0.0])]
    df = spark.createDataFrame(recs, "uid int, client_id string, domain string, created_at int, lon double, lat double, embedding array<double>")
    assert rows(clusters.leader_clusters(df), "uid", "cluster_id") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_views(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.7), ("b", 1, 0.1)], "k string, t int, v double")
    assert rows(rollup.revisions(df, "k", "t", "v"), "k", "delta") == [("a", 0.2)]
    assert rows(rollup.history(df, "k", "t", "v"), "k", "value", "valid_from", "valid_to") == [("a", 0.5, 1, 3), ("a", 0.7, 3, None), ("b", 0.1, 1, None)]


def test_tenant_view(spark):
    df = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, GLOBAL_CLIENT), (4, None)], "id int, client_id string")
    assert rows(tools.tenant_view(df, "c1"), "id") == [(1,), (3,)]
    assert rows(tools.tenant_view(df, None), "id") == [(3,)]


def test_text_and_vector_functions(spark):
    df = spark.createDataFrame([("\t A b\n", None, "", [1.0, 0.0], [0.0, 2.0])], "a string, b string, c string, x array<double>, y array<double>")
    r = df.select(text.strip(F.col("a")), text.first_text(F.col("b"), F.col("c"), F.col("a")), vector.cosine(F.col("x"), F.col("y")), vector.cosine(F.col("x"), F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert tuple(r) == ("A b", "\t A b\n", 0.0, None)


def test_models_offline(spark):
    assert models.embed_text("") == [] and models.embed_text("abc") == models.embed_text("abc")
    assert [x["name"] for x in models.extract("Berlin met Acme.", {"Acme": "ORGANIZATION", "Berlin": "GPE", "Ber": "X"})] == ["Berlin", "Acme"]
    got = spark.createDataFrame([("Acme Corp", "acme corp "), ("Acme", "Zeta")], "a string, b string").select(models.same_entity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False]
    assert spark.createDataFrame([("x",), (None,)], "t string").select(F.size(models.embedder()("t"))).collect()[1][0] == 0


def test_distance_of_nothing_is_null(spark):
    from meridian.functions import geo

    df = spark.createDataFrame([(None, 1.0), (2.0, None), (0.0, 0.0), (180.0, 0.0)], "lon double, lat double")
    got = [r[0] for r in df.select(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(0.0))).collect()]
    assert got[:2] == [None, None] and got[2] == 0.0 and round(got[3]) == 20015114


def test_radius_join_across_the_antimeridian_at_any_cell_size(spark):
    import random

    rng = random.Random(8)
    west, east = [(i, rng.uniform(-180, -172), rng.uniform(-60, 60)) for i in range(80)], [(i, rng.uniform(172, 180), rng.uniform(-60, 60)) for i in range(80)]
    one, two = spark.createDataFrame(west, "i int, lon double, lat double"), spark.createDataFrame(east, "j int, lon double, lat double")
    for metres in (200_000, 500_000, 600_000, 1_000_000):
        for left, right in ((one, two), (two, one)):
            got = {(r.i, r.j) for r in spatial.radius_join(left, right, metres).collect()}
            far = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
            other = right.withColumnsRenamed({"lon": "r_lon", "lat": "r_lat"})
            assert got == {(r.i, r.j) for r in left.crossJoin(other).where(far <= metres).collect()} and got


def test_leader_clusters_across_the_antimeridian(spark):
    rows = [(1, "g", "X", 0, 177.0, 0.0, [1.0]), (2, "g", "X", 1, -179.5, 0.0, [1.0])]
    df = spark.createDataFrame(rows, "uid long, client_id string, domain string, created_at int, lon double, lat double, embedding array<double>")
    for first, second in ((1, 2), (2, 1)):
        got = {r.uid: r.cluster_id for r in clusters.leader_clusters(df.withColumn("created_at", F.when(F.col("uid") == first, 0).otherwise(1)), 500_000.0, 0.0).collect()}
        assert got == {first: first, second: first}
