"""Adapters and registered queries on small tables against brute force."""

import random

import numpy as np

from meridian import models
from meridian.operators import graph, vectors
from meridian.plans import analytics, fixtures, relational
from meridian.sources import readers


def test_edges_take_every_order_and_line_pair(spark, tmp_path):
    lines = [(1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 1, 5), (2, 3, 8), (2, 3, 9), (22, 4, 1), (23, 2, 3), (23, 5, 3)]
    spark.createDataFrame([(o, n, s, 10.0 * n, "A") for o, n, s in lines], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r.edge_id % (1 << 40), r.a, r.b, r.confidence) for r in fixtures.edges(spark, str(tmp_path)).collect())
    want = []
    for o in {x[0] for x in lines}:
        numbers = sorted({n for k, n, _ in lines if k == o})
        for n, m in zip(numbers, numbers[1:], strict=False):
            want += [(o, f"S{x}", f"S{y}", 10.0 * n / 50.0) for k, i, x in lines for h, j, y in lines if (k, i, h, j) == (o, n, o, m)]
    assert got == sorted(want) and len(got) == 5
    reached = {(r.node, r.distance) for r in graph.reach(fixtures.edges(spark, str(tmp_path)), spark.createDataFrame([("S5",)], "root string"), 2).collect()}
    assert reached == {("S5", 0), ("S6", 1), ("S8", 1), ("S9", 1), ("S7", 2)}


def test_trail_counts_equal_trails(spark):
    rng = random.Random(2)
    edges = [(i % 25, rng.choice("ABCD"), rng.choice("ABCD"), rng.choice("TU"), 0.5) for i in range(30)]
    e = spark.createDataFrame(edges, "edge_id long, a string, b string, type string, confidence double")
    roots = spark.createDataFrame([("A",), ("B",), ("Z",)], "root string")
    listed = graph.trails(e, roots, 3, ["T"]).groupBy("root", "connected", "length").count().collect()
    counted = graph.trail_counts(e, roots, 3, ["T"]).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, counted)) and len(counted) > 10


def test_nearest_of_type_searches_all_other_rows(spark, tmp_path):
    rows = [(0, "x", [1.0, 0.0]), (50, "x", [1.0, 0.1]), (1, "x", [0.0, 1.0]), (100, "y", [1.0, 0.0]), (2, "y", [-1.0, 0.5])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = analytics.cosine_topk_per_type(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.entity_id) for r in got) == [(0, 50), (50, 0), (100, 2)]


def test_duplicates_and_lsh_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(160, 64))
    v[7], v[9] = v[3] * 2, v[3] + 0.01
    rows = [(i, "xy"[i % 2], [float(x) for x in r]) for i, r in enumerate(v)]
    frame = spark.createDataFrame([*rows, (900, "x", [0.0] * 64), (901, "x", None)], "vec_id long, label string, embedding array<double>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    sim = u @ u.T
    want = {(i, j) for i in range(160) for j in range(160) if i != j and sim[i, j] > 0.3}
    assert {(3, 7), (7, 9)} <= want
    for got in (analytics.vector_duplicates(spark, str(tmp_path)).collect(), vectors.similar_pairs(frame, 0.3, "vec_id", block=40).collect()):
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    found = {}
    for r in analytics.lsh_topk(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == {0, 50, 100, 150}
    best = {q: set(np.argsort(-sim[q])[:10].tolist()) for q in found}
    assert sum(len(best[q] & found[q]) for q in found) >= 0.9 * 40


def test_fixed_tables_are_whole():
    assert len(readers.PROPERTIES) == 15 and {"P138", "P607", "P241", "P137", "P126"} <= set(readers.PROPERTIES)
    assert len(models.VOCABULARY) == 46 and {"WORKS_FOR", "OPERATES", "HOSTILE_TO", "EMPLOYED_BY"} <= models.VOCABULARY


def test_searches_of_many_copies_and_near_ties(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 8))
    v[100:200] = v[0]
    v[250] = v[50] * 3
    rows = [(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)]
    spark.createDataFrame([*rows, (400, 0, None), (450, 1, [1.0])], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(vectors, "_SENT", 16)  # blocks of two queries
    got = {r.query_id: (r.entity_id, r.similarity) for r in analytics.cosine_topk_per_type(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 50, 100, 150, 200, 250} and got[0] == (100, 1.0) and got[100] == (0, 1.0) and got[150] == (0, 1.0) and got[50] == (250, 1.0)
    found = {}
    for r in analytics.lsh_topk(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(found[0]) == [0, *range(100, 109)] == sorted(found[150]) and found[450] == [450] and 250 in found[50]


def test_contested_profiles_are_exact_at_ties(spark, tmp_path):
    # means of 0.29 and 0.1015625, which sums of doubles miss in these orders; nulls are left out
    tenths = {1: [2, 2, 4, 1, 1, 4, 2, 5, 3, 5], 2: [1] * 63 + [2], 3: [2, 3, None], 4: [None], 5: [5, 5, 5]}
    rows = [(i, k, p) for i, (k, p) in enumerate((k, p) for k, ps in tenths.items() for p in ps)]
    put = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("orders", [(i, 1, None, p and f"{p}-X") for i, _, p in rows], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string")
    put("lineitem", [(i, k, "A") for i, k, _ in rows], "l_orderkey long, l_suppkey long, l_returnflag string")
    put("supplier", [(k, "s", 1, 0.0) for k in range(1, 5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    put("nation", [(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, "c", 1, 0.0)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double")
    got = sorted(map(tuple, relational.contested_profiles(spark, str(tmp_path)).collect()))
    assert got == [("S1", 0.29, False), ("S2", 0.101563, True), ("S3", 0.25, True), ("S4", None, None)]
