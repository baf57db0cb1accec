"""Resolution, clustering, merges, the fusion job and keyed streams against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import text as tx
from meridian.operators import clusters, fusion, ingest, relations, resolve, spatial, vectors
from meridian.streaming import jobs
from meridian.tools import Tools


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else None


def metres(lon1, lat1, lon2, lat2):
    a, b, dx, dy = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1), math.radians(lat2 - lat1)
    h = math.sin(dy / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(dx / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def vector(rng, n=6):
    return [rng.gauss(0, 1) for _ in range(n)]


def test_nearest_blocked_equals_brute_force(spark):
    rng = random.Random(1)
    base = [(f"e{i:03}", rng.choice("AB"), vector(rng)) for i in range(60)] + [("null", "A", None), ("zero", "A", [0.0] * 6), ("none", None, vector(rng))]
    asked = [(i, rng.choice("ABC"), vector(rng)) for i in range(40)] + [(100, "A", None), (101, "A", [0.0] * 6), (102, None, vector(rng)), (103, *base[0][1:]), (104, *base[0][1:])]
    left, right = spark.createDataFrame(asked, "query_id long, kind string, query array<double>"), spark.createDataFrame(base, "entity_id string, kind string, embedding array<double>")
    for block in (1000, 9):
        got = {r.query_id: (r.entity_id, r.similarity) for r in vectors.nearest_blocked(left, right, "kind", block).collect()}
        want = {}
        for q, kind, v in asked:
            met = [(-cosine(v, w), e) for e, k, w in base if v and w and kind and k == kind and any(v) and any(w)]
            if met:
                want[q] = min(met)
        assert {q: e for q, (e, _) in got.items()} == {q: e for q, (_, e) in want.items()}
        assert all(abs(got[q][1] + want[q][0]) < 1e-9 for q in got)
    assert vectors.nearest_blocked(left, right.where("false"), "kind").count() == 0 == vectors.nearest_blocked(left.where("false"), right, "kind").count()


def test_resolution_rules(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.6, 0.8, 0.0]  # 0.6 and 0.8 from them
    entities = [("a", "Acme", "ORGANIZATION", ["AC"], one, 0.0, 0.0), ("b", "Bolt", "ORGANIZATION", None, two, 50.0, 50.0), ("c", "acme", "PERSON", [], None, None, None), ("p", "Paris", "LOCATION", [], [0.0, 0.0, 1.0], 2.3, 48.8)]
    e = spark.createDataFrame(entities, "entity_id string, name string, entity_type string, aliases array<string>, embedding array<double>, lon double, lat double")
    said = [
        (1, 0, "ACME", "ORGANIZATION", one, None, None),  # lexical, least id
        (1, 1, "AC", "ORGANIZATION", two, 0.0, 0.0),  # alias of a, but its vector is Bolt's: too far, lexical similarity 0
        (2, 0, "Bold", "ORGANIZATION", near, None, None),  # 0.8, verified by spelling
        (2, 1, "Zeta", "ORGANIZATION", near, None, None),  # 0.8, not verified: new
        (3, 0, "zeta", "PERSON", near, 9.0, 9.0),  # the same new entity
        (4, 0, "Nobody", "PERSON", None, None, None),  # no vector: skipped
        (5, 0, "Lutece", "GPE", [0.0, 0.0, 2.0], None, None),  # a location by another name
    ]
    m = spark.createDataFrame(said, "uid long, position int, name string, type string, embedding array<double>, lon double, lat double")
    found = resolve.resolve_mentions(m, e)
    got = {(r.uid, r.position): (r.entity_id, r.created) for r in found.collect()}
    assert got[1, 0] == ("a", False) and got[2, 0] == ("b", False) and got[5, 0] == ("p", False)
    assert got[1, 1][1] and got[2, 1][1] and got[3, 0] == got[2, 1] and (4, 0) not in got
    made = {r.name: r for r in resolve.created_entities(found).collect()}
    assert set(made) == {"AC", "Zeta"} and made["Zeta"].mention_count == 2 and made["Zeta"].uir_refs == [2, 3] and made["Zeta"].confidence == 0.3
    places = {r.uid: (r.lon, r.lat) for r in resolve.borrowed_places(found, e).collect()}
    assert places == {1: (0.0, 0.0), 2: (50.0, 50.0), 5: (2.3, 48.8)}
    assert resolve.resolve_mentions(m.where("false"), e).count() == 0 and resolve.resolve_mentions(m, e.where("false")).where("not created").count() == 0


def leaders(rows, old, far, similar):
    """The fold in plain Python."""
    founders, out = {}, {}
    for cid, client, domain, lon, lat, v in sorted(old):
        founders.setdefault((client, domain), []).append((cid, lon, lat, v))
    for _, uid, client, domain, lon, lat, v, hit in sorted(rows, key=lambda r: (r[0], r[1])):
        if None in (client, domain, lon, lat) or not v:
            out[uid] = uid
            continue
        mine = founders.setdefault((client, domain), [])
        near = [f for f in mine if metres(lon, lat, f[1], f[2]) <= far]
        alike = [f[0] for f in near if cosine(v, f[3]) > similar]
        best = alike[0] if alike else near[0][0] if hit and near else None
        if best is None:
            mine.append((uid, lon, lat, v))
        out[uid] = best or uid
    return out


@pytest.mark.parametrize("far", [300_000.0, 4_000_000.0])
def test_leader_clusters_equal_the_fold(spark, far):
    rng = random.Random(int(far))
    spot = lambda: (rng.choice([rng.uniform(-180, 180), rng.uniform(170, 190) % 360 - 180 if rng.random() < 0.5 else 179.5]), rng.choice([rng.uniform(-90, 90), rng.uniform(80, 90)]))
    rows = []
    for i in range(300):
        lon, lat = spot()
        rows.append((i // 3, f"r{i:03}", rng.choice(["c1", "c2", None]), rng.choice(["X", "Y", "Y", None]), lon if i % 17 else None, lat, vector(rng, 3) if i % 13 else None, rng.random() < 0.2))
    old = [(f"old{i}", "c1", "Y", *spot(), vector(rng, 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "created_at int, uid string, client_id string, domain string, lon double, lat double, embedding array<double>, keyword_hit boolean")
    ex = spark.createDataFrame(old, "cluster_id string, client_id string, domain string, lon double, lat double, embedding array<double>")
    got = clusters.leader_clusters(df.repartition(3), far, 0.3, ex)
    assert {r.uid: r.cluster_id for r in got.collect()} == leaders(rows, old, far, 0.3)
    counted = ex.withColumns({"uir_count": F.lit(1), "updated_at": F.lit(-1)})
    total = clusters.cluster_updates(counted, df, got).agg(F.sum("uir_count")).first()[0]
    made = clusters.cluster_rows(df.withColumn("priority", F.lit(None).cast("string")), got)
    assert total - 9 + made.agg(F.sum("uir_count")).first()[0] == 300 and made.count() == got.where("founded").count()
    assert clusters.leader_clusters(df.where("false")).count() == 0


def test_merge_entity_rows(spark):
    rows = [("a", "Acme", ["A"], [1], 2), ("b", "ACME", ["A", "B"], [1, 3], 5), ("c", "Acme Inc", None, None, 1), ("d", "Delta", None, [9], 4)]
    e = spark.createDataFrame(rows, "entity_id string, name string, aliases array<string>, uir_refs array<int>, mention_count int")
    m = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "gone")], "secondary string, primary string")
    got = {r.entity_id: tuple(r)[1:] for r in relations.merge_entity_rows(e, m).collect()}
    assert got == {"a": ("Acme", ["A", "ACME", "Acme Inc", "B"], [1, 3], 8), "d": ("Delta", None, [9], 4)}
    assert relations.merge_entity_rows(e, m.where("false")).count() == 4


def test_fusion_job_from_queue_to_relations(spark):
    """A record at a seeded city with one organisation: its job is done, the organisation is found,
    and without a second entity no relation is written."""
    records = [(1, 10, "c1", "MILITARY", "HIGH", "wire", "m", "Acme moves", "Acme moves near the port", 2.3, 48.8), (2, 11, "c1", "MILITARY", None, None, None, "Acme again", "Acme met Borex, and Acme paid", 2.31, 48.81), (3, 12, None, None, None, None, None, None, None, None, None)]
    tables = {
        "queue": spark.createDataFrame([("q1", 1, "PENDING"), ("q2", 2, "PENDING"), ("q3", 3, "PENDING"), ("q4", 9, "PENDING"), ("q5", 1, "DONE")], "queue_id string, uir_uid long, status string"),
        "records": spark.createDataFrame(records, "uid long, created_at int, client_id string, domain string, priority string, source_name string, mission_id string, content_headline string, content_raw string, lon double, lat double"),
        "entities": spark.createDataFrame([("p", "Paris", "LOCATION", [], None, 2.35, 48.85), ("a", "Acme", "ORGANIZATION", [], [3.0, 1.0], None, None)], "entity_id string, name string, entity_type string, aliases array<string>, embedding array<double>, lon double, lat double"),
        "clusters": spark.createDataFrame([], "cluster_id string, client_id string, domain string, lon double, lat double, embedding array<double>, status string, uir_count int, updated_at int"),
        "missions": spark.createDataFrame([("m", "FINANCIAL", ["PORT", "moves"])], "focus_id string, category string, keywords array<string>"),
        "sources": spark.createDataFrame([("wire", 0.9)], "source_name string, trust_score double"),
        "gazetteer": spark.createDataFrame([("Acme", "ORGANIZATION"), ("Borex", "ORGANIZATION")], "name string, type string"),
    }
    letters = lambda c: F.array(*((F.length(c) - F.length(F.replace(F.lower(c), F.lit(x), F.lit(""))) + 1).cast("double") for x in "ax"))
    done = fusion.fusion_job(**tables, embed=letters)
    assert {r.queue_id: (r.status, r.error_message) for r in done["queue"].collect()} == {"q1": ("DONE", None), "q2": ("DONE", None), "q3": ("DONE", None), "q4": ("FAILED", "UIR record missing")}
    told = {r.uid: r for r in done["records"].collect()}
    assert told["1"].cluster_id == told["2"].cluster_id == "1" and told["3"].cluster_id == "3" and told["1"].entities == ["Acme"]
    assert [(r.cluster_id, r.title, r.uir_count, r.priority) for r in done["new_clusters"].orderBy("cluster_id").collect()] == [("1", "MILITARY activity near Paris", 2, "HIGH"), ("3", "UNKNOWN activity", 1, "NORMAL")]
    assert {r.entity_id for r in done["mentions"].where("uid = '1'").collect()} == {"a"}
    assert [r.evidence_count for r in done["relations"].collect()] == [1]


def test_streamed_accrual_over_batches(spark, tmp_path):
    rows = [("a", "b", "OWNS", "c", 1, 1, 0.5), ("a", "b", "OWNS", "c", 2, 2, 1.0), ("a", "b", "OWNS", "c", 1, 3, 0.9), ("a", "x", "OWNS", None, 1, 1, 0.5), ("a", "d", "OWNS", "c", 7, 1, None)]
    schema = "a string, b string, type string, client_id string, uid long, ts int, trust double"
    for i, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.to_folder(jobs.accrual(stream), f"{tmp_path}/out", f"{tmp_path}/check", "update").awaitTermination()
        got = {r.b: (round(r.confidence, 6), r.evidence_count, r.mention_count) for r in jobs.latest(spark, f"{tmp_path}/out", ["a", "b"]).collect()}
        assert got == ({"b": (0.3, 1, 1)} if i == 0 else {"b": (0.5, 2, 3), "d": (0.3, 1, 1)})


def test_mission_terms_in_blocks(spark):
    m = spark.createDataFrame([(f"m{i}", [f"word{i}", None], [f"Target{i}"] if i % 2 else None, i != 3) for i in range(8)], "focus_id string, keywords array<string>, target_entities array<string>, is_active boolean")
    r = spark.createDataFrame([(1, "WORD5 and word2"), (2, "word3"), (3, "target7!"), (4, None), (5, "")], "uid int, t string")
    for block in (100, 2):
        got = {x.uid: x.mission_id for x in ingest.match_mission(r, m, "t", "uid", block).collect()}
        assert got == {1: "m2", 2: None, 3: "m7", 4: None, 5: None}
    assert {x.mission_id for x in ingest.match_mission(r, m.where("false"), "t", "uid").collect()} == {None}


def test_chunks_of_long_texts_and_salted_joins(spark):
    rng = random.Random(2)
    texts = ["", " ", None, "a", "é" * 1500, "x" * 1501] + [" ".join("w" * rng.randint(1, 9) for _ in range(n)) for n in (300, 60_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", tx.chunks(F.col("t")).alias("c")).collect():
        flat = " ".join((texts[r.i] or "").split())
        assert r.c == [flat[at : at + 1500] for at in range(0, len(flat), 1300)]
    spots = spark.createDataFrame([(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(200)], "uid int, lon double, lat double")
    other = spots.withColumnRenamed("uid", "j")
    plain, salted = ({(r.uid, r.j) for r in spatial.radius_join(spots, other, 60_000, salts=n).collect()} for n in (1, 5))
    assert plain == salted and len(plain) > 200


def test_upsert_with_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, n string, v int")
    new = spark.createDataFrame([(1, None, 5), (1, "z", 3), (3, "c", 4), (None, "k", 9)], "id int, n string, v int")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(ingest.upsert(old, new, "id", "v")) == sorted([(1, "a", 5), (2, "b", 2), (3, "c", 4), (None, "k", 9)], key=repr)
    assert key(ingest.upsert(old, new, "id", "v", nulls=True)) == sorted([(1, None, 5), (2, "b", 2), (3, "c", 4), (None, "k", 9)], key=repr)


def test_lsh_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.35 * rng.normal(size=32)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = {}
    for r in vectors.lsh_top_k(df, asked, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist())) for q in range(0, 600, 50)]
    assert sum(hits) >= 0.9 * 10 * len(hits)


def test_tools_state_their_limits(spark):
    t = Tools({"entities": spark.createDataFrame([("a", "A")], "entity_id string, name string"), "edges": spark.createDataFrame([], "edge_id long, a string, b string, type string")})
    with pytest.raises(ValueError):
        t.get_entity_network("A", 4)
    with pytest.raises(ValueError):
        t.page("entities", "entity_id", 501)
    with pytest.raises(KeyError):
        t.call("no_such_tool")
    assert t.page("entities", "entity_id").count() == 1


def test_json_set_fences_and_extraction(spark):
    from meridian import models

    df = spark.createDataFrame([('{"a":"1","b":2}',), (None,), ("broken{",)], "j string")
    assert [r[0] for r in df.select(tx.json_set(F.col("j"), "b", F.lit("x"))).collect()] == ['{"a":"1","b":"x"}', '{"b":"x"}', '{"b":"x"}']
    said = spark.createDataFrame([("```json\n{}\n```",), ("{}",), ("``` {} ```",), (None,)], "t string")
    assert [r[0] for r in said.select(tx.strip_fence(F.col("t"))).collect()] == ["{}", "{}", "{}", None]
    found = models.extractor({"Oslo": "GPE", "Acme": "ORGANIZATION"})
    texts = spark.createDataFrame([("Acme left Oslo, Acme",), ("Acmeville",), (None,)], "t string")
    assert [[(x.name, x.type) for x in r[0]] for r in texts.select(found("t")).collect()] == [[("Acme", "ORGANIZATION"), ("Oslo", "LOCATION")], [], []]
