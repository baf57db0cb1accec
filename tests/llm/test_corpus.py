"""Near duplicates, components and the pipeline against brute force."""

import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from meridian.llm import common, components, ngram_join


def shingles(t):
    w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.005, 0.03]) else w for w in text]
            rows.append(" ".join(copy) + (" " + passage if base % 3 == 0 else ""))
    hot = [rng.choice(words) for _ in range(80)]
    for k in range(70):  # more than are paired: the chain and the trie have to find them
        copy = list(hot)
        for _ in range(k % 5):
            copy[rng.randrange(80)] = f"edit{k}"
        rows.append(" ".join(copy))
    return list(enumerate([*rows, rows[0], rows[0].upper(), "", None, "one", "One", " \t"]))


def test_components(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = [(i, i + 1) for i in range(20)] + [(40, 40), (50, 60), (60, 55), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 55: 50, 60: 50}


def test_components_by_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 5)
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 200: 200, 201: 200}


def test_components_by_star_rounds_on_many_edges(spark, monkeypatch):
    """The rounds that a cluster runs, against union-find: chains, stars and random graphs."""
    monkeypatch.setattr(components, "LOCAL_EDGES", 200)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 4000), rng.randrange(2000, 4000)) for _ in range(1500)]
    rng.shuffle(edges)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()))
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_jaccard_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    want = classes(rows)
    for size in (1_000_000, 800):  # one block, and many that are compared in pairs
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, block_shingles=size).collect()}
        assert got == want
    assert ngram_join.jaccard_components(df.where("false")).count() == 0


def test_jaccard_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, "A B C")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=repr)
    assert got == [(5, 1, 5), (5, 1, 5), (9, 1, 5), (None, 1, None)]


def test_trie_join_is_exact():
    for seed in range(150):
        rng = random.Random(seed)
        base = [rng.getrandbits(60) for _ in range(40)]
        sets = []
        for i in range(12):
            k = {x for x in base if rng.random() > 0.08} | {rng.getrandbits(60) for _ in range(rng.randint(0, 6))}
            sets.append((i, tuple(sorted(k, reverse=True))))
        want = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})}

        def comp(links):
            up = list(range(12))
            for a, b in links:
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
            return up

        assert comp(ngram_join.join_block(sets, None, 80, 100)) == comp(want)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": ["thing", "over", "with", "house", "green"], "fr": ["quel", "dans", "pour", "maison", "vert"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k, f"s{i % 3}", 0) for i, k in enumerate(["en", "fr"] * 30)]
    item = " ".join(rng.choice(words["en"]) for _ in range(20))
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "12345 678", "en", "s1", 0), (102, item + " thing", "en", "s2", 0), (103, rows[7][1] + " password=abcdef99", "fr", "s1", 0), (104, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    for name, frame in (("documents", df), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string")), ("labels", spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    kept = {r.doc_id: r for r in docs.collect()}
    assert not {100, 101, 102, 104} & set(kept)
    assert classes([(i, t) for i, t, *_ in rows if i < 100])[7][1] == 7
    assert 103 not in kept or "abcdef99" not in kept[103].text
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(kept) and "pipeline" in __spark_entry__.queries()


def test_hashed_sample_is_bounded_and_repeatable(spark):
    from meridian.llm.common import hashed_sample

    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(7)
    a, b = (sorted(r.doc_id for r in hashed_sample(d, F.col("doc_id"), 200).collect()) for d in (df, df.repartition(3)))
    assert a == b and len(a) == 200
    same = df.select(F.col("doc_id"), (F.col("doc_id") % 8).alias("key"))
    assert hashed_sample(same, F.col("key"), 200).count() == 200 and hashed_sample(same, F.lit(None).cast("long"), 200).count() == 200
    assert hashed_sample(df, F.col("doc_id"), 9000).count() == 5000 and hashed_sample(df.where("false"), F.col("doc_id"), 5).count() == 0


def test_jaccard_bridges_without_ids_on_any_partitioning(spark):
    """A text that only a row without an id holds links its neighbours, and two texts of one id are
    two sets, however the rows are dealt."""
    w = [f"w{i}" for i in range(130)]
    texts = [(1, w[:100]), (None, w[6:106]), (3, w[12:112]), (2, ["q", *w[60:120]]), (2, w[3:103]), (4, ["q", *w[60:119], "z"]), (5, ["solo"] * 3), (None, ["solo"] * 3)]
    rows = [(i, " ".join(t)) for i, t in texts]
    sets = dict(enumerate(shingles(t) for _, t in rows))
    up = dict(enumerate(range(len(rows))))
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    want = sorted((i, len(sets[k]), None if i is None else min(rows[m][0] for m in up if up[m] == up[k] and rows[m][0] is not None)) for k, (i, _) in enumerate(rows) if i is not None)
    for parts in (1, 2, 5):
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).where("doc_id is not null").collect()
        assert sorted(map(tuple, got)) == want


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages in plain Python and SQL, on rows with null and repeated ids, repeated rows,
    two texts of one id, and columns named like results."""
    import duckdb

    from meridian.llm import mixing
    from tests.llm.test_text_operators import contamination, plain_secrets

    rng = random.Random(23)
    words = {"en": ["thing", "over", "with", "house", "green", "water"], "fr": ["quel", "dans", "pour", "maison", "vert", "eau"]}
    prose = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    items = [(1, prose("en", 25)), (2, "thing over"), (3, None)]
    rows = [(i, prose(k, rng.choice([40, 90])), k, f"s{i % 4}" if i % 9 else None) for i, k in enumerate(["en", "fr"] * 25)]
    rows += [(100 + i, rows[i][1] + (" thing" if i % 2 else ""), rows[i][2], "s1") for i in range(0, 20, 3)]  # copies
    rows += [rows[4], rows[4], (5, prose("fr", 50), "fr", "s2"), (None, prose("en", 60), "en", "s0"), (None, rows[8][1], "en", None)]
    rows += [(200, items[0][1] + " house", "en", "s0"), (201, "1234 !!", "en", "s0"), (202, None, None, None), (203, prose("fr", 70) + " password = hunter2222 " + "0123456789abcdef" * 2, "fr", "s3"), (204, "", "fr", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "items": F.lit("mine"), "score": F.lit(1), "_key": F.lit("k")})
    labels = [(i, i % 2, 0) for i in range(0, 60, 3)]
    for name, frame in (("documents", df), ("benchmark", spark.createDataFrame(items, "item_id long, text string")), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), df.schema)
        assert docs.columns == df.columns, name
        seen.append(sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=repr))
    # languages: every letter of these texts is in a learned language
    left = [(i, t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)]
    assert seen[0] == sorted(left, key=repr)
    # duplicates: one row a class, the least id, rows without an id last
    group = classes([(k, t) for k, (_, t, _) in enumerate(left)])
    for k in {g for _, g in group.values()}:
        members = [left[j] for j in group if group[j][1] == k]
        kept, ids = [r for r in seen[1] if r in members], [i for i, _, _ in members if i is not None]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)
    assert len(seen[1]) == len({g for _, g in group.values()})
    dirty = lambda t: (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*contamination(t, items))
    assert seen[2] == sorted((r for r in seen[1] if not dirty(r[1])), key=repr)
    # secrets: only the planted text changes
    changed = [(a, b) for a, b in zip(seen[2], seen[3], strict=True) if a != b]
    assert all(plain_secrets(a[1]) and not plain_secrets(b[1]) and "[SECRET]" in b[1] for a, b in changed)
    assert len(changed) == sum(bool(plain_secrets(t)) for _, t, _ in seen[2])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas())
    want = sorted((tuple(None if v != v else v for v in r) for r in con.sql(mixing.MIXING_SQL).df().astype(object).itertuples(index=False)), key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted((r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == sorted((w[1], w[2], round(w[3], 6), w[4]) for w in want)


def test_pipeline_on_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_jaccard_on_very_long_texts(spark):
    rng = random.Random(31)
    w = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    near = [x if i % 100 else "edit" for i, x in enumerate(w)]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(w[:20_000])), (4, "x " * 50_000)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_small_inputs_over_many_partitions_leave_few_files(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(("ab", "cd", "ef", "gh", "ij", "kl")) + str(rng.randrange(40))
    bodies = [" ".join(word() for _ in range(40)) for _ in range(300)]
    rows = [(i, bodies[i % 300] + (" end" if i // 300 == 1 else "")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(48)
    home = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(home.glob("*")) if home.exists() else set()
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert got == {i: i % 300 for i in range(900)}
    made = {p.name: len(list(p.glob("part-*"))) for p in set(home.glob("*")) - before}
    assert {n.rpartition("-")[0] for n in made} >= {"jaccard-sets", "jaccard-copies", "jaccard-groups", "cc"}
    assert max(made.values()) <= 12 and len(made) <= 8


def test_texts_are_read_in_bounded_pieces():
    text = ["x" * (1 << 20)] * 9 + ["y" * (5 << 20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(text)], ["id", "text"])
    pieces = list(common.slices([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(pieces) == pa.Table.from_batches([batch])
    assert max(p.num_rows for p in pieces) <= 2


def test_jaccard_passages_of_many_texts_join_no_sets(spark, monkeypatch):
    """Passages that sixty texts each share, at a sketch too coarse to tell them from rare ones (as at
    6 GB): they made one component of all sets, whose blocks were shuffled by the square."""
    import random

    rng, rows = random.Random(5), []
    passages = [" ".join(f"p{i}x{j}" for j in range(9)) for i in range(20)]
    for i in range(300):
        words = [f"w{rng.getrandbits(40)}" for _ in range(200)]
        rows.append((i, " ".join([*words[:100], *rng.sample(passages, 4), *words[100:]])))
    near = rows[7][1].split()
    rows += [(300 + i, " ".join([*near[:-i], *(f"z{i}y{j}" for j in range(i))])) for i in range(1, 4)]
    groups, stored = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "sketch_bits", lambda total: 6)
    monkeypatch.setattr(ngram_join, "stored", lambda df, label: groups.append((label, out := stored(df, label))) or out)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i > 300 else i for i, _ in rows}
    members = dict(groups)["jaccard-groups"]
    assert members.count() < 20, "sets that share passages alone are candidates"


def test_jaccard_candidates_of_crowded_keys_hold_all_links():
    """Sets of all kinds of crowding: the candidates connect whatever brute force links."""
    import random

    import numpy as np
    import pyarrow as pa

    chained = 0
    for seed in range(12):
        rng, sets = random.Random(seed), {}
        common = [rng.getrandbits(57) for _ in range(rng.choice([400, 4000]))]
        for _ in range(12):
            base = rng.sample(common, rng.randint(3, 120))
            for _ in range(rng.choice([1, 3, 12, 90])):
                s = set(base)
                for _ in range(rng.randint(0, max(1, len(base) // 8))):
                    s.discard(rng.choice(base))
                    s.add(rng.choice(common) if rng.random() < 0.5 else rng.getrandbits(57))
                sets[tuple(sorted(s))] = s
        n = np.array([len(s) for s in sets])
        prefix = [np.array(s[: ngram_join.prefix_length(len(s), 80, 100) + ngram_join.shared_prefix(len(s)) - 1 + ngram_join.slack(len(s))], np.int64) for s in sets]
        keys, length = np.concatenate(prefix), np.array([len(p) for p in prefix])
        part, low = ngram_join._dealt(keys, 2)
        filters = [ngram_join.RepeatFilter([ngram_join._filter_of(low[part == p], 2, least) for p in range(2)]) for least in (2, *(ngram_join._FEW * 4**i + 1 for i in range(ngram_join._LEVELS)))]
        kept, told = ngram_join._chosen(filters, keys, n, length, 80, 100)
        chained += int((told & 1).sum())
        columns = [x[kept] for x in (keys, np.repeat(np.arange(len(n)), length), told)]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        step = rng.choice([7, 500, 10**6])
        batches = [pa.RecordBatch.from_arrays([pa.array(x[order][i : i + step]) for x in columns], ["key", "node", "size"]) for i in range(0, len(order), step)]
        met = {}
        for batch in ngram_join._meetings(batches, 80, 100):
            for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met[pair] = met.get(pair, 0) + 1
        label = list(range(len(n)))
        for (a, b, least), count in met.items():
            if count >= least and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
        listed = list(sets.values())
        for i, s in enumerate(listed):
            for j in range(i):
                both = len(s & listed[j])
                assert 100 * both < 80 * (len(s) + len(listed[j]) - both) or label[i] == label[j]
    assert chained
