"""Text operators against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from meridian.llm import chat, decontaminate, language_id, licences, mixing, ngram_join, privacy, quality, secrets, url_filters

LOW = {i: i + 32 for i in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def docs_of(spark, texts):
    """Documents with nulls in every column, a repeated row and clashing extra columns."""
    rows = [(i, t, None if i == 1 else "en", None if i == 2 else f"s{i % 3}", i) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "nobody's text", "en", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


# -- decontamination ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    w = WORD.findall((text or "").translate(LOW))
    hit, seen = set(), set()
    for i, t in items:
        p = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(p) - 12) if p else 0):
            q = p[k : k + 13]
            for at in range(len(w) - len(q) + 1):
                if w[at : at + len(q)] == q:
                    hit.update(range(at, at + len(q)))
                    seen.add(str(i))
    return len(w), len(hit), sorted(seen)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)] + ["é", "Ünder"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((30, 13, 14, 3, 1, 0, 20))] + [(9, None), (10, "w1, W2;w3"), (11, "w1 w2 w3")]
    texts = [" ".join(rng.choice([*vocab, "OTHER"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [items[0][1].upper() + "! x " + items[0][1], "pre " + items[1][1] + " post", None, "", "!!", " ".join(["w1"] * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words, block in ((1_000_000, 2_000_000), (50, 10)):  # many shards, many blocks
        got = decontaminate.find_contamination(docs_of(spark, texts), bench, shard_words=words, block_words=block)
        n, dirty = decontaminate.hit_count()
        rows = got.withColumns({"n_hit": n, "dirty": dirty}).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            w, hit, seen = contamination(r.text, items)
            assert (r.n_words, r.n_hit, r["items"]) == (w, hit, seen)
            assert r.dirty == (hit > 0 and 20 * hit >= w)
            for s in r.removal:
                assert s.end > s.start and not WORD.fullmatch(r.text[s.end : s.end + 1])


def test_decontamination_without_phrases_or_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, ["a b", None]), none)
    assert {r.n_words for r in got.collect()} == {2, 0, 3}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find_contamination(empty, none).count() == 0


def test_removed_text(spark):
    df = spark.createDataFrame([("abcdef", [(1, 3), (4, 5)]), ("xy", [])], "t string, s array<struct<start:long,end:long>>")
    assert [r[0] for r in df.select(decontaminate.removed(F.col("t"), F.col("s"))).collect()] == ["adf", "xy"]


# -- language ----------------------------------------------------------------------------------


def test_language_learns_and_handles_edges(spark):
    rng = random.Random(1)
    words = {"aa": ["thing", "over", "with"], "bb": ["quel", "dans", "pour"], "cc": ["über", "nicht", "ein"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "bb"), (902, "12 3!", "cc"), (903, "over", None), (904, "с", None)], "doc_id long, text string, lang string")
    df = df.withColumn("score", F.lit("mine"))
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa" and got[904].lang_pred in words
    nobody = language_id.train(df.where("false"))
    assert {r.lang_pred for r in language_id.identify(df, nobody, keep_text=False).collect()} == {"und"}


def test_language_equals_exact_trigram_shares(spark):
    """The filter against dictionaries of trigrams: same language, nearly the same share."""
    rng = random.Random(12)
    stems = {"aa": "thonderlyingmax", "bb": "quelouvreçaêt", "cc": "überschnitzäk", "dd": "ñandúllociónya"}
    word = lambda k: "".join(rng.choice(stems[k]) for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word(k if rng.random() < 0.8 else "aa") for _ in range(rng.choice([1, 3, 40, 900]))), k) for i, k in enumerate(["aa", "bb", "cc", "dd"] * 60)]
    rows += [(1000, "x" * 50_000, "aa"), (1001, "", "aa"), (1002, None, None), (1003, "a", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = 1e-3
    model = language_id.train(df, least)

    def grams(t):
        b = f" {t.translate(LOW)} ".encode()
        return [b[i : i + 3] for i in range(len(b) - 2)]

    counts = {}
    for _, t, k in rows:
        if t is not None and k is not None:
            for g in grams(t):
                counts.setdefault(k, {})[g] = counts.get(k, {}).get(g, 0) + 1
    known = {k: {g for g, n in c.items() if n / sum(c.values()) >= least} for k, c in counts.items()}
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    for i, t, _ in rows:
        if not t:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        mine = grams(t)
        share = {k: sum(g in known[k] for g in mine) / len(mine) for k in sorted(known)}
        best = sorted(share.values())
        slack = 0.02 + 2 / len(mine)  # a false positive or two in a short text
        assert abs(got[i].score - best[-1]) < slack
        if best[-1] - best[-2] > 2 * slack:
            assert share[got[i].lang_pred] == best[-1]


def test_more_languages_than_one_mask_holds():
    import numpy as np

    langs = [f"l{i:02}" for i in range(70)]
    grams = {x: np.arange(500 * i, 500 * i + 300, dtype=np.uint64) for i, x in enumerate(langs)}
    f = language_id.BitmaskFilter(langs, grams)
    for i in (0, 63, 64, 69):
        data = b"".join(int(g).to_bytes(3, "little") for g in grams[langs[i]])
        g = np.frombuffer(data, np.uint8).astype(np.uint32).reshape(-1, 3)
        codes = g[:, 0] | g[:, 1] << 8 | g[:, 2] << 16
        mask = np.bitwise_and.reduce([f.cells[i // 64, p] for p in f._places(codes)])
        assert (mask >> np.uint64(i % 64) & np.uint64(1)).all()


# -- personal data -----------------------------------------------------------------------------


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[ -]", "", m[0])
        odd = [int(c) for c in s[::-1]]
        if 16 <= len(s) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_equals_plain_patterns():
    rng = random.Random(5)
    cases = ["a@b.c_d@e.f", "x@@y.z", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "0255.1.1.1", "+1 (23) 456-7890", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "é@b.co", "a@b", "@b.c", "١.١.١.١"]
    cases += ["".join(rng.choice("ab0159.@+- ()_\n") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in cases:
        assert [(privacy.KINDS[k], a, b) for k, a, b in privacy.base_spans(t)] == plain_pii(t), t
    assert privacy.base_spans("1" * 200_000 + ".") == [] and len(privacy.base_spans("a" * 200_000 + "@b.c")) == 1


def test_pii_terms_by_cooccurrence(spark):
    common = " ".join(f"w{i}" for i in range(5))
    texts = [f"{common} {i} project-zeus boss@acme.org meets {common} n{i}" for i in range(4)]
    texts += [f"{common} other line {i}\n{common} and more" for i in range(60)] + ["zeus stands alone", None, ""]
    docs = docs_of(spark, texts)
    terms = privacy.disclosing_terms(docs)
    found = {r.term: r.action for r in terms.collect()}
    assert "zeus" in found and "w1" not in found and "n1" not in found
    marked = {r.doc_id: r.pii for r in privacy.find_personal(docs, terms).collect()}
    alone = texts.index("zeus stands alone")
    assert [(x.kind, x.start, x.end) for x in marked[alone]] == [(4, 0, 4)]
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs, terms).collect()}
    assert "boss@acme.org" not in clean[0] and "[EMAIL]" in clean[0] and "zeus" not in clean[alone] and clean[alone + 1] is None


def test_pii_contexts_are_linear_in_spans():
    import time

    line = " ".join(f"user{i}@host{i}.org" for i in range(100_000))
    start = time.time()
    got = list(privacy._contexts(f"first\nnone here\n{line} tail\nlast x@y.zz word"))
    assert time.time() - start < 30
    assert [(len(e), t) for _, e, t in got] == [(100_000, {"tail"}), (1, {"last", "word"})]


def test_pii_without_terms_is_the_base(spark):
    """Switching the co-occurrence off changes the result: the method decides."""
    texts = [f"call agent falcon {i} at +44 20 7946 0958 number {i}" for i in range(5)] + [f"other text {i} of no one" for i in range(80)] + ["falcon flies"]
    docs = docs_of(spark, texts).withColumn("pii", F.lit("clash"))
    found = lambda terms: {r.doc_id: len(r.pii) for r in privacy.find_personal(docs, terms).collect()}
    terms = privacy.disclosing_terms(docs)
    on, off = found(terms), found(terms.where("false"))
    assert off[85] == 0 and on[85] == 1 and off[0] == 1 and on[0] > 1
    assert privacy.disclosing_terms(docs.where("false")).count() == 0 and privacy.find_personal(docs.where("false"), terms).count() == 0


# -- secrets -----------------------------------------------------------------------------------


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_base_and_linking(spark):
    h = "0123456789abcdef01234567"
    far = " filler" * 80
    texts = [f'é Password = "hunter22" AKIA{"A1" * 10} {h}9 token:ab', f"secret: {h}", f"user=admin99 and deadbeefdeadbeef0 x{far}", "user_name=admin99 deadbeefdeadbeef0", f"user_name=admin99 {far} deadbeefdeadbeef0", "https://host.example.com deadbeefdeadbeef0", None, "", "token=abc token=abcdef", h * 200]
    got = secrets.find_secrets(docs_of(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    weak = {}
    for r in got:
        assert [(x.s, x.rank, x.e) for x in r.secret_base] == plain_secrets(r.text or "")
        assert {(x.s, x.rank, x.e) for x in r.secret_base} <= {(x.s, x.rank, x.e) for x in r.secret_spans}
        weak[r.doc_id] = sorted({secrets.KINDS[x.rank] for x in r.secret_spans if x.rank > 2})
    assert weak[3] == ["weak_id", "weak_secret"] and weak[5] == ["weak_endpoint", "weak_secret"]
    assert weak[4] == [] and weak[1] == []
    clean = secrets.find_secrets(docs_of(spark, texts)).select("text", secrets.redact(F.col("text"), F.col("secret_spans"))).collect()
    assert all((b is None) == (a is None) and not plain_secrets(b or "") for a, b in clean)


# -- chat --------------------------------------------------------------------------------------


def test_chat_round_trip_and_sql(spark):
    hard = ["<|end|>", "\\", "<\\|", "\\\\<|turn|>", "[INST]", "</s>", "é\n", "", None, "<|text|>x<\\\\|", "<<SYS>>"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(hard)) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(100, None, "assistant", "a"), (100, 1, None, "b"), (None, 0, "user", "q"), rows[0]]
    for _, _, _, t in rows:
        if t is not None:
            e = chat.escape(t)
            assert chat.unescape_text(e) == t and not any(c in e for c in chat.CONTROLS)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in mine))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    examples = chat.expand(df).collect()
    assert all(e.loss_end >= e.loss_start for e in examples) and sum(e.last for e in examples) == len(got)
    assert chat.expand(df.where("false")).count() == 0


# -- quality -----------------------------------------------------------------------------------


def test_quality_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ["", " ", "a", "é ü", "x\nx\nx\n \n \n"] + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "é", "\t"]) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    texts.append("a b c d e f g h " * 3)
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            dup += line in seen
            if re.search(r"[^\x20\x09-\x0D]", line):
                seen.add(line)
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}
        assert quality.statistics(t.encode())[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)), t


def test_quality_verdicts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    good = [". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(rng.randint(4, 20))) for _ in range(150)]
    junk = [" ".join(word().upper() + "###!!" for _ in range(60)) for _ in range(12)]
    texts = [*good, *junk, None, "", "few words", "a b c d e f g h " * 10]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 162, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.judge(docs_of(spark, texts), labels, trees=16, leaf_sample=64).collect()
    assert len(got) == len(texts) + 2
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] for i in range(150)) >= 147 and not any(kept[i] for i in range(150, 166))
    unlabelled = quality.judge(docs_of(spark, texts), labels.where("false"), trees=4, leaf_sample=32).collect()
    assert all(r.kept != r.base_failed for r in unlabelled)


def test_quality_verdict_equals_brute_force(spark):
    """Scores by walking each tree, and the threshold by trying all: every document's verdict."""
    import numpy as np

    from meridian.llm.common import hashed_sample

    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(10, 120))) for _ in range(120)] + [" ".join(word().upper() + "##!" for _ in range(40)) for _ in range(15)] + [None, ""]
    rows = [(i % 100, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1])]  # repeated and null ids
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anomaly", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i >= 35 or i < 20)) for i in range(0, 100, 2)], "doc_id long, quality int")
    trees, leaf = 7, 32
    got = quality.judge(docs, labels, trees=trees, leaf_sample=leaf).collect()
    names = [*quality.COUNTS, *quality._MORE]
    measured = quality.measure(docs.drop("anomaly")).where(~quality.base_failed()).select("doc_id", *names)
    data = hashed_sample(measured, F.col("doc_id"), trees * leaf).drop("doc_id").toPandas()
    forest = quality.IsolationForest(quality.features({c: data[c].to_numpy(np.float64) for c in names}), trees, leaf)
    assert len(data) == min(trees * leaf, measured.count()) and len(forest.trees) == trees

    def score(counts):
        x, total = quality.features({c: np.array([float(counts[c])]) for c in names})[0], 0.0
        for feature, cut, left, right, length in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] < cut[at] else right[at]
            total += length[at]
        return 2 ** (-total / trees / forest.norm)

    marks = dict(map(tuple, labels.collect()))
    fails = lambda r: r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
    bins = [(min(int(score(r.asDict()) * 1000), 999), marks[r.doc_id]) for r in got if not fails(r) and r.doc_id in marks]
    n_good = sum(q for _, q in bins)
    tried = []
    for t in range(1001):
        good, bad = sum(q for b, q in bins if b >= t), sum(1 - q for b, q in bins if b >= t)
        if good <= 0.01 * max(1, n_good) and bad > good:
            tried.append((-bad, good, t))
    ends = [t for b, g, t in tried if (b, g) == min(tried)[:2]]
    limit = (min(ends) + max(ends) + 1) // 2
    for r in got:
        assert abs(r.anomaly - score(r.asDict())) < 1e-9
        assert r.kept == (not fails(r) and score(r.asDict()) * 1000 < limit)
    assert limit < 1001 and quality.judge(docs.where("false"), labels, trees=2, leaf_sample=8).count() == 0


# -- mixing ------------------------------------------------------------------------------------


def test_mixing_equals_sql_and_rules(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 400])) if i % 17 else None, None if i % 13 == 0 else f"s{min(i % 29, 5)}") for i in range(600)]
    rows += [(700, " a\t b ", "tiny"), (None, "x y", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    lab = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 3)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = mixing.mix_sources(df, mixing.label_weights(lab)).toPandas()
    con = duckdb.connect()
    con.register("documents", df.drop("target").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", lab.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    want = con.sql(mixing.MIXING_SQL).df()
    key = lambda f: sorted(map(tuple, f[["doc_id", "size", "source_size", "target", "taken"]].fillna(-1).to_numpy().tolist()))
    assert len(got) == len(rows) and key(got) == key(want)
    assert (got["taken"] <= 2 * got["size"]).all()
    assert abs(got["taken"].sum() - 1.5 * got["size"].sum()) <= 7 * 400
    assert mixing.mix_sources(df.where("false")).count() == 0


# -- URLs --------------------------------------------------------------------------------------


def plain_rule(url):
    at = (url or "").find("://")
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S) if at >= 0 else None
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for r, v in url_filters.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_tree(spark):
    urls = [f"https://a.example.org/{k}/{i}.html" for k in ("good", "bad") for i in range(30)] + [f"http://b.org/x/{i:08x}/y/z/a/b/c/d" for i in range(9)]
    urls += [None, "", "nope", "http://", "http://COM", "http://x.Example.com/en/1", "http://www.example.com/en/", "http://example.com/en", "ftp://notcom/en/", "http://u.net/es/?q", "http://u.net/es#f", "http://net/fr/\n/x", "http://a.net:80/es/", "x://y://com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(3))
    bad = spark.createDataFrame([(i, int(i >= 30)) for i in range(0, 60, 2)] + [(None, 1), (1, None)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filters.judge_urls(df, bad).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        h, p, rule, say = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule), u
        assert say is None or got[i].verdict == say
    assert all(got[i].verdict == ("block" if i >= 30 else "allow") for i in range(60))
    assert all(got[i].verdict == "allow" for i in range(60, 69))
    assert url_filters.judge_urls(df.where("false")).count() == 0


def test_url_evidence_decides_on_held_out_pages(spark):
    """Pages whose evidence is hidden get the verdict that their template's other pages teach; with
    no evidence at all nothing is blocked."""
    rng = random.Random(9)
    junk, prose = "<p>" + "a## b$$ c%% " * 20, "<p>" + "plain words of prose " * 20
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        host = f"{rng.choice(['x', 'y'])}.{'junk' if bad else 'fair'}{i % 2}.org"
        seen = i % 4 != 2
        noise = rng.random() < 0.05
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de'])}/{i}.html", (junk if bad != noise else prose) if seen else None, bad, seen))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bad boolean, seen boolean")
    got = url_filters.judge_urls(df, html="html").collect()
    held = [r for r in got if not r.seen]
    assert sum((r.verdict == "block") == r.bad for r in held) >= 0.95 * len(held) and any(r.verdict == "block" for r in held)
    assert {r.verdict for r in url_filters.judge_urls(df).collect()} == {"allow"}


def test_url_verdicts_equal_sql_twin(spark, monkeypatch):
    rng = random.Random(4)
    segs = ["en", "de", "blog", "12", "deadbeef01", "x.html", "casino", "a7"]
    hosts = ["a.org", "b.org", "Q.example.com", "www.example.com", "n.net", "free-bets.org", "long.org"]
    rows = [(i, f"http://{rng.choice(hosts)}/{'/'.join(rng.choice(segs) for _ in range(rng.randint(0, 4)))}", rng.choice(["<p>words of text", "###$$$", "", None])) for i in range(900)]
    rows += [(1000 + i, f"http://long.org/{'/'.join('abcdefgh'[: i + 1])}", "text") for i in range(5)] + [(2000, None, None), (2001, "nope", "x"), (3, "http://a.org", "x"), (None, "http://b.org/q", None)]
    rows += [(3000 + i, f"http://wide.org/{'s' * (i % 120 + 1)}/x/y{i % 7}/z", rng.choice(["text", "%%%%"])) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(url_filters, "table", lambda *_: df)
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).replace("nan", "None").replace("<NA>", "None").replace(r"^([0-9]+)[.]0$", r"\1", regex=True).to_numpy().tolist()))
    got = url_filters.url_query(spark, "").toPandas()
    got["page_id"] = got["page_id"].astype("Int64")
    want = con.sql(url_filters.URL_SQL).df()
    assert key(got) == key(want) and {"allow", "block"} <= set(got[got["rule"].isnull()]["verdict"])


# -- licences ----------------------------------------------------------------------------------


def test_licences(spark):
    plain = [f"the onen tion {i} heat of an ordinary text about things number {i}" for i in range(60)]
    texts = [*plain, "x\nReleased under the MIT License.\ny", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "The driver showed a licence to the officer", None, "", " ".join(["word"] * 300) + " Licensed under the Apache License, Version 2.0. " + " ".join(["word"] * 300)]
    got = licences.scan(docs_of(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r.licences for r in got}
    assert [by[i] for i in range(60, 67)] == ["mit", "cc-by-nc", "gpl", "", "", "", "apache-2.0"] and not any(by[i] for i in range(60))


def test_secrets_equal_sql_twin(spark, monkeypatch):
    rng = random.Random(1)
    bits = ["é ", "user_name=admin99 ", "deadbeefdeadbeef0 ", "https://h.example.com:80/x ", "db.host.io:5432 ", "password: hunter22 ", "AKIA" + "A1" * 10 + " ", "aB3" * 8 + " ", "filler " * 15, "token=ab ", "x" * 18 + " ", "login='bob' ", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(150)] + [(900, None), (901, ""), (3, "AKIA" + "Z" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(secrets, "table", lambda *_: df)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    got = secrets.secrets_query(spark, "").toPandas()
    assert key(got) == key(con.sql(secrets.SECRETS_SQL).df()) and got["spans"].str.contains("weak_endpoint").any()


def test_pii_equals_sql_twin(spark, monkeypatch):
    rng = random.Random(1)
    ents = ["boss@acme.org", "10.0.0.1", "+1 (988) 555-2485", "4111 1111 1111 1111", "é a@b.c_d@e.f", "300.1.1.1"]
    terms = ["Zeus", "Thor", "Odin", "Loki"]

    def line():
        w = [f"w{rng.randint(0, 9)}xx" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.15:
            k = rng.randrange(4)
            w += [ents[k], terms[k]]
        if rng.random() < 0.05:
            w.append(rng.choice(ents + terms))
        rng.shuffle(w)
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 5)))) for i in range(200)] + [(900, None), (901, ""), (3, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(privacy, "table", lambda *_: df)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    got = privacy.privacy_query(spark, "").toPandas()
    assert key(got) == key(con.sql(privacy.PRIVACY_SQL).df()) and got["spans"].str.contains("term").any()


def test_secrets_link_long_tokens_over_cells(spark):
    token = "aB3" * 100
    texts = [" " * 100 + token + " " * 10 + "user_name=admin99", " " * 190 + "aB3" * 13 + "z" + " " * 190 + "user_name=admin99", " " * 100 + token + " " * 201 + "user_name=admin99"]
    texts += [" " * at + ("aB3" * 500)[:n] + " " * gap + "user_name=admin99" for at in (0, 150, 199, 200, 350) for n in (40, 250, 700) for gap in (1, 199, 200, 201)]
    con = duckdb.connect()
    con.register("documents", docs_of(spark, texts).select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = {r[0]: r[-1] for r in con.sql(secrets.SECRETS_SQL).fetchall()}
    found = secrets.find_secrets(docs_of(spark, texts))
    got = {r[0]: r[1] for r in found.select("doc_id", secrets._text_of(F.col("secret_spans"))).collect()}
    assert got == want and want[0].startswith("weak_secret:100:400,weak_id:410:") and want[1].startswith("weak_secret:190:") and want[2] == ""


def test_licences_wrapped_over_lines(spark):
    plain = [f"the onen tion {i} heat of an ordinary text\nabout things number {i}" for i in range(60)]
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */\nint x;"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation\n\ncode"
    by = {r.doc_id: r.licences for r in licences.scan(docs_of(spark, [*plain, bsd, gpl])).collect()}
    assert [by[60], by[61]] == ["bsd", "gpl"] and not any(by[i] for i in range(60))


def test_jaccard_rows_without_or_with_shared_ids(spark):
    from meridian.llm import ngram_join

    w = [f"w{i}" for i in range(120)]
    a, c, b = w[:100], w[10:110], w[20:120]
    rows = [(1, " ".join(a)), (None, " ".join(c)), (2, " ".join(b)), (3, " ".join(["x", *w[60:]])), (3, "other " * 30), (4, "y " + " ".join(w[62:]) + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert got[1, 96] == 1 and got[2, 96] == 1 and got[None, 96] is None


def test_licences_equal_brute_force_scorer(spark):
    """Scores from the trained weights in plain Python, every passage, no gate; families beyond the
    commonest, wrapped and unwrapped, on a corpus of few documents."""
    import math

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = [f"plain text {i} about the weather\nand the port of call" for i in range(40)]
    special = [mit, wrap(mit, 7), "x\n\n// SPDX-License-Identifier: MIT\n\ny", "SPDX-License-Identifier: Foo-1.0", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies", "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by the\nFree Software Foundation; either version 2 of the License, or any later version.", "Licensed under the Foo Bar Licence, see foo", "word " * 500 + "Released under the MIT License.", ""]
    docs = docs_of(spark, [*texts, *special]).withColumn("licences", F.lit("clash"))
    got = {r.doc_id: r for r in licences.scan(docs).collect() if r.doc_id is not None}
    assert [got[40 + i].licences for i in range(len(special))] == ["mit", "mit", "mit", "", "isc", "gpl", "", "mit", ""]
    assert [got[40 + i].n_unknown for i in range(len(special))] == [0, 0, 0, 0, 0, 0, 1, 0, 0]
    model = licences.Classifier(spark, docs, "text")
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    at = {w: i for i, w in enumerate(model.vectors.vocabulary)}

    def families(t):
        out, runs = set(), [r for r in re.split(r"\n(?:[\x20\t\r]*\n)+", t) if "\n" in r.strip(" \t\r\n")]
        for line in [*t.split("\n"), *runs]:
            words = re.findall("[^\x00-\x60\x7b-\x7f]+", line.lower())
            for i in range(0, max(1, len(words) - 30), 30):
                w = words[i : i + 60]
                pairs = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
                x = [at[g] for g in {*w, *pairs} if g in at]
                margins = [bias[k] + sum(weights[k][i] for i in x) for k in range(len(bias))]
                p = [math.exp(m - max(margins)) for m in margins]
                best = max(range(1, len(p)), key=p.__getitem__)
                if w and p[best] / sum(p) >= model.threshold:
                    for notice in licences.TEMPLATES[model.families[best]]:
                        theirs = licences.notice_bigrams(notice)
                        need = len(theirs) if len(theirs) <= licences.SHORT else math.ceil(0.6 * len(theirs))
                        if len(pairs & set(theirs)) >= need:
                            out.add(model.families[best])
        return ",".join(sorted(out))

    for i, t in enumerate([*texts, *special]):
        assert got[i].licences == families(t), t
    assert licences.scan(docs.where("false")).count() == 0


def test_licences_in_long_lines_take_linear_time(spark):
    import time

    body = "lorem " * 300_000
    df = spark.createDataFrame([(1, body + "Released under the MIT License. " + body), (2, "a\n" * 200_000)], "doc_id long, text string")
    start = time.time()
    found = licences.passages(df, "text", ["doc_id"]).groupBy("doc_id").count().collect()
    assert dict(map(tuple, found))[1] == 20_001 - 1 and time.time() - start < 60


def test_secrets_many_spans_empty_tables_and_clashes(spark):
    import time

    text = " ".join(f"é{i} user_name=admin{i} AKIA{'A1' * 10} deadbeefdeadbeef{i % 10}" for i in range(7000))
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string").withColumns({"secret_base": F.lit("mine"), "secret_spans": F.lit(0)})
    start = time.time()
    got = secrets.find_secrets(df).select("doc_id", F.size("secret_base").alias("n"), F.size("secret_spans").alias("m"), secrets.redact(F.col("text"), F.col("secret_spans")).alias("t")).collect()
    assert time.time() - start < 90
    assert sorted((r.doc_id, r.n, r.m) for r in got) == [(1, 7000, 21000), (1, 7000, 21000), (2, 0, 0)]
    assert all(r.t is None or (r.t.count("[SECRET]") == 21000 and "AKIA" not in r.t and r.t.startswith("é0 ")) for r in got)
    assert secrets.find_secrets(df.where("false")).count() == 0
    # weak parts alone are not reported: linking decides
    alone = spark.createDataFrame([(1, "user_name=admin99"), (2, "deadbeefdeadbeef0"), (3, "user_name=admin99 deadbeefdeadbeef0")], "doc_id long, text string")
    assert {r.doc_id: len(r.secret_spans) for r in secrets.find_secrets(alone).collect()} == {1: 0, 2: 0, 3: 2}


def test_url_very_long_paths(spark):
    urls = ["http://deep.org/" + "/".join(f"s{i}" for i in range(500)), "http://deep.org/" + "/".join(f"t{i}" for i in range(500)), "http://deep.org/a/" + "x" * 100_000, None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("text"))
    got = {r.page_id: r for r in url_filters.judge_urls(df, html="html").collect()}
    assert len(got) == 4 and all(r.verdict == "allow" for r in got.values()) and got[0].template.count("/") == 500


def test_only_keys_that_two_sets_have_are_dealt_out():
    rng = np.random.default_rng(5)
    shared, alone = rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(-(1 << 62), 1 << 62, 60_000)
    everything = np.concatenate([shared, shared, alone])
    for parts in (1, 16):
        part, low = ngram_join._dealt(everything, parts)
        held = [np.sort(low[part == p]) for p in range(parts)]
        assert all((ngram_join._unpacked(ngram_join._packed(v), len(v)) == v).all() for v in held)
        keep = ngram_join.RepeatFilter([ngram_join._filter_of(v, parts) for v in held]).keep
        assert keep(shared).all() and keep(alone).mean() < 0.1
