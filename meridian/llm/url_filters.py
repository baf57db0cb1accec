"""URL filters: listed rules, and a path-template tree that judges what no rule fits.

Per host, a path is a way down a tree of segments. Segments that vary by themselves (numbers,
hexadecimal names) become wildcards at once. Level by level, children of crowded nodes that hold
little of their parent become a wildcard, and labelled children whose share of bad pages does not
differ from their parent's (a two-proportion test) are merged into it. A template's purity is its
labelled share of bad pages, smoothed towards its parent's, up to the host, the host's domain and
the whole table; templates at ``reject`` or more are blocked.

Labels come from three places: the listed rules, labels given by the caller, and, where the pages
have their HTML, weak evidence of the page itself (``page_evidence``). Only the template decides: a
page that looks bad in a clean template is allowed, a clean-looking one in a bad template blocked.

The tree is built on counts of distinct (host, path shape), combined before each shuffle, one
level a step until no branch holds two shapes; the pages themselves are read twice and joined to
their shape's verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stored, table

#: The production rules: (host and path prefix, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a host or path that speak against a page.
SEEDS = ("adult", "ads", "bets", "betting", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
_SEED = rf"(^|[^a-z])({'|'.join(SEEDS)})([^a-z]|$)"
#: Characters that junk is full of, and the share of a page's characters from which it is junk.
_SYMBOLS, JUNK = "#*$%", 0.03


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    ok = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(ok, host).otherwise(""), F.when(ok, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule (or null) and its verdict. A rule fits its host and subdomains, if
    the path starts with the rule's. The rules are configuration: some hundreds at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, say in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit(f".{rule[:at]}"))) & F.startswith(path, F.lit(rule[at:]))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path, variable ones as wildcards."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    stem = lambda s: F.regexp_extract(s, r"^[^.]*", 0)
    hexed = lambda s: F.when(F.rlike(stem(s), F.lit("^[0-9a-fA-F-]{8,}$")) & F.rlike(stem(s), F.lit("[0-9]")), F.concat(F.lit("{hex}"), F.substring(s, F.length(stem(s)) + 1, F.length(s)))).otherwise(s)
    return F.transform(parts, lambda s: F.regexp_replace(hexed(s), "[0-9]+", "{n}"))


def page_evidence(host: Column, path: Column, html: Column) -> Column:
    """1 for a page whose host or path has a seed word or whose text is junk, 0 for another page
    with text, null for one without."""
    seeded = F.rlike(F.lower(F.concat_ws("/", host, path)), F.lit(_SEED))
    symbols = F.length(html) - F.length(F.translate(html, _SYMBOLS, ""))
    return F.when(seeded, 1).when(F.length(html) > 0, (symbols > JUNK * F.length(html)).cast("int"))


def template_verdicts(pages: DataFrame, crowd: int = 50, little: float = 0.01, similar: float = 1.96, smooth: float = 8.0) -> DataFrame:
    """``pages`` (host, shape array, label: 1 bad, 0 good, null unknown) to (host, shape, template,
    purity: the smoothed share of bad pages, labelled: how many labels the template itself has).

    A branch with one shape left ends there, so the levels follow the segments that shapes have in
    common, not the longest path."""
    sums = lambda: (F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    base = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    base = stored(base, "url-shapes")
    # the priors: all labels, then the last two host labels, then the host
    site = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), F.lit(2)), ".")
    nodes = base.withColumn("site", site)
    whole = base.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    prior = (whole.bad + 1.0) / (whole.lab + 2.0) if whole.lab is not None else 0.5
    blend = lambda above: (F.col("_bad") + smooth * above) / (F.col("_lab") + smooth)
    for keys in (["site"], ["host"]):
        part = nodes.groupBy(*keys).agg(F.sum("lab").alias("_lab"), F.sum("bad").alias("_bad"))
        above = F.lit(prior) if keys == ["site"] else F.col("p")
        nodes = nodes.join(part, keys).withColumn("p", blend(above)).drop("_lab", "_bad")
    kept = ["host", "shape", "n", "lab", "bad", "p", "own", "template"]
    live = stored(nodes.select("host", "shape", "n", "lab", "bad", "p", F.lit(0).cast("long").alias("own"), F.array().cast("array<string>").alias("template")), "url-level")
    done, k = [live.where("false")], 0
    while not live.isEmpty():
        here = live.withColumn("seg", F.get("shape", F.lit(k)))
        child = here.groupBy("host", "template", "seg").agg(F.count("*").alias("m"), *sums())
        parent = child.groupBy("host", "template").agg(F.sum("m").alias("_m"), F.count("seg").alias("_fan"), *(F.sum(c).alias(f"_{c}") for c in ("n", "lab", "bad")))
        rate, own = F.try_divide("_bad", "_lab"), F.try_divide("bad", "lab")
        spread = F.sqrt(F.try_divide(rate * (1 - rate), F.col("lab")))
        alike = (F.col("lab") >= 5) & (F.abs(own - rate) <= similar * spread)
        rare = (F.col("_fan") > crowd) & (F.col("n") < little * F.col("_n"))
        merged = F.when(rare | F.coalesce(alike, F.lit(False)), F.lit("*")).otherwise(F.col("seg"))
        named = child.where("seg is not null").join(parent, ["host", "template"]).select("host", "template", "seg", merged.alias("to"), (F.col("_m") == 1).alias("alone"), "lab", "bad")
        named = stored(named, "url-named")
        branch = named.groupBy("host", "template", "to").agg(F.sum("lab").alias("_lab"), F.sum("bad").alias("_bad"))
        moved = here.join(named.select("host", "template", "seg", "to", "alone"), ["host", "template", "seg"])
        onward = moved.where("not alone").join(branch, ["host", "template", "to"]).select("host", "shape", "n", "lab", "bad", blend(F.col("p")).alias("p"), F.col("_lab").alias("own"), F.concat("template", F.array("to")).alias("template"))
        rest = F.slice("shape", k + 1, F.size("shape"))
        alone = moved.where("alone").select("host", "shape", "n", "lab", "bad", ((F.col("bad") + smooth * F.col("p")) / (F.col("lab") + smooth)).alias("p"), F.col("lab").alias("own"), F.concat("template", rest).alias("template"))
        ended = here.where("seg is null").select(*kept)
        level = stored(onward.withColumn("open", F.lit(True)).unionByName(alone.unionByName(ended).withColumn("open", F.lit(False))), "url-level")
        done.append(level.where("not open").select(*kept))
        live, k = level.where("open").select(*kept), k + 1
    nodes = reduce(DataFrame.unionByName, done)
    return nodes.select("host", "shape", "template", F.col("p").alias("purity"), F.col("own").alias("labelled"))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, url: str = "url", id_col: str = "page_id", html: str | None = None, reject: float = 0.5, evidence: int = 3) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict, template, purity and labelled
    (replaced if there). A template is blocked at ``reject`` purity if it has ``evidence`` labels.
    Pages that a rule fits teach the tree its verdict; ``labels`` (id_col, bad 0/1; null ids or
    values are left out, several mean their largest) teaches of others too, and where ``html`` names
    a column, ``page_evidence`` of the rest.

    Null URLs and such without ``://`` have an empty host and path and are judged like any other.
    Null or empty HTML is no evidence. Repeated rows get equal verdicts; an empty table gives an
    empty result.
    """
    made = [c for c in ("host", "path", "rule", "verdict", "template", "purity", "labelled") if c not in (url, html, id_col)]
    host, path = host_and_path(F.col(url))
    rows = pages.drop(*made).withColumns({"host": host, "path": path})
    rule, say = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_say": say, "_shape": shape(F.col("path"))})
    weak = page_evidence(F.col("host"), F.col("path"), F.col(html)) if html else F.lit(None).cast("int")
    label = F.when(F.col("rule").isNotNull(), (F.col("_say") == "block").cast("int"))
    taught = rows.select("host", F.col("_shape").alias("shape"), label.alias("label"), weak.alias("weak"), F.col(id_col).alias("_id"))
    if labels is not None:
        known = labels.where("bad is not null").groupBy(F.col(id_col).alias("_id")).agg(F.max("bad").cast("int").alias("_bad"))
        taught = taught.join(known, "_id", "left").withColumn("label", F.coalesce("label", "_bad"))
    tree = template_verdicts(taught.select("host", "shape", F.coalesce("label", "weak").alias("label")))
    tree = tree.select(F.col("host").alias("_h"), F.col("shape").alias("_s"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "labelled")
    judged = rows.join(tree, (F.col("host") == F.col("_h")) & (F.col("_shape") == F.col("_s")))
    verdict = F.coalesce("_say", F.when((F.col("purity") >= reject) & (F.col("labelled") >= evidence), "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("_say", "_shape", "_h", "_s")


def url_query(spark, sf_dir: str) -> DataFrame:
    """op1: verdicts on all page URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, html="html").select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


#: Levels that the SQL twin writes out; the tables' paths have fewer segments.
_LEVELS = 6


def _tree_sql(crowd: int = 50, little: float = 0.01, similar: float = 1.96, smooth: float = 8.0) -> str:
    """The tree as common table expressions, one group of them a level."""
    levels = []
    for k in range(_LEVELS):
        levels.append(f"""
c{k} AS (SELECT host, template, shape[{k + 1}] AS seg, count(*) AS m, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM n{k} WHERE live GROUP BY ALL),
f{k} AS (SELECT host, template, sum(m) AS pm, count(seg) AS fan, sum(n) AS pn, sum(lab) AS plab, sum(bad) AS pbad FROM c{k} GROUP BY ALL),
r{k} AS (SELECT c.*, pm, fan, pn, pbad / nullif(plab, 0) AS rate, bad / nullif(lab, 0) AS mine FROM c{k} c JOIN f{k} f ON c.host = f.host AND c.template = f.template),
m{k} AS (SELECT host, template, seg, pm = 1 AS alone, lab, bad, CASE WHEN (fan > {crowd} AND n < {little}::DOUBLE * pn) OR coalesce(lab >= 5 AND abs(mine - rate) <= {similar}::DOUBLE * sqrt(rate * (1 - rate) / nullif(lab, 0)), false) THEN '*' ELSE seg END AS dest FROM r{k} WHERE seg IS NOT NULL),
b{k} AS (SELECT host, template, dest, sum(lab) AS blab, sum(bad) AS bbad FROM m{k} GROUP BY ALL),
n{k + 1} AS (SELECT host, shape, n, lab, bad, p, own, template, false AS live FROM n{k} WHERE NOT live OR shape[{k + 1}] IS NULL
  UNION ALL SELECT x.host, x.shape, x.n, x.lab, x.bad, CASE WHEN alone THEN (x.bad + {smooth}::DOUBLE * p) / (x.lab + {smooth}::DOUBLE) ELSE (bbad + {smooth}::DOUBLE * p) / (blab + {smooth}::DOUBLE) END,
    CASE WHEN alone THEN x.lab ELSE blab END, CASE WHEN alone THEN list_concat(x.template, x.shape[{k + 1}:]) ELSE list_append(x.template, m.dest) END, NOT alone
  FROM n{k} x JOIN m{k} m ON live AND x.host = m.host AND x.template = m.template AND x.shape[{k + 1}] = m.seg JOIN b{k} b ON b.host = m.host AND b.template = m.template AND b.dest = m.dest)""")
    return ",".join(levels)


def _rules_sql(what: int) -> str:
    best = sorted(RULES, key=lambda r: -len(r[0]))
    test = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    return "CASE " + " ".join(f"WHEN {test(r[0])} THEN '{r[what]}'" for r in best) + " END"


URL_SQL = rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
g AS (SELECT *, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS say,
  CASE WHEN regexp_matches(lower(host || '/' || path), '{_SEED}') THEN 1 WHEN length(html) > 0 THEN (length(html) - length(translate(html, '{_SYMBOLS}', '')) > {JUNK}::DOUBLE * length(html))::INT END AS weak,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
  lambda x: regexp_replace(CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{{8,}}(\.|$)') AND regexp_matches(regexp_extract(x, '^[^.]*'), '[0-9]') THEN '{{hex}}' || substr(x, length(regexp_extract(x, '^[^.]*')) + 1) ELSE x END, '[0-9]+', '{{n}}', 'g')) AS shape FROM h),
u AS (SELECT *, CASE WHEN rule IS NOT NULL THEN (say = 'block')::INT ELSE weak END AS label FROM g),
base AS (SELECT host, shape, count(*) AS n, count(label) AS lab, coalesce(sum(label), 0) AS bad, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS site FROM u GROUP BY ALL),
w AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(lab) + 2.0::DOUBLE) AS prior FROM base),
s1 AS (SELECT site, (sum(bad) + 8.0::DOUBLE * any_value(prior)) / (sum(lab) + 8.0::DOUBLE) AS p1 FROM base, w GROUP BY site),
s2 AS (SELECT host, (sum(bad) + 8.0::DOUBLE * any_value(p1)) / (sum(lab) + 8.0::DOUBLE) AS p FROM base JOIN s1 USING (site) GROUP BY host),
n0 AS (SELECT host, shape, n, lab, bad, p, 0::HUGEINT AS own, []::VARCHAR[] AS template, true AS live FROM base JOIN s2 USING (host)),{_tree_sql()}
SELECT page_id, u.host, path, rule, coalesce(say, CASE WHEN t.p >= 0.5 AND t.own >= 3 THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(template, '/') AS template, round(t.p, 6) AS purity
FROM u JOIN n{_LEVELS} t ON u.host = t.host AND u.shape = t.shape
"""
