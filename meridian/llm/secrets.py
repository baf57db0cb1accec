r"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong ("base") kinds are reported wherever they occur:

* ``assign``: a secret-like name, ``:`` or ``=``, and a value of six or more characters;
* ``access``: an access identifier of the cloud form ``AKIA...`` of 20 or more characters;
* ``hex``: 24 or more lower-case hexadecimal digits.

Weak parts look like half of a credential and are mostly harmless alone: ``weak_id`` (user or client
names in an assignment), ``weak_secret`` (a mixed token of 20 or more characters, or 16 to 23 hex
digits) and ``weak_endpoint`` (a URL with a host, or host:port). Parts are joined by interval: a
weak part is reported only if, within ``scope`` code points, complementary parts stand: an
identifier or endpoint needs a secret nearby, a weak secret needs an identifier or endpoint.
Base spans serve as partners (access: identifier; assign and hex: secret).

The interval join goes by (document, text cell), so a document with very many parts is spread over
its cells, and it is a semi join: no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import scan, stored, table

BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    "weak_id": r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
    "weak_secret": r"[A-Za-z0-9+/_-]{16,}",
    "weak_endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}:[0-9]{2,5}",
}
#: What a kind is in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}
KINDS = (*BASE, *WEAK)


#: Literals of which a text, lower-cased, must hold one to match a pattern: cheap to look for.
NEEDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "weak_id": ("user", "login", "client", "account", "access"),
    "weak_endpoint": (":",),
}
_EMPTY = "cast(array() as array<struct<s:int,rank:int,e:int>>)"


def spans_of(text: Column, kind: str, pattern: str, keep=None, low: Column | None = None) -> Column:
    """Array of (s, rank, e) of the leftmost non-overlapping matches of ``pattern``, in code points,
    end exclusive; ``keep``: of a match's text, whether it counts; ``low``: the lower-cased text,
    where the kind's literals are looked for first."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = F.lit(KINDS.index(kind))
    pairs = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(found)), F.length).alias("gap"), found.alias("hit"))

    def placed(pairs: Column) -> Column:
        before = scan(F.transform(pairs, lambda p: p["gap"] + F.length(p["hit"])), lambda a, b: a + b)
        at = F.zip_with(pairs, before, lambda p, b: F.struct((b + p["gap"]).alias("s"), rank.alias("rank"), (b + p["gap"] + F.length(p["hit"])).alias("e"), p["hit"].alias("hit")))
        kept = F.filter(at, lambda x: keep(x["hit"])) if keep else at
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e")))

    spans = F.element_at(F.transform(F.array(pairs), placed), 1)
    may = F.rlike(text, F.lit(pattern))
    if low is not None and kind in NEEDS:
        holds = F.lit(False)
        for literal in NEEDS[kind]:
            holds = holds | F.contains(low, F.lit(literal))
        may = holds & may
    if kind == "weak_secret":  # what counts holds a digit, or is a run of hexadecimal letters
        may = (F.rlike(text, F.lit("[0-9]")) | F.rlike(text, F.lit("[a-f]{16}"))) & may
    return F.when(may, spans).otherwise(F.expr(_EMPTY))


def _strong(text: Column, low: Column) -> dict[str, Column]:
    value = BASE["assign"]
    return {
        "assign": spans_of(text, "assign", value, lambda hit: F.length(F.regexp_extract(hit, value, 2)) >= 6, low),
        "access": spans_of(text, "access", BASE["access"], lambda hit: F.length(hit) >= 20, low),
        "hex": spans_of(text, "hex", BASE["hex"]),
    }


def _mixed(hit: Column) -> Column:
    """A token that looks random: 20 or more characters of three classes, or 16 to 23 hex digits."""
    three = (F.length(hit) >= 20) & F.rlike(hit, F.lit("[0-9]")) & F.rlike(hit, F.lit("[a-z]")) & F.rlike(hit, F.lit("[A-Z]"))
    return three | F.rlike(hit, F.lit("^[0-9a-f]{16,23}$"))


def _text_of(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _link(lean: DataFrame, scope: int) -> DataFrame:
    """(_key, _linked): the weak parts of each text that stand near complementary ones."""
    role = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    part = lean.select("_key", F.explode(F.concat("secret_base", "_parts")).alias("p")).distinct()
    part = part.select("_key", "p", F.element_at(role, F.col("p.rank") + 1).alias("role"))
    # an asking part is entered in every cell of its interval, a partner in every cell that its
    # interval, widened by the scope, touches: two that are near share a cell
    reach = part.select("_key", F.col("p.s").alias("ps"), F.col("p.e").alias("pe"), F.col("role").alias("prole"), F.explode(F.sequence(F.floor((F.col("p.s") - scope) / scope), F.floor((F.col("p.e") + scope) / scope))).alias("cell"))
    asked = part.where(F.col("p.rank") >= len(BASE)).select("_key", "p", "role", F.explode(F.sequence(F.floor(F.col("p.s") / scope), F.floor(F.col("p.e") / scope))).alias("cell"))
    near = (F.col("a.p.s") <= F.col("b.pe") + scope) & (F.col("b.ps") <= F.col("a.p.e") + scope)
    fits = (F.col("a.role") == "secret") != (F.col("b.prole") == "secret")
    apart = (F.col("a.p.e") <= F.col("b.ps")) | (F.col("b.pe") <= F.col("a.p.s"))
    linked = asked.alias("a").join(reach.alias("b"), (F.col("a._key") == F.col("b._key")) & (F.col("a.cell") == F.col("b.cell")) & near & fits & apart, "left_semi")
    return linked.groupBy("_key").agg(F.collect_set("p").alias("_linked"))


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", scope: int = 200, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (``keep_text=False``: but the text) plus ``secret_base`` and
    ``secret_spans``: arrays of (s, rank, e), rank an index into ``KINDS``, ordered by s and rank.

    Null texts count as empty and get empty arrays. Repeated rows and rows of one id each get their
    own text's spans (rows are told apart by id and text hash). Null ids are kept. Columns of
    ``docs`` with the same names as the two results are replaced. Empty tables give empty results.
    Every text is matched once: rows are stored with their parts before these are linked.
    """
    clean = docs.drop("secret_base", "secret_spans", "_key", "_parts")
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    weak = F.concat(*(spans_of(body, k, p, _mixed if k == "weak_secret" else None, low) for k, p in WEAK.items()))
    base = F.array_sort(F.concat(*_strong(body, low).values()))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), body)
    kept = [c for c in clean.columns if keep_text or c != text]
    marked = stored(clean.select(*kept, key.alias("_key"), base.alias("secret_base"), weak.alias("_parts")), "secret-marked")
    asking = marked.where((F.size("_parts") > 0) & (F.size("_parts") + F.size("secret_base") > 1)).select("_key", "secret_base", "_parts")
    added = stored(_link(asking, scope), "secret-links")
    # links of at most 32 MB go to every task, more are joined by a shuffle
    weight = added.agg(F.sum(F.size("_linked") * 24 + 64)).first()[0] or 0
    added = F.broadcast(added) if weight <= 32 << 20 else added
    whole = F.array_sort(F.concat("secret_base", F.coalesce("_linked", F.expr(_EMPTY))))
    return marked.join(added, "_key", "left").withColumn("secret_spans", whole).drop("_key", "_parts", "_linked")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span of ``spans`` (ordered by start; overlaps merged) replaced.

    Text is cut out in pieces of some hundred spans, and within these span by span, so that no
    span costs a walk over the whole text."""
    size = 256
    ends = scan(F.transform(spans, lambda x: x["e"]), F.greatest)  # how far the spans before reach
    told = F.zip_with(spans, ends, lambda x, at: F.struct(x["s"].alias("s"), F.greatest(x["e"], at).alias("e"), at.alias("at")))

    def piece(block: Column) -> Column:
        start, end = F.element_at(block, 1)["at"], F.element_at(block, -1)["e"]
        part = F.substring(text, start + 1, end - start)
        said = lambda cut: F.transform(block, lambda x: F.when(x["s"] >= x["at"], F.concat(F.substring(cut, x["at"] - start + 1, x["s"] - x["at"]), F.when(x["e"] > x["s"], F.lit(mark)).otherwise(""))).otherwise(""))
        return F.array_join(F.element_at(F.transform(F.array(part), said), 1), "")

    def whole(told: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(told) - 1, F.lit(size)), lambda i: F.slice(told, i + 1, F.lit(size)))
        end = F.element_at(told, -1)["e"]
        return F.concat(F.array_join(F.transform(blocks, piece), ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(told), whole), 1)).otherwise(text)


def secrets_query(spark, sf_dir: str) -> DataFrame:
    """op6: secret spans of all documents."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda kind: F.size(F.filter("secret_base", lambda x: x["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_text_of(F.col("secret_base")), 256).alias("base_sha256"), _text_of(F.col("secret_spans")).alias("spans"))


def _parts_sql() -> str:
    """One SELECT a kind: the spans of its matches, from the texts between and of the matches."""
    keep = {"assign": rf"length(regexp_extract(h, '{_quoted(BASE['assign'])}', 2)) >= 6", "access": "length(h) >= 20", "weak_secret": "(length(h) >= 20 AND regexp_matches(h, '[0-9]') AND regexp_matches(h, '[a-z]') AND regexp_matches(h, '[A-Z]')) OR regexp_full_match(h, '[0-9a-f]{16,23}')"}
    one = []
    for rank, (kind, pattern) in enumerate({**BASE, **WEAK}.items()):
        q = _quoted(pattern)
        one.append(f"SELECT r, '{kind}' AS kind, {rank} AS rank, '{ROLE[kind]}' AS role, s, s + length(h) AS e FROM (SELECT r, hits[i + 1] AS h, (list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0))::BIGINT AS s FROM (SELECT r, regexp_extract_all(text, '{q}') AS hits, regexp_split_to_array(text, '{q}') AS gaps FROM d WHERE regexp_matches(text, '{q}')), range(len(hits)) t(i)) WHERE {keep.get(kind, 'true')}")
    return "\nUNION ALL ".join(one)


def _quoted(s: str) -> str:
    return s.replace("'", "''")


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({_parts_sql()}),
k AS (SELECT * FROM p WHERE rank < {len(BASE)} OR EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND (q.role = 'secret') <> (p.role = 'secret')
  AND p.s <= q.e + 200 AND q.s <= p.e + 200 AND (p.e <= q.s OR q.e <= p.s))),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
