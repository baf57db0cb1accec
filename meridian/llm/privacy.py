r"""Information-theoretic sanitisation of personal data.

Base kinds (e-mail addresses, IPv4 addresses, card numbers, phone numbers) are the protected
entities. A term reveals an entity as far as their co-occurrence in the corpus says: with N lines,
n_t of them with the term, n_e with the entity and n_te with both, the term discloses
PMI = log2(N n_te / (n_t n_e)) bits of the entity's log2(N / n_e). Terms that disclose more than
``alpha`` of an entity's information, in ``support`` different lines at least, are marked wherever
they occur; above ``remove`` they are to be removed, else generalised.

Counts run over every line of every text. Only terms that stand beside an entity often enough are
counted in the corpus, in blocks of a bounded number of terms.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stored, table, texts
from meridian.llm.decontaminate import words_of

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match starts at the start of a run of digits: the one before took its last run whole
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    found, free = [], 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > free and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = t.find("@", max(at + 1, free))
    return found


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in that order; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(t)] if "@" in t else []
    if not _DIGIT.search(t):
        return out
    # dotted quads: an octet may run into the next match only after the whole match
    out += [(1, *m.span()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x[-4:] or 0) <= 255 for x in m.groups())] if "." in t else []
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in t:
        out += [(3, *m.span()) for m in _PHONE.finditer(t) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


def _contexts(t: str):
    """(line's hash, its entities, its terms) of each line that holds a base span: one walk over the
    text, whatever the number of spans."""
    spans = sorted((a, b, kind) for kind, a, b in base_spans(t))
    i = end = 0
    while i < len(spans):
        left = t.rfind("\n", end, spans[i][0]) + 1 or end
        end = t.find("\n", spans[i][1])
        end = len(t) if end < 0 else end
        entities, clear, at = set(), [], left
        while i < len(spans) and spans[i][0] < end:
            a, b, kind = spans[i]
            value = re.sub(r"[\x20().-]", "", t[a:b]) if kind in (2, 3) else t[a:b].lower()
            entities.add(f"{KINDS[kind]}:{value}")
            clear.append(t[at:a])  # what is protected itself is no term
            at = max(at, b)
            i += 1
        clear.append(t[at:end])
        terms = {w for w in map(bytes.decode, words_of(" ".join(clear).encode())) if len(w) > 2}
        yield xxhash.xxh3_64_intdigest(t[left:end].encode()) - (1 << 63), entities, terms


def disclosing_terms(docs: DataFrame, text: str = "text", alpha: float = 0.8, remove: float = 0.95, support: int = 3, block: int = 1_000_000) -> DataFrame:
    """(term, share, action): terms that disclose over ``alpha`` of some entity's information, the
    largest share, and 'remove' or 'generalise'. Copies of one line are one line of support. Terms
    have three letters or digits at least.

    Lines with entities give a row an entity and a row a term; pairs are made by line, of entities
    and terms that have enough lines each. Null and empty texts have no lines."""

    def near(batches):
        for batch in batches:
            rows = [(h, own, v) for t in texts(batch.column(0)) if t for h, entities, terms in _contexts(t.decode()) for own, values in ((True, entities), (False, terms)) for v in values]
            cols = list(zip(*rows, strict=True)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], ["line", "own", "value"])

    body = docs.select(text)
    beside = stored(body.mapInArrow(near, "line long, own boolean, value string").groupBy("line", "own", "value").agg(F.count("*").alias("n")), "privacy-beside")
    each = stored(beside.groupBy("own", "value").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).where(F.col("lines") >= support), "privacy-each")
    entities = each.where("own").select(F.col("value").alias("entity"), F.col("n").alias("n_e"))
    side = lambda own, name: beside.where(F.col("own") == own).join(each.where(F.col("own") == own).select("value"), "value", "left_semi").select("line", F.col("value").alias(name), "n")
    joint = side(True, "entity").join(side(False, "term").drop("n"), "line")
    pairs = stored(joint.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("lines")).where(F.col("lines") >= support), "privacy-pairs")
    wanted = pairs.select("term").distinct()
    n = wanted.count()
    blocks = max(1, -(-n // block))
    counted = None
    for k in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k) if blocks > 1 else wanted
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in part.toLocalIterator()))

        def count(batches, held=held):
            terms, total, found = held.value, 0, {}
            for batch in batches:
                for t in texts(batch.column(0)):
                    lines = t.split(b"\n") if t else ()
                    total += len(lines)
                    for line in lines if terms else ():
                        for w in terms.intersection(words_of(line)):
                            found[w] = found.get(w, 0) + 1
            # the empty term stands for all lines
            yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in found)], pa.string()), pa.array([total, *found.values()], pa.int64())], ["term", "n"])

        got = body.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
        counted = got if counted is None else counted.union(got.where("term <> ''"))
    counted = stored(counted, "privacy-counts")
    total = counted.where("term = ''").agg(F.max("n_t")).first()[0] or 0
    joint = pairs.join(entities, "entity").join(counted.where("term <> ''"), "term")
    pmi = F.log2(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.when(F.col("n_e") < total, pmi / F.log2(F.lit(float(total)) / F.col("n_e")))
    return joint.withColumn("share", share).where(F.col("share") >= alpha).groupBy("term").agg(F.max("share").alias("share")).withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise"))


def find_personal(docs: DataFrame, terms: DataFrame, text: str = "text", keep_text: bool = True, block: int = 1_000_000) -> DataFrame:
    """All columns of ``docs`` (``keep_text=False``: but the text) plus ``pii``: array of (kind,
    start, end), kind an index into ``KINDS``, ordered by kind and start. ``terms``: as
    ``disclosing_terms`` gives them; term spans that touch base spans are left out.

    Null and empty texts get empty arrays; repeated rows, nulls elsewhere and empty tables pass.
    A column ``pii`` of ``docs`` is replaced.
    """
    docs = docs.drop("pii")
    n = terms.count()
    blocks = max(1, -(-n // block))
    columns = docs.columns
    out = docs.withColumn("pii", F.lit(None).cast(_SPANS))
    kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for k in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k) if blocks > 1 else terms
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in part.select("term").toLocalIterator()))
        kept = [c for c in columns if keep_text or k < blocks - 1 or c != text]

        def run(batches, held=held, kept=kept):
            marked = held.value
            for batch in batches:
                made = []
                for t, old in zip(texts(batch.column(columns.index(text))), batch.column(len(columns)).to_pylist(), strict=True):
                    if not t:
                        made.append([])
                        continue
                    found = base_spans(s := t.decode())
                    base = sorted((a, b) for _, a, b in found)
                    more = {(x["start"], x["end"]) for x in old or () if x["kind"] == 4}
                    if marked and not marked.isdisjoint(words_of(t)):
                        at = 0
                        for m in _TERM.finditer(s):
                            while at < len(base) and base[at][1] <= m.start():
                                at += 1
                            free = at == len(base) or base[at][0] >= m.end()
                            if free and m[0].translate(_LOWER).encode() in marked:
                                more.add(m.span())
                    made.append([{"kind": x, "start": a, "end": b} for x, a, b in (*found, *((4, a, b) for a, b in sorted(more)))])
                yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in kept), pa.array(made, kind_type)], [*kept, "pii"])

        out = out.mapInArrow(run, out.select(*kept, "pii").schema)
    return out


def sanitise(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every base span replaced by its kind in brackets, terms to be removed left out
    and terms to be generalised replaced by ``[TERM]``. Null texts stay null."""
    gone = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.where("action = 'remove'").select("term").toLocalIterator()))
    marked = find_personal(docs, terms, text)
    columns = docs.drop("pii").columns

    def run(batches):
        for batch in batches:
            new = []
            for t, spans in zip(batch.column(columns.index(text)).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                parts, at = [], 0
                for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                    if x["start"] < at:
                        at = max(at, x["end"])
                        continue
                    word = t[x["start"] : x["end"]]
                    mark = f"[{KINDS[x['kind']].upper()}]" if x["kind"] < 4 or word.translate(_LOWER) not in gone.value else ""
                    parts += [t[at : x["start"]], mark]
                    at = x["end"]
                new.append(None if t is None else "".join((*parts, t[at:])))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(i) for i, c in enumerate(columns)], columns)

    return marked.mapInArrow(run, docs.drop("pii").select("*").schema)


def span_text(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def privacy_query(spark, sf_dir: str) -> DataFrame:
    """op4: personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = stored(disclosing_terms(docs), "privacy-terms")
    found = find_personal(docs, terms, keep_text=False)
    count = lambda i: F.size(F.filter("pii", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(span_text(F.filter("pii", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


#: The base patterns as they are stated, for the SQL twin.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base_sql() -> str:
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    each = f"list_transform(range(1, length({digits}) + 1), lambda j: CAST({digits}[length({digits}) - j + 1] AS INT) * (1 + (j + 1) % 2))"
    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(x, '.'), lambda o: CAST(o AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform({each}, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    one = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        q = _q(pattern)
        one.append(f"SELECT r, {rank} AS rank, '{kind}' AS kind, x, s, s + length(x) AS e FROM (SELECT r, hits[i + 1] AS x, (list_sum(list_transform(gaps[1:i + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(hits[1:i], lambda y: length(y))), 0))::BIGINT AS s FROM (SELECT r, regexp_extract_all(text, '{q}') AS hits, regexp_split_to_array(text, '{q}') AS gaps FROM d WHERE regexp_matches(text, '{q}')), range(len(hits)) t(i)) WHERE {keep[kind]}")
    return "\nUNION ALL ".join(one)


_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PRIVACY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({_base_sql()}),
l AS (SELECT r, line, sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i) - length(line) - 1 AS ls FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
q AS (SELECT p.*, line, ls, CASE WHEN kind IN ('card', 'phone') THEN kind || ':' || regexp_replace(x, '[ ().-]', '', 'g') ELSE kind || ':' || lower(x) END AS entity FROM p JOIN l ON l.r = p.r AND p.s >= ls AND p.e <= ls + length(line)),
z AS (SELECT r, ls, any_value(line) AS line, list_reduce(list_prepend(any_value(line), list(DISTINCT x)), lambda a, b: replace(a, b, repeat(' ', length(b)))) AS clear FROM q GROUP BY r, ls),
v AS (SELECT r, ls, unnest(list_distinct(list_filter(regexp_extract_all({_LOW_SQL.format('clear')}, '{_WORD_SQL}'), lambda w: length(w) > 2))) AS term FROM z),
o AS (SELECT DISTINCT r, ls, line, entity FROM q),
j AS (SELECT entity, term, count(*) AS n_te, count(DISTINCT line) AS lines FROM o JOIN v USING (r, ls) GROUP BY entity, term HAVING lines >= 3),
e AS (SELECT entity, count(*) AS n_e FROM o GROUP BY entity),
k AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all({_LOW_SQL.format('line')}, '{_WORD_SQL}'))) AS term FROM l JOIN d USING (r) WHERE d.text <> '') WHERE term IN (SELECT term FROM j) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS total FROM l JOIN d USING (r) WHERE d.text <> ''),
m AS (SELECT DISTINCT term FROM j JOIN e USING (entity) JOIN k USING (term), n WHERE n_e < total AND log2(total * n_te / (n_t * n_e)) / log2(total / n_e) >= 0.8),
w AS (SELECT r, h, (list_sum(list_transform(gaps[1:i + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(hits[1:i], lambda y: length(y))), 0))::BIGINT AS s FROM (SELECT r, hits, gaps, i, hits[i + 1] AS h FROM (SELECT r, regexp_extract_all(text, '[0-9A-Za-z\x{{80}}-\x{{10ffff}}]+') AS hits, regexp_split_to_array(text, '[0-9A-Za-z\x{{80}}-\x{{10ffff}}]+') AS gaps FROM d WHERE EXISTS (SELECT 1 FROM m)), range(len(hits)) t(i)) WHERE {_LOW_SQL.format('h')} IN (SELECT term FROM m)),
b AS (SELECT r, rank, kind, s, e FROM p UNION ALL SELECT r, 4, 'term', s, s + length(h) FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r = w.r AND p.s < w.s + length(w.h) AND w.s < p.e)),
g AS (SELECT r, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans FROM b GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
