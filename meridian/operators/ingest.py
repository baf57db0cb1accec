"""Ingestion: deduplication, upserts, mission matching and record heuristics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import text as tx

# Stems that decide a record's domain and priority.
MILITARY = ("war", "military", "missile", "strike", "troop", "navy")
FINANCIAL = ("market", "bank", "stock", "trade", "econom")
ALARM = ("attack", "explosion", "urgent", "breaking", "killed", "emergency")
SQUAWKS = ("7500", "7600", "7700")


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, the least by ``order``: an aggregate of structs, combined before the shuffle.
    Rows with a null key are all kept, as nulls never conflict."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    order = tuple(c for c in order if c not in keys)
    rest = [c for c in df.columns if c not in (*keys, *order)]
    picked = df.where(known).groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)
    return picked.unionByName(df.where(~known))


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of ``new`` that a conflict-free insert would add: not in ``old``, first of a batch."""
    return first_by(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, *order)


def insert_if_absent_any(new: DataFrame, old: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """As above where a match of any one key is a conflict: one anti-join a key."""
    left = reduce(lambda df, k: df.join(old.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, new)
    return reduce(lambda df, k: first_by(df, [k], *order), keys, left)


def first_in_hour(df: DataFrame, key: str, time: str, *order: str) -> DataFrame:
    """The first row of a key in each clock hour."""
    hour = df.withColumn("_hour", F.date_trunc("hour", time))
    return first_by(hour, [key, "_hour"], time, *order).drop("_hour")


#: Terms that go to every task at once; more are matched in further blocks.
TERM_BLOCK = 10_000


def match_mission(records: DataFrame, missions: DataFrame, text: str, id_col: str, block: int = TERM_BLOCK) -> DataFrame:
    """Adds ``mission_id``: the least active mission of which a keyword or target is in the text.

    The lower-cased terms of active missions are matched in blocks of at most ``block``; the text is
    lower-cased once. Null texts and null terms match nothing."""
    terms = F.concat(F.coalesce("keywords", F.array()), F.coalesce("target_entities", F.array()))
    active = missions.where("is_active").select("focus_id", F.explode(terms).alias("t")).where("t is not null").select("focus_id", F.lower("t").alias("t")).distinct()
    blocks = max(1, -(-active.count() // block))
    dealt = active.withColumn("_b", F.pmod(F.xxhash64("focus_id", "t"), F.lit(blocks)))
    out = records.drop("mission_id")
    for k in range(blocks):
        part = dealt.where(F.col("_b") == k).agg(F.array_sort(F.collect_list(F.struct("focus_id", "t"))).alias("_missions"))
        first = lambda low: F.get(F.filter("_missions", lambda m: F.contains(low, m["t"])), F.lit(0))["focus_id"]
        out = out.crossJoin(F.broadcast(part)).withColumn(f"_hit{k}", tx.bound(F.lower(F.col(text)), first)).drop("_missions")
    hits = [f"_hit{k}" for k in range(blocks)]
    return out.withColumn("mission_id", F.least(*hits) if blocks > 1 else F.col(hits[0])).drop(*hits)


def domain_of(text: Column) -> Column:
    """The domain of a lower-cased text."""
    return F.when(tx.contains_any(text, MILITARY, True), "MILITARY").when(tx.contains_any(text, FINANCIAL, True), "FINANCIAL").otherwise("POLITICAL")


def priority_of(text: Column, matched: Column) -> Column:
    """The priority of a lower-cased text; ``matched``: a mission asks for it."""
    return F.when(matched | tx.contains_any(text, ALARM, True), "HIGH").otherwise("NORMAL")


def news_records(items: DataFrame, missions: DataFrame, known: DataFrame) -> DataFrame:
    """Feed items (source_url, title, description) to new records: normalised, hashed, deduplicated
    by URL or hash, matched to a mission and given domain and priority."""
    norm = tx.strip(F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit("")))))
    rows = items.where("title is not null and source_url is not null").withColumn("norm", norm).withColumn("content_hash", F.sha2("norm", 256))
    fresh = insert_if_absent_any(rows, known, ["source_url", "content_hash"], "source_url")
    matched = match_mission(fresh, missions, "norm", "source_url")
    return matched.withColumns({"domain": domain_of(F.col("norm")), "priority": priority_of(F.col("norm"), F.col("mission_id").isNotNull()), "confidence": F.lit(0.70)})


def flight_records(tracks: DataFrame, watched: str = "") -> DataFrame:
    """One record an aircraft and hour; CRITICAL on the general emergency code."""
    level = F.when(F.col("squawk") == "7700", "CRITICAL").when(F.col("callsign") == watched, "HIGH").otherwise("NORMAL")
    return first_in_hour(tracks, "icao24", "time").withColumns({"priority": level, "domain": F.lit("MILITARY"), "content_hash": F.sha2(F.concat_ws("_", "icao24", F.date_format("time", "yyyyMMddHH")), 256)})


def seismic_records(events: DataFrame, known: DataFrame) -> DataFrame:
    """New earthquakes: unknown ids with a magnitude; HIGH from 5.0 on."""
    new = insert_if_absent(events.where("magnitude is not null"), known, ["usgs_id"], "time")
    return new.withColumns({"priority": F.when(F.col("magnitude") >= 5.0, "HIGH").otherwise("NORMAL"), "confidence": F.lit(0.95)})


def vessel_records(tracks: DataFrame) -> DataFrame:
    """One record a vessel and hour, NORMAL and MILITARY."""
    return first_in_hour(tracks, "mmsi", "time").withColumns({"priority": F.lit("NORMAL"), "domain": F.lit("MILITARY"), "content_hash": F.sha2(F.concat_ws("_", "mmsi", F.date_format("time", "yyyyMMddHH")), 256)})


def document_chunks(docs: DataFrame, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """One row a chunk: part from 1, parts, chunk and its hash."""
    rows = docs.select(*[c for c in docs.columns if c != text], tx.chunks(F.col(text), size, overlap).alias("_c"))
    cut = rows.select("*", F.size("_c").alias("parts"), F.posexplode("_c").alias("part", "chunk")).drop("_c")
    return cut.withColumns({"part": F.col("part") + 1, "content_hash": F.sha2("chunk", 256)})


def document_records(docs: DataFrame, known: DataFrame, text: str = "text", id_col: str = "doc_id", name: str = "source") -> DataFrame:
    """New records of documents' chunks: of equal chunks the first (by id, then part) that is not in
    ``known`` (content_hash). Null and empty texts have no chunks."""
    cut = document_chunks(docs.select(id_col, name, text), text)
    fresh = insert_if_absent(cut, known, ["content_hash"], id_col, "part")
    headline = F.concat(F.col(name), F.lit(" - part "), F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string"))
    return fresh.select(F.col("content_hash").alias("uid"), id_col, "part", headline.alias("content_headline"), F.col("chunk").alias("content_raw"), "content_hash", F.lit("HUMINT").alias("source_type"), F.lit("HIGH").alias("priority"), F.lit(0.8).alias("confidence"), F.lit("INVESTIGATIVE").alias("domain"))


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str, nulls: bool = False) -> DataFrame:
    """A new snapshot: rows of ``new`` replace those of the same key, of several the last by
    ``order``. Null values keep what was there, unless ``nulls``. Null keys are rows of their own."""
    order = order or tuple(c for c in new.columns if c != key)
    rest = [c for c in new.columns if c != key]
    last = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))
    both = old.alias("o").join(last.withColumn("_new", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    taken = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if nulls and c != key else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    out = both.select(*(taken(c).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns))
    keyless = new.where(F.col(key).isNull())
    return out.unionByName(keyless, allowMissingColumns=True).select(*old.columns)


def update_counts(old: DataFrame, seen: DataFrame, key: str, count: str, refs: str, time: str) -> DataFrame:
    """Running counters: ``seen`` (key, uid, ts) adds its rows to ``count``, its uids to the list
    ``refs`` and moves ``time`` on; keys that ``old`` does not have are ignored."""
    delta = seen.groupBy(key).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("uid")).alias("_refs"), F.max("ts").alias("_t"))
    kind = old.schema[count].dataType
    both = old.join(delta, key, "left")
    return both.withColumns({count: (F.coalesce(count, F.lit(0)) + F.coalesce("_n", F.lit(0))).cast(kind), refs: F.array_union(F.coalesce(refs, F.array()), F.coalesce("_refs", F.array())), time: F.greatest(time, "_t")}).select(*old.columns)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that a DELETE leaves: those for which the predicate is not true."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def compact(spark, path: str, out: str, mb: int = 256) -> DataFrame:
    """A folder of Parquet files rewritten in files of about ``mb`` MB into ``out``: what is left of a
    checkpoint and vacuum. The source stays as it is."""
    found = spark.read.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    found.coalesce(max(1, -(-size // (mb << 20)))).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
