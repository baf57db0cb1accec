"""Leader clustering of records by place, meaning and mission keywords."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.geo import EARTH_M, columns_of
from meridian.schemas import GLOBAL_CLIENT


class _Founders:
    """Founders of one client and domain, in order of founding, found by grid cell."""

    def __init__(self, metres: float) -> None:
        self.metres, self.size = metres, math.degrees(metres / EARTH_M) * 1.01
        self.wide, self.across = columns_of(self.size)
        self.rows: dict[int, dict[int, list[int]]] = {}
        self.ids, self.lon, self.lat, self.unit = [], [], [], []

    def _cell(self, lon: float, lat: float) -> tuple[int, int]:
        return math.floor((lat + 90) / self.size), math.floor((lon + 180) / self.across) % self.wide

    def add(self, who, lon: float, lat: float, unit: np.ndarray) -> None:
        row, col = self._cell(lon, lat)
        self.rows.setdefault(row, {}).setdefault(col, []).append(len(self.ids))
        self.ids.append(who)
        self.lon.append(lon)
        self.lat.append(lat)
        self.unit.append(unit)

    def _near(self, lon: float, lat: float) -> np.ndarray:
        """Founders within the distance, in order of founding."""
        reach = math.radians(self.size)
        edge = math.cos(math.radians(lat))
        span = 180.0 if abs(lat) + self.size >= 90 or math.sin(min(reach, math.pi / 2)) >= edge else math.degrees(math.asin(math.sin(reach) / edge))
        lo, hi = math.floor((lon - span + 180) / self.across), math.floor((lon + span + 180) / self.across)
        row, found = self._cell(lon, lat)[0], []
        for y in (row - 1, row, row + 1):
            cells = self.rows.get(y)
            if not cells:
                continue
            if hi - lo + 1 >= min(self.wide, len(cells)):
                cols = [c for c in cells if (c - lo) % self.wide <= hi - lo]
            else:
                cols = {x % self.wide for x in range(lo, hi + 1)} & cells.keys()
            for c in cols:
                found += cells[c]
        at = np.array(sorted(found), np.int64)
        if not len(at):
            return at
        x, y = np.radians(np.take(self.lon, at)), np.radians(np.take(self.lat, at))
        a = np.sin((y - math.radians(lat)) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(y) * np.sin((x - math.radians(lon)) / 2) ** 2
        return at[2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a))) <= self.metres]

    def match(self, lon: float, lat: float, unit: np.ndarray, similar: float, keyword: bool) -> int | None:
        """The first founder near and similar, else, with a keyword hit, the first one near."""
        near = self._near(lon, lat)
        for start in range(0, len(near), 256):
            part = near[start : start + 256]
            alike = np.flatnonzero(np.array([self.unit[i] @ unit if len(self.unit[i]) == len(unit) else -1.0 for i in part]) > similar)
            if len(alike):
                return int(part[alike[0]])
        return int(near[0]) if keyword and len(near) else None


def leader_clusters(records: DataFrame, metres: float = 50_000.0, similar: float = 0.35, existing: DataFrame | None = None) -> DataFrame:
    """(uid, cluster_id, founded) of ``records`` (uid, client_id, domain, created_at, lon, lat,
    embedding and, optionally, keyword_hit boolean).

    In claim order (created_at, uid) a record joins the first cluster of its client and domain
    within ``metres`` whose founder is more similar than ``similar``; failing that and with a
    keyword hit, the first one within ``metres``; else it founds one named by its uid. ``existing``
    clusters (cluster_id, client_id, domain, lon, lat, embedding) come before all records, by id.
    Records without place, vector, client or domain found their own. The fold is inherently
    sequential within a client and domain: rows are dealt by those, sorted and streamed, and a task
    holds founders only, kept by grid cell. Ids come out as strings where there are existing clusters.
    """
    kind = "string" if existing is not None else records.schema["uid"].dataType.simpleString()
    hit = F.coalesce("keyword_hit", F.lit(False)) if "keyword_hit" in records.columns else F.lit(False)
    rows = records.select(F.lit(1).alias("late"), "client_id", "domain", "created_at", F.col("uid").cast(kind).alias("uid"), "lon", "lat", F.col("embedding").cast("array<double>").alias("embedding"), hit.alias("hit"))
    whole = F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0) & F.col("client_id").isNotNull() & F.col("domain").isNotNull()
    alone = rows.where(~whole).select("uid", F.col("uid").alias("cluster_id"), F.lit(True).alias("founded"))
    dealt = rows.where(whole)
    if existing is not None:
        old = existing.select(F.lit(0).alias("late"), "client_id", "domain", F.lit(None).cast(records.schema["created_at"].dataType).alias("created_at"), F.col("cluster_id").cast(kind).alias("uid"), "lon", "lat", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(False).alias("hit"))
        dealt = dealt.unionByName(old.where(whole))
    dealt = dealt.repartition("client_id", "domain").sortWithinPartitions("client_id", "domain", "late", "created_at", "uid")

    def run(batches):
        key, founders = None, _Founders(metres)
        for batch in batches:
            out = []
            for late, client, domain, _, uid, lon, lat, vec, keyword in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (client, domain) != key:
                    key, founders = (client, domain), _Founders(metres)
                unit = np.array(vec)
                unit = unit / (np.linalg.norm(unit) or 1.0)
                if not late:
                    founders.add(uid, lon, lat, unit)
                    continue
                best = founders.match(lon, lat, unit, similar, keyword)
                if best is None:
                    founders.add(uid, lon, lat, unit)
                out.append((uid, uid if best is None else founders.ids[best], best is None))
            cols = list(zip(*out, strict=True)) if out else ((), (), ())
            named = batch.schema.field(4).type
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], named), pa.array(cols[1], named), pa.array(cols[2], pa.bool_())], ["uid", "cluster_id", "founded"])

    return dealt.mapInArrow(run, f"uid {kind}, cluster_id {kind}, founded boolean").unionByName(alone)


def cluster_rows(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """New clusters of ``assigned``: founder's place, vector, priority and client, the number of
    records and the newest time; the title is the domain and, where known, ``city``."""
    kind = assigned.schema["uid"].dataType
    both = assigned.join(records.withColumn("uid", F.col("uid").cast(kind)), "uid")
    counts = both.groupBy("cluster_id").agg(F.count("*").alias("uir_count"), F.max("created_at").alias("updated_at"))
    city = F.when(F.col("city").isNotNull(), F.concat(F.lit(" activity near "), "city")).otherwise(" activity") if "city" in records.columns else F.lit(" activity")
    founders = both.where("founded").select("cluster_id", "domain", F.concat(F.coalesce("domain", F.lit("UNKNOWN")), city).alias("title"), F.coalesce("client_id", F.lit(GLOBAL_CLIENT)).alias("client_id"), F.coalesce("priority", F.lit("NORMAL")).alias("priority"), "lon", "lat", "embedding")
    return founders.join(counts, "cluster_id").withColumns({"status": F.lit("ACTIVE"), "confidence": F.lit(0.7)})


def cluster_updates(clusters: DataFrame, records: DataFrame, assigned: DataFrame) -> DataFrame:
    """Existing clusters with the records that joined them: only the count and time move."""
    joined = assigned.where("not founded").join(records.withColumn("uid", F.col("uid").cast(assigned.schema["uid"].dataType)).select("uid", "created_at"), "uid")
    delta = joined.groupBy("cluster_id").agg(F.count("*").alias("_n"), F.max("created_at").alias("_t"))
    kind = clusters.schema["uir_count"].dataType
    both = clusters.join(delta, "cluster_id", "left")
    return both.withColumns({"uir_count": (F.col("uir_count") + F.coalesce("_n", F.lit(0))).cast(kind), "updated_at": F.greatest("updated_at", "_t")}).select(*clusters.columns)
