"""Tool functions over tables, and the tenant view that guards them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian import models, schemas
from meridian.functions import geo
from meridian.operators import graph, rollup, spatial, vectors
from meridian.schemas import GLOBAL_CLIENT


def tenant_view(df: DataFrame, client_id: str | None) -> DataFrame:
    """Rows of one tenant and of everyone; null tenants are seen by nobody."""
    seen = [GLOBAL_CLIENT] if client_id is None else [client_id, GLOBAL_CLIENT]
    return df.where(F.col("client_id").isin(seen))


#: Response limits: rows of a page, hops of a traversal.
MOST_ROWS, MOST_HOPS = 500, 3
TOOLS = ("get_active_clusters", "get_cluster_details", "search_spatial", "get_entity_network", "submit_tasking", "get_system_health", "missions_active", "page", "get_entity_profile", "search_entities_semantic", "traverse_entity_graph", "search_intelligence_semantic", "search_intelligence_spatial", "get_cluster_detail", "search_historical_intelligence", "get_location_history", "get_morning_brief", "get_active_anomalies", "get_flight_anomalies", "get_agent_health", "director_task", "entities_in_box")


class Tools:
    """The tool registry of one tenant. ``tables``: clusters, records, edges, entities, queue and,
    for the tools that read them, missions, revisions, profile_history, digests, flights, tasks.
    ``embed``: text to a vector (list of floats), for searches by meaning."""

    def __init__(self, tables: dict[str, DataFrame], client_id: str | None = None, as_of=None, embed: Callable[[str], list[float]] = models.embed_text) -> None:
        self.tables = {k: tenant_view(v, client_id) if "client_id" in v.columns else v for k, v in tables.items()}
        self.as_of = F.current_timestamp() if as_of is None else as_of
        self.embed = embed
        self.registry: dict[str, Callable[..., DataFrame]] = {n: getattr(self, n) for n in TOOLS}

    def call(self, tool: str, **args) -> DataFrame:
        """Dispatches {tool, args}; an unknown tool is a KeyError."""
        return self.registry[tool](**args)

    def _since(self, table: str, days: float, time: str = "created_at") -> DataFrame:
        return self.tables[table].where(F.col(time) > self.as_of - F.expr(f"INTERVAL {int(days * 24)} HOURS"))

    def _like(self, query: str) -> Column:
        return F.array(*(F.lit(float(x)) for x in self.embed(query)))

    def _named(self, name: str) -> DataFrame:
        """The entity whose name holds ``name`` or of which it is an alias, the least id of several."""
        e = self.tables["entities"]
        match = F.col("name").ilike(f"%{name}%")
        match = match | F.coalesce(F.array_contains("aliases", name), F.lit(False)) if "aliases" in e.columns else match
        return e.where(match).orderBy("entity_id").limit(1)

    def get_active_clusters(self, limit: int = 10) -> DataFrame:
        active = self.tables["clusters"].where("status = 'ACTIVE'")
        return active.orderBy((F.col("priority") == "CRITICAL").desc(), F.col("updated_at").desc_nulls_first(), "cluster_id").limit(limit)

    def get_cluster_details(self, cluster_id: str) -> DataFrame:
        latest = self.tables["records"].where(F.col("cluster_id") == cluster_id).orderBy(F.desc("created_at"), "uid").limit(5)
        evidence = latest.agg(F.array_sort(F.collect_list(F.struct("created_at", "uid", "content_headline"))).alias("supporting_evidence"))
        return self.tables["clusters"].where(F.col("cluster_id") == cluster_id).crossJoin(F.broadcast(evidence))

    def get_cluster_detail(self, cluster_id: str) -> DataFrame:
        """(kind, at, id, value): the cluster's records, newest first, and its confidence history."""
        mine = self.tables["records"].where(F.col("cluster_id") == cluster_id).select(F.lit("RECORD").alias("kind"), F.col("created_at").alias("at"), F.col("uid").cast("string").alias("id"), "confidence")
        past = self.tables["revisions"].where(F.col("cluster_id") == cluster_id).select(F.lit("REVISION").alias("kind"), F.col("revised_at").alias("at"), F.col("cluster_id").cast("string").alias("id"), F.col("new_confidence").alias("confidence"))
        return mine.unionByName(past).orderBy("kind", F.desc("at"), "id")

    def search_spatial(self, lat: float, lon: float, radius_km: float = 50.0) -> DataFrame:
        clusters = self.tables["clusters"].where("status = 'ACTIVE'").select(F.lit("CLUSTER").alias("kind"), F.col("cluster_id").cast("string").alias("id"), "lon", "lat")
        recent = self._since("records", 7).select(F.lit("RECORD").alias("kind"), F.col("uid").cast("string").alias("id"), "lon", "lat")
        found = spatial.within(clusters.unionByName(recent), lon, lat, radius_km * 1000)
        return found.select("kind", "id", (F.col("distance_m") / 1000).alias("distance_km")).orderBy("distance_km", "kind", "id").limit(20)

    def search_intelligence_spatial(self, lat: float, lon: float, radius_km: float, days_back: float = 7, source_type: str | None = None) -> DataFrame:
        recent = self._since("records", days_back)
        recent = recent if source_type is None else recent.where(F.col("source_type") == source_type)
        found = spatial.within(recent, lon, lat, radius_km * 1000)
        return found.select("uid", "source_type", "confidence", "created_at", "lon", "lat", (F.col("distance_m") / 1000).alias("distance_km")).orderBy("distance_km", "uid").limit(50)

    def search_intelligence_semantic(self, query: str, days_back: float = 30, source_types: list[str] | None = None, domain: str | None = None, limit: int = 20, least: float = 0.65) -> DataFrame:
        recent = self._since("records", days_back)
        recent = recent if source_types is None else recent.where(F.col("source_type").isin(*source_types))
        recent = recent if domain is None else recent.where(F.col("domain") == domain)
        return vectors.search(recent, self._like(query), limit, "uid", least)

    def search_historical_intelligence(self, query: str, before_year: int = 2020, limit: int = 15, least: float = 0.6) -> DataFrame:
        old = F.array_contains("tags", "historical") & (F.year("created_at") < before_year)
        return vectors.search(self.tables["records"], self._like(query), limit, "uid", least, old)

    def search_entities_semantic(self, query: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
        e = self.tables["entities"]
        return vectors.top_k(e if entity_type is None else e.where(F.col("entity_type") == entity_type), self._like(query), limit, "entity_id")

    def get_entity_profile(self, name: str) -> DataFrame:
        """One row: the entity, its number of relationships, its ten surest and ten newest revisions."""
        one = self._named(name)
        ids = one.select("entity_id")
        edges = self.tables["edges"]
        ends = edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("entity_id"))
        count = ends.join(F.broadcast(ids), "entity_id").agg(F.count("*").alias("relationship_count"))
        out = edges.join(F.broadcast(ids.withColumnRenamed("entity_id", "a")), "a").orderBy(F.desc("confidence"), "edge_id").limit(10)
        surest = out.agg(F.sort_array(F.collect_list(F.struct("confidence", "type", F.col("b").alias("connected"))), False).alias("relationships"))
        row = one.crossJoin(F.broadcast(count)).crossJoin(F.broadcast(surest))
        if "profile_history" not in self.tables:
            return row
        newest = self.tables["profile_history"].join(F.broadcast(ids), "entity_id").orderBy(F.desc("changed_at")).limit(10)
        return row.crossJoin(F.broadcast(newest.agg(F.array_sort(F.collect_list(F.struct("changed_at", "confidence"))).alias("confidence_history"))))

    def _roots(self, name: str, hops: int) -> DataFrame:
        if not 1 <= hops <= MOST_HOPS:
            raise ValueError(f"hops must be 1 to {MOST_HOPS}")
        return self.tables["entities"].where(F.col("name") == name).select(F.col("entity_id").alias("root"))

    def get_entity_network(self, name: str, hops: int = 2) -> DataFrame:
        return graph.trails(self.tables["edges"], self._roots(name, hops), hops)

    def traverse_entity_graph(self, entity_name: str, hops: int = 2, relationship_types: list[str] | None = None) -> DataFrame:
        """Entities within ``hops``, most threatening first, then nearest: at most 50."""
        edges = self.tables["edges"]
        edges = edges if relationship_types is None else edges.where(F.col("type").isin(*relationship_types))
        near = graph.reach(edges, self._roots(entity_name, hops), hops).where("distance > 0").groupBy(F.col("node").alias("entity_id")).agg(F.min("distance").alias("distance"))
        found = near.join(self.tables["entities"], "entity_id").select("entity_id", "name", "entity_type", "confidence", "threat_score", "distance")
        return found.orderBy(F.desc("threat_score"), "distance", "entity_id").limit(50)

    def get_location_history(self, location_name: str, radius_km: float = 200.0) -> DataFrame:
        """(kind, id, at): the ten newest historical records near a place, and its active clusters."""
        place = self._named_location(location_name).select(F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
        near = lambda df: df.crossJoin(F.broadcast(place)).where(geo.haversine_m(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat")) <= radius_km * 1000)
        past = near(self.tables["records"].where(F.array_contains("tags", "historical"))).orderBy(F.desc("created_at"), "uid").limit(10)
        live = near(self.tables["clusters"].where("status = 'ACTIVE'"))
        rows = lambda df, kind, key, at: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(at).alias("at"))
        return rows(past, "HISTORY", "uid", "created_at").unionByName(rows(live, "CLUSTER", "cluster_id", "updated_at"))

    def _named_location(self, name: str) -> DataFrame:
        return self.tables["entities"].where((F.col("entity_type") == "LOCATION") & F.col("name").ilike(f"%{name}%")).orderBy("entity_id").limit(1)

    def get_morning_brief(self) -> DataFrame:
        """The newest daily brief whose period ends today."""
        today = F.to_date("period_end") == F.to_date(self.as_of)
        return self.tables["digests"].where((F.col("digest_type") == "DAILY_BRIEF") & today).orderBy(F.desc("period_end"), "digest_id").limit(1)

    def get_active_anomalies(self, priority: str | None = None, domain: str | None = None) -> DataFrame:
        live = self.tables["clusters"].where("status in ('ACTIVE', 'ESCALATING')")
        live = live if priority is None else live.where(F.col("priority") == priority)
        live = live if domain is None else live.where(F.col("domain") == domain)
        rank = F.array_position(F.array(*map(F.lit, schemas.ENUMS["priority"])), F.col("priority"))
        return live.orderBy(rank, F.desc("uir_count"), "cluster_id")

    def get_flight_anomalies(self, hours_back: int = 24, min_score: float = 0.7) -> DataFrame:
        """The worst moment of each aircraft over the score."""
        odd = self.tables["flights"].where((F.col("time") > self.as_of - F.expr(f"INTERVAL {hours_back} HOURS")) & (F.col("anomaly_score") > min_score))
        return rollup.best_per_key(odd, "icao24", F.desc("anomaly_score"), "time", "event_id").orderBy("icao24")

    def entities_in_box(self, west: float, south: float, east: float, north: float, limit: int = MOST_ROWS) -> DataFrame:
        inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
        return self.tables["entities"].where(inside).orderBy("entity_id").limit(limit)

    def submit_tasking(self, instruction: str, priority: str = "NORMAL") -> DataFrame:
        spark = self.tables["records"].sparkSession
        return spark.range(1).select(F.sha2(F.lit(instruction), 256).alias("uid"), F.lit("HUMINT").alias("source_type"), F.lit(priority).alias("priority"), F.lit(instruction).alias("content_raw"))

    def director_task(self, instruction: str, target_entity: str | None = None, priority: str = "NORMAL") -> DataFrame:
        """One row with the record of an instruction and its one queue row: no second job without a
        record."""
        record = self.submit_tasking(instruction, priority).withColumns({"source_agent": F.lit("director"), "domain": F.lit("UNKNOWN"), "tags": F.array(F.lit("director_task"), F.lit("humint")), "target_id": F.lit(target_entity).cast("string")})
        return record.withColumns({"queue_id": F.concat(F.lit("q-"), "uid"), "trigger_type": F.lit("DIRECTOR_TASKED"), "status": F.lit("PENDING")})

    def get_system_health(self) -> DataFrame:
        return rollup.health({f"n_{k}": v for k, v in self.tables.items()})

    def get_agent_health(self) -> DataFrame:
        """Each agent's newest completion and failures of the last day."""
        recent = self.tables["tasks"].where(F.col("created_at") > self.as_of - F.expr("INTERVAL 24 HOURS"))
        return recent.groupBy("agent").agg(F.max("completed_at").alias("last_active"), F.count_if(F.col("status") == "FAILED").alias("failures_24h")).orderBy(F.desc("last_active"), "agent")

    def missions_active(self) -> DataFrame:
        return self.tables["missions"].where("is_active")

    def page(self, table: str, order: str, size: int = 100, number: int = 0) -> DataFrame:
        if not 0 < size <= MOST_ROWS:
            raise ValueError(f"a page has 1 to {MOST_ROWS} rows")
        return self.tables[table].orderBy(order).offset(size * number).limit(size)


def new_mission(spark, category: str, keywords: str) -> DataFrame:
    """A mission from chat: category upper-cased, keywords split at commas, active for everyone."""
    words = F.filter(F.transform(F.split(F.lit(keywords), ","), F.trim), lambda w: w != "")
    return spark.range(1).select(F.sha2(F.lit(f"{category}:{keywords}"), 256).alias("focus_id"), F.upper(F.lit(category)).alias("category"), words.alias("keywords"), F.lit(True).alias("is_active"), F.lit(GLOBAL_CLIENT).alias("client_id"))
