"""Table schemas, value rules and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tenant that everyone sees.
GLOBAL_CLIENT = "00000000-0000-0000-0000-000000000000"

# The enumerations of the data model.
ENUMS = {
    "source_type": ("OSINT", "GEOINT", "SIGINT", "TECHINT", "FININT", "HUMINT", "DERIVED", "SYSTEM"),
    "priority": ("CRITICAL", "HIGH", "NORMAL", "LOW"),
    "status": ("PENDING", "PROCESSING", "DONE", "FAILED"),
    "entity_type": ("PERSON", "ORGANIZATION", "LOCATION", "VESSEL", "AIRCRAFT", "EVENT", "FACILITY", "WEAPON", "CONCEPT", "OTHER"),
}
#: Columns that must lie in [0, 1].
UNIT_COLUMNS = ("source_credibility", "confidence", "trust_score", "threat_score", "anomaly_score")

SCHEMAS = {
    "mission_focus": "focus_id string, category string, keywords array<string>, target_entities array<string>, is_active boolean, client_id string",
    "source_authority": "source_name string, source_type string, trust_score double",
    "flight_tracks": "time timestamp, icao24 string, callsign string, registration string, lon double, lat double, altitude_ft int, squawk string, anomaly_score double",
    "vessel_positions": "time timestamp, mmsi string, name string, vessel_type string, flag string, lon double, lat double, anomaly_score double",
    "seismic_events": "time timestamp, usgs_id string, magnitude double, place string, lon double, lat double, depth_km double, tsunami boolean",
    "satellite_positions": "time timestamp, norad_id string, name string, category string, lon double, lat double, altitude_km double",
    "intelligence_records": "uid string, created_at timestamp, source_type string, source_agent string, source_name string, source_url string, source_credibility double, confidence double, priority string, verified boolean, content_headline string, content_summary string, content_raw string, content_hash string, entities array<string>, tags array<string>, domain string, event_type string, mission_id string, lon double, lat double, embedding array<float>, linked_uids array<string>, cluster_id string, metadata string, client_id string",
    "intelligence_clusters": "cluster_id string, title string, domain string, status string, priority string, confidence double, uir_count int, lon double, lat double, embedding array<float>, updated_at timestamp, client_id string",
    "intelligence_digests": "digest_id string, digest_type string, period_start timestamp, period_end timestamp, summary string, cluster_refs array<string>",
    "agent_tasks": "task_id string, agent string, status string, created_at timestamp, completed_at timestamp, error_message string",
    "entities": "entity_id string, entity_type string, name string, aliases array<string>, description string, confidence double, threat_score double, watch_status string, first_seen timestamp, last_seen timestamp, mention_count int, lon double, lat double, embedding array<float>, uir_refs array<string>, metadata string",
    "entity_relationships": "relationship_id string, entity_a_id string, entity_b_id string, relationship_type string, confidence double, evidence_uids array<string>, evidence_count int, mention_count int, last_confirmed timestamp, still_valid boolean, client_id string",
    "entity_profile_history": "history_id string, entity_id string, changed_at timestamp, confidence double, valid_from timestamp, valid_to timestamp",
    "cluster_revisions": "revision_id string, cluster_id string, revised_at timestamp, previous_confidence double, new_confidence double, confidence_delta double",
    "analysis_queue": "queue_id string, created_at timestamp, uir_uid string, trigger_type string, priority string, status string, domain string, error_message string, client_id string",
    "ai_feedback": "client_id string, original_subject string, original_predicate string, original_object string, feedback_type string, human_correction string, created_at timestamp",
}


def violations(df: DataFrame) -> Column:
    """Array of the names of a row's columns that break an enumeration or range; null breaks none."""
    rules = [(c, F.col(c).isin(*ENUMS[c])) for c in df.columns if c in ENUMS]
    rules += [(c, F.col(c).between(0.0, 1.0)) for c in df.columns if c in UNIT_COLUMNS]
    rules += [("lat", F.col("lat").between(-90.0, 90.0))] if "lat" in df.columns else []
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(c)) for c, ok in rules]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with a ``violations`` column."""
    marked = df.withColumn("violations", violations(df))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)
