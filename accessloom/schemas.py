"""The logical tables. Every table but sync_runs and events is partitioned by sync_id; empty strings mean unset."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "sync_runs": "sync_id STRING, sync_type STRING, parent_sync_id STRING, linked_sync_id STRING, started_at TIMESTAMP, ended_at TIMESTAMP, supports_diff BOOLEAN, compacted BOOLEAN",
    "resource_types": "sync_id STRING, external_id STRING, display_name STRING, description STRING, traits ARRAY<STRING>, sourced_externally BOOLEAN, discovered_at TIMESTAMP",
    "resources": "sync_id STRING, resource_type_id STRING, resource_id STRING, display_name STRING, description STRING, parent STRUCT<resource_type_id: STRING, resource_id: STRING>, status STRING, status_details STRING, created_at TIMESTAMP, profile STRING, user_trait STRUCT<emails: ARRAY<STRUCT<address: STRING, is_primary: BOOLEAN>>, account_type: STRING, login: STRING>, child_type_ids ARRAY<STRING>, discovered_at TIMESTAMP",
    "entitlements": "sync_id STRING, external_id STRING, resource_type_id STRING, resource_id STRING, display_name STRING, description STRING, slug STRING, purpose STRING, grantable_to ARRAY<STRING>, exclusion_groups ARRAY<STRUCT<id: STRING, order: INT, is_default: BOOLEAN>>, discovered_at TIMESTAMP",
    "grants": "sync_id STRING, external_id STRING, entitlement_id STRING, resource_type_id STRING, resource_id STRING, principal_resource_type_id STRING, principal_resource_id STRING, expansion STRUCT<entitlement_ids: ARRAY<STRING>, shallow: BOOLEAN, resource_type_ids: ARRAY<STRING>>, needs_expansion BOOLEAN, sources MAP<STRING, BOOLEAN>, immutable BOOLEAN, insert_resource BOOLEAN, external_match STRUCT<kind: STRING, trait: STRING, key: STRING, value: STRING>, discovered_at TIMESTAMP",
    "events": "feed_id STRING, event_id STRING, occurred_at TIMESTAMP, event_type STRING, entitlement_id STRING, principal_resource_type_id STRING, principal_resource_id STRING, payload STRING",
    "assets": "sync_id STRING, external_id STRING, content_type STRING, data BINARY, discovered_at TIMESTAMP",
    "sessions": "sync_id STRING, key STRING, value BINARY",
    "source_cache": "row_kind STRING, scope_key STRING, validator STRING, payload STRING",
}
TABLES = ("resource_types", "resources", "entitlements", "grants", "assets")
#: Keys of the rows of one snapshot.
KEYS = {
    "resource_types": ["external_id"],
    "resources": ["resource_type_id", "resource_id"],
    "entitlements": ["external_id"],
    "grants": ["external_id"],
    "assets": ["external_id"],
}
#: Fixed values.
SYNC_TYPES = ("full", "partial", "resources_only", "partial_upserts", "partial_deletions")
TRAITS = ("USER", "GROUP", "ROLE", "APP", "SECRET", "SECURITY_INSIGHT")


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])
