"""Declared schemas of the engine's tables and results; nothing is inferred from data. They are in DDL."""

EDGES = "calls array<string>, imports array<string>, extends array<string>"
FILE = "project_id string, file_id long, path string, language string, category string, size long, content string, content_hash string, status string, indexed_at timestamp_ntz"
SYMBOL = f"project_id string, file_id long, path string, symbol_id string, name string, qualified_name string, kind string, language string, start_line int, end_line int, parent_name string, {EDGES}"
CHUNK = "project_id string, file_id long, path string, chunk_id string, symbol string, kind string, language string, chunk_type string, start_line int, end_line int, content string, content_hash string"
HIT = "chunk_id string, file_id long, path string, language string, symbol string, symbol_kind string, start_line int, end_line int, content string, chunk_type string, score double"
METRIC_EVENT = "name string, project_id string, value double, recorded_at timestamp_ntz"
DELIVERY = "delivery_id string, event string, signature string, body string, received_at timestamp"
JOB_EVENT = "job_id string, project_id string, type string, status string, at timestamp"
QUESTION = "id string, project_slug string, query string, mode string, expected_files array<string>, expected_symbols array<string>, notes string"
COMMIT = "sha string, author string, email string, authored_at timestamp, parents array<string>, message string"

#: Names accepted in the enumerated columns.
CHUNK_TYPES = ("code", "documentation", "test", "configuration", "other")
FILE_STATUSES = ("pending", "indexed", "failed", "removed")
JOB_STATUSES = ("queued", "running", "completed", "failed", "cancelled")
METRICS = ("embedding_latency_ms", "embedding_failures", "qdrant_latency_ms", "search_latency_ms", "indexing_duration_ms", "job_failures", "queue_depth")
