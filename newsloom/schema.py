"""Record types of the radar: items, classifications, history, health and diagnostics."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


CLASSIFICATION = _struct("category string, emoji string, score int, reasons strings, evidence_index int, evidence_text string, public_context boolean, strong_public_context boolean")
ITEM = _struct(
    "kind string, title string, url string, source_url string, published_at timestamp, source string, summary string, raw_text string, excerpts strings, territory_id string, territory_name string, "
    "state_code string, edition string, scraper string, preview_only boolean, family_ord int, query_ord int, item_ord bigint"
)
SEEN = _struct("id string, sent_at timestamp, url string, title string, title_fingerprint string, content_tokens strings, category string")
HEALTH = _struct("name string, status string, item_count bigint, duration_ms bigint, message string")
DIAGNOSTIC = _struct("name string, adapter string, status string, item_count bigint, message string")
#: The order in which equal items stand: source family, request, place in the answer.
ORDINALS = ["family_ord", "query_ord", "item_ord"]
