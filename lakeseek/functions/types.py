"""Document types, their aliases, and the schema of stored points."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {
    **dict.fromkeys(("pdf",), "pdf"),
    **dict.fromkeys(("markdown", "md"), "markdown"),
    **dict.fromkeys(("json",), "json"),
    **dict.fromkeys(("api_payload", "payload", "ndjson"), "api_payload"),
    **dict.fromkeys(("code", "source"), "code"),
    **dict.fromkeys(("sql_dump", "sql"), "sql_dump"),
    **dict.fromkeys(("legal", "law", "contract", "gesetz", "vertrag"), "legal"),
    **dict.fromkeys(("text", "plain", "txt"), "text"),
}


def normalise_type(raw: str) -> str:
    """The document type that a name or alias means."""
    found = ALIASES.get("_".join(str(raw).lower().strip().split("-")))
    if found is None:
        raise ValueError(f"unknown document type {raw!r}; known: {sorted(ALIASES)}")
    return found


def document_type(raw: Column) -> Column:
    """``normalise_type`` as a column expression; unknown names raise."""
    key = F.replace(F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")), F.lit("-"), F.lit("_"))
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    found = F.try_element_at(table, key)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown document type "), F.coalesce(raw, F.lit("null")))))


def parse_time(value: Any) -> float | None:
    """Epoch seconds of a datetime, a number or an ISO-8601 text; without a zone, UTC is meant."""
    if value is None or isinstance(value, (int, float)):
        return None if value is None else float(value)
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if not isinstance(value, datetime):
        raise ValueError(f"not a point in time: {value!r}")
    return (value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp()


def utc_now() -> datetime:
    """The present; taken once for each ingest, on the driver."""
    return datetime.now(UTC)
