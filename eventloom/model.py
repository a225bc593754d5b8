"""Schemas, limits and the fixed vocabulary of the event contract."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

# Fixed values of the wire contract.
EVENT_TYPES = ("track", "page", "identify")
PLATFORMS = ("web", "ios", "android", "server")
ENVIRONMENTS = ("dev", "staging", "prod", "test")
# `\z`, as `$` would let a line end follow.
NAME_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*\z"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
ISO_PATTERN = r"^\d{4}-\d\d-\d\dT([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z\z"
IDENTIFIER_MAX = 255
LOCALE_MAX = 50
TIMEZONE_MAX = 100
PAGE_FIELD_MAX = 2048

RETENTION_DAYS = 365

# JSON files keep microseconds; the default writer would cut them.
JSON_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


@dataclass(frozen=True)
class Limits:
    """Configurable limits; each must stay within its hard cap."""

    min_events: int = 1
    max_events: int = 100
    max_payload: int = 1_048_576
    max_depth: int = 3
    max_keys: int = 50
    max_string: int = 2048
    max_array: int = 100
    max_window_days: int = 31
    default_page: int = 50
    max_page: int = 200

    def __post_init__(self) -> None:
        for field in fields(self):
            value, low = getattr(self, field.name), _FLOORS.get(field.name, 1)
            cap = _CAPS.get(field.name)
            if value < low or (cap is not None and value > cap):
                raise ValueError(f"{field.name}={value} is outside {low}..{cap}")


# The smallest and largest setting each limit may take.
_FLOORS = {"max_payload": 1024}
_CAPS = {
    "max_events": 100,
    "max_payload": 1_048_576,
    "max_depth": 3,
    "max_keys": 50,
    "max_string": 2048,
    "max_array": 100,
    "max_window_days": 90,
    "max_page": 1000,
}


@dataclass(frozen=True)
class EventQuery:
    """One read of the store.  Times are UTC, ``start`` inclusive, ``end`` exclusive."""

    app_id: str
    start: datetime
    end: datetime
    types: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    user_id: str | None = None
    anonymous_id: str | None = None
    session_id: str | None = None
    limit: int = 50
    sort: str = "desc"
    cursor: str | None = None


ISSUE = T.StructType(
    [
        T.StructField("event_index", T.IntegerType()),
        T.StructField("rule", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("code", T.StringType()),
    ]
)

CONSENT = T.StructType(
    [
        T.StructField("analytics", T.BooleanType()),
        T.StructField("experimentation", T.BooleanType()),
        T.StructField("personalization", T.BooleanType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

# One event as held in the store.  Open parts are JSON text.
EVENT_FIELDS = [
    T.StructField("app_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("occurred_at", T.TimestampNTZType()),
    T.StructField("occurred_at_iso", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("env", T.StringType()),
    T.StructField("app_version", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("anonymous_id", T.StringType()),
    T.StructField("actor_session_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("consent", CONSENT),
    T.StructField("properties", T.StringType()),
    T.StructField("traits", T.StringType()),
]

STORE_SCHEMA = T.StructType(
    EVENT_FIELDS
    + [
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("event_index", T.IntegerType()),
        T.StructField("dt", T.DateType()),
    ]
)

POINTER_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("storage_location", T.StringType()),
    ]
)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("event_count", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("storage_location", T.StringType()),
        T.StructField("app_id", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("day", T.StringType()),
    ]
)
