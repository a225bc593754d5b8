"""Event shapes: canonical session, stored form, keys, API form, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.cursors import sort_key
from eventloom.functions.redaction import redact_json
from eventloom.functions.scalars import blank_to_null, epoch_millis, epoch_seconds
from eventloom.model import RETENTION_DAYS

API_COLUMNS = (
    "schema_version", "event_id", "type", "occurred_at_iso", "received_at", "app_id",
    "platform", "env", "app_version", "user_id", "anonymous_id", "actor_session_id",
    "session_id", "context", "name", "properties", "traits",
)


def canonicalize_session(
    df: DataFrame, actor: str = "actor_session_id", context: str = "context_session_id"
) -> DataFrame:
    """Moves the actor's session id to the context when the context has none.

    When both are set, both stay.  Adds ``session_id``, the context's value."""
    in_actor, in_context = blank_to_null(F.col(actor)), blank_to_null(F.col(context))
    moved = in_actor.isNotNull() & in_context.isNull()
    return df.withColumns({
        "session_id": F.when(moved, F.col(actor)).otherwise(F.col(context)),
        actor: F.when(~moved, F.col(actor)),
    })


def to_stored(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Stamps events that carry their batch's ``received_at`` for the store."""
    now = F.current_timestamp() if processed_at is None else processed_at
    return df.withColumn("processed_at", now.cast("timestamp_ntz")).withColumn(
        "dt", F.to_date("occurred_at")
    )


def derive_keys(df: DataFrame) -> DataFrame:
    """Key columns of the three access paths; fields of other event types blanked."""
    app = F.col("app_id")
    sk = sort_key(F.col("occurred_at_iso"), F.col("event_id"))
    user = F.coalesce(blank_to_null(F.col("user_id")), F.lit("anonymous"))
    session = F.coalesce(blank_to_null(F.col("session_id")), F.lit("no-session"))
    identify = F.col("type") == "identify"
    return df.withColumns({
        "pk": app,
        "sk": sk,
        "gsi1pk": F.concat_ws("#", app, user),
        "gsi1sk": sk,
        "gsi2pk": F.concat_ws("#", app, session),
        "gsi2sk": sk,
        "occurred_at_ms": epoch_millis(F.col("occurred_at")),
        "expires_at": expires_at(F.col("occurred_at")),
        "name": F.when(~identify, F.col("name")),
        "properties": F.when(~identify, F.col("properties")),
        "traits": F.when(identify, F.col("traits")),
    })


def derive_day_keys(df: DataFrame) -> DataFrame:
    """Key columns bucketed by UTC day."""
    day = F.date_format("occurred_at", "yyyy-MM-dd")

    def bucket(*parts: Column) -> Column:
        return F.concat_ws("#", F.lit("APP"), F.col("app_id"), *parts, F.lit("DAY"), day)

    def optional(label: str, column: str) -> Column:
        value = blank_to_null(F.col(column))
        return F.when(value.isNotNull(), bucket(F.lit(label), value))

    return df.withColumns({
        "day_pk": bucket(),
        "day_sk": F.concat_ws(
            "#", F.lit("TS"), epoch_millis(F.col("occurred_at")).cast("string"),
            F.lit("EVT"), F.col("event_id")),
        "user_day_pk": optional("USER", "user_id"),
        "anonymous_day_pk": optional("ANON", "anonymous_id"),
    })


def to_api(df: DataFrame, *extra: str) -> DataFrame:
    """What a reader of the store may see; absent columns read as NULL."""
    have = set(df.columns)
    identify = F.col("type") == "identify"

    def visible(name: str) -> Column:
        column = F.col(name) if name in have else F.lit(None).cast("string")
        if name in ("name", "properties"):
            column = F.when(~identify, column)
        elif name == "traits":
            column = F.when(identify, column)
        return column.alias(name)

    return df.select(*extra, *[visible(name) for name in API_COLUMNS])


def expires_at(occurred_at: Column, days: int = RETENTION_DAYS) -> Column:
    """Epoch second at which the event leaves the store."""
    return epoch_seconds(occurred_at) + F.lit(days * 86_400)


def ttl_remaining(occurred_at: Column, now: Column, days: int = RETENTION_DAYS) -> Column:
    """Whole seconds left before expiry, never negative."""
    micros = F.unix_micros(occurred_at.cast("timestamp")) + F.lit(days * 86_400_000_000)
    left = micros - F.unix_micros(now.cast("timestamp"))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(left / F.lit(1_000_000)).cast("bigint"))


def redact(df: DataFrame, column: str) -> DataFrame:
    """Hides members with telling names in a JSON column, however deep they lie."""
    return redact_json(df, column)
