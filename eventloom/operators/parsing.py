"""From request bodies to envelopes: parse, stamp, explode, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalars import is_uuid, md5_uuid, strip
from eventloom.functions.variants import as_array, fields_of

ENVELOPE_FIELDS = ("schemaVersion", "sentAt", "events")

# What a caller is told.
MISSING_BODY = "Missing request body"
INVALID_JSON = "Invalid JSON in request body"


def parse_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``envelope`` (parsed JSON) and ``reject`` (why there is none)."""
    text = F.col(body)
    parsed = df.withColumn("envelope", F.try_parse_json(text))
    reject = F.when(text.isNull() | (text == ""), MISSING_BODY).when(
        F.col("envelope").isNull(), INVALID_JSON
    )
    return parsed.withColumn("reject", reject)


def open_envelopes(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """Adds the envelope's members: ``schema_version``, ``sent_at``,
    ``events_value`` (parsed JSON as sent) and ``events`` (NULL unless an array)."""
    return (
        df.withColumn("__members", fields_of(F.col(envelope), ENVELOPE_FIELDS))
        .withColumn("schema_version", F.col("__members.schemaVersion"))
        .withColumn("sent_at", F.col("__members.sentAt"))
        .withColumn("events_value", F.col("__members.events"))
        .withColumn("events", as_array(F.col("events_value")))
        .drop("__members")
    )


def explode_events(df: DataFrame, events: str = "events") -> DataFrame:
    """One row per event with its position in the batch."""
    kept = [c for c in df.columns if c != events]
    exploded = df.select(*kept, F.posexplode_outer(events).alias("event_index", "event"))
    return exploded.where("event_index IS NOT NULL")


def request_id(header: Column, fallback: Column | None = None) -> Column:
    """The caller's id if it is a UUID once trimmed, else a new one."""
    trimmed = strip(header)
    fresh = F.uuid() if fallback is None else fallback
    return F.when(is_uuid(trimmed), trimmed).otherwise(fresh)


def stamp_batches(
    df: DataFrame, header: str = "request_header", now: Column | None = None,
    content_key: Column | None = None,
) -> DataFrame:
    """Adds ``batch_id``, ``request_id`` and ``received_at``.

    With ``content_key`` both ids are derived from it, so a rerun of the job gives
    the same batches; without it they are random.
    """
    if content_key is None:
        batch, request = F.uuid(), None
    else:
        batch = md5_uuid(content_key)
        request = md5_uuid(F.concat(F.lit("request:"), content_key))
    received = F.current_timestamp() if now is None else now
    return (
        df.withColumn("batch_id", batch)
        .withColumn("request_id", request_id(F.col(header), request))
        .withColumn("received_at", received.cast("timestamp_ntz"))
    )


def batch_summary(df: DataFrame, events: str = "events", accepted: str = "accepted") -> DataFrame:
    """What the caller is told per batch: size, event ids in order, accepted or not.

    A batch is one row, so its ids are read in place and nothing is shuffled.
    """
    ids = F.transform(F.col(events), lambda ev: F.try_variant_get(ev, "$.eventId", "string"))
    return df.select(
        "batch_id",
        F.coalesce(F.size(events), F.lit(0)).alias("event_count"),
        ids.alias("event_ids"),
        F.col(accepted).alias("accepted"),
    )
