"""Raw batches: written once, found again by pointer or by day."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.scalars import epoch_millis, instant
from eventloom.functions.variants import fields_of
from eventloom.model import JSON_TIME, POINTER_SCHEMA, RAW_SCHEMA
from eventloom.operators.dedup import once_per_key
from eventloom.operators.parsing import explode_events, open_envelopes, parse_bodies
from eventloom.session import materialise, run_folder
from eventloom.sources import id_table, paths

KEY_PREFIX = "raw-events/"
RAW_PARTITIONS = ("app_id", "year", "month", "day")
POINTER_FIELDS = ("requestId", "batchId", "receivedAt", "storageLocation")
# Error texts.
BAD_MESSAGE = "Failed to parse queue message: not a JSON object"
MISSING_BATCH = "Failed to fetch raw batch: Raw batch not found: "


def day_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
    }


def raw_key(df: DataFrame, app_id: Column) -> DataFrame:
    """Adds ``app_id`` (``unknown`` if there is none), the day parts and
    ``storage_location``."""
    keyed = df.withColumn("app_id", F.coalesce(F.nullif(app_id, F.lit("")), F.lit("unknown")))
    keyed = keyed.withColumns(day_parts(F.col("received_at")))
    file_name = F.concat(
        F.col("batch_id"), F.lit("_"), epoch_millis(F.col("received_at")).cast("string"),
        F.lit(".json"))
    return keyed.withColumn("storage_location", F.concat(
        F.lit(KEY_PREFIX), F.concat_ws("/", *RAW_PARTITIONS, file_name)))


def to_raw_batches(opened: DataFrame) -> DataFrame:
    """Opened envelopes as raw batches: the body stays the text it came as."""
    first_app = F.try_variant_get("events_value", "$[0].source.appId", "string")
    sized = opened.withColumn("event_count", F.coalesce(F.size("events"), F.lit(0)))
    return raw_key(sized, first_app).select(*RAW_SCHEMA.fieldNames())


def read_raw(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """The raw batches below ``path``, or below some of its ``folders`` only."""
    reader = spark.read.schema(RAW_SCHEMA).options(**JSON_TIME)
    return reader.json(path) if folders is None else reader.option("basePath", path).json(folders)


def write_raw_batches(raw: DataFrame, path: str, commit_id: str | None = None) -> None:
    """Adds batches whose ``batch_id`` is not there yet, on whatever day it came before.

    Known ids have a table of their own beside the batches, of which only row groups that may
    hold one are read; bodies are not shuffled for the check.  With ``commit_id`` the batches land in a
    folder of their own, which a retry replaces as a whole and does not count as known.
    """
    spark = raw.sparkSession
    ids = id_table.table_of(path)
    with run_folder(spark, "raw"):
        if not id_table.exists(spark, ids) and paths.exists(spark, path):
            id_table.add_ids(_ids_of(read_raw(spark, path)), ids, "batch_id", uuid.uuid4().hex)
        known = id_table.read_ids(spark, ids, "batch_id", commit_id)
        known = materialise(id_table.already_known(raw, known, "batch_id"), "known")
        new = once_per_key(raw, "batch_id", [F.col("received_at")])
        new = new.join(known, "batch_id", "left_anti").select(*RAW_SCHEMA.fieldNames())
        target, mode = path, "append"
        if commit_id is None:
            # Without a folder of their own, what is new is fixed before the rows land.
            new = materialise(new, "new")
        else:
            target, mode = f"{path}/commit_id={commit_id}", "overwrite"
        (
            new.hint("rebalance", *RAW_PARTITIONS)
            .write.mode(mode).option("partitionOverwriteMode", "static").options(**JSON_TIME)
            .partitionBy(*RAW_PARTITIONS).json(target)
        )
        written = new if commit_id is None else read_raw(spark, target)
        id_table.add_ids(_ids_of(written), ids, "batch_id", commit_id or uuid.uuid4().hex)


def _ids_of(raw: DataFrame) -> DataFrame:
    return raw.select("batch_id", F.col("received_at").alias("seen"), F.to_date("received_at").alias("dt"))


def raw_partitions_hive(raw: DataFrame) -> DataFrame:
    """One row per raw event with the columns of the ``app/env/day/hour`` layout."""
    opened = open_envelopes(parse_bodies(raw.select("batch_id", "received_at", "body")))
    return explode_events(opened.select("batch_id", "received_at", "events")).select(
        "*",
        F.coalesce(F.try_variant_get("event", "$.source.appId", "string"), F.lit("unknown"))
        .alias("app_id"),
        F.coalesce(F.try_variant_get("event", "$.source.env", "string"), F.lit("unknown"))
        .alias("env"),
        F.date_format("received_at", "yyyy-MM-dd").alias("dt"),
        F.date_format("received_at", "HH").alias("hour"),
    )


def write_raw_hive(raw: DataFrame, path: str) -> None:
    rows = raw_partitions_hive(raw)
    keys = ("app_id", "env", "dt", "hour")
    (
        rows.hint("rebalance", *keys)
        .write.mode("append").options(**JSON_TIME).partitionBy(*keys).json(path)
    )


def make_pointers(raw: DataFrame) -> DataFrame:
    """The light message per batch: where it lies, not what it holds."""
    return raw.select(*POINTER_SCHEMA.fieldNames())


def encode_pointers(pointers: DataFrame, base64: bool = False) -> DataFrame:
    """Pointers as message text."""
    text = F.to_json(F.struct(
        F.col("request_id").alias("requestId"),
        F.col("batch_id").alias("batchId"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt"),
        F.col("storage_location").alias("storageLocation"),
    ))
    if base64:
        text = F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")
    return pointers.select(text.alias("message"))


def decode_pointers(df: DataFrame, message: str = "message") -> DataFrame:
    """Reads plain or base64 JSON messages; ``reject`` tells which are neither."""
    text = F.col(message)
    unpacked = F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))
    fields = F.coalesce(
        fields_of(F.try_parse_json(text), POINTER_FIELDS),
        fields_of(F.try_parse_json(unpacked), POINTER_FIELDS),
    )

    def member(name: str) -> Column:
        return F.try_variant_get(F.col("__fields")[name], "$", "string")

    return df.withColumn("__fields", fields).withColumns({
        "batch_id": member("batchId"),
        "request_id": member("requestId"),
        "received_at": instant(member("receivedAt")),
        "storage_location": member("storageLocation"),
        "reject": F.when(F.col("__fields").isNull(), BAD_MESSAGE),
    }).drop("__fields")


def distinct_pointers(pointers: DataFrame) -> DataFrame:
    """One pointer per batch, the earliest; repeats meet before the shuffle."""
    return pointers.groupBy("batch_id").agg(
        F.min(F.struct("received_at", "request_id", "storage_location")).alias("p")
    ).select("batch_id", "p.request_id", "p.received_at", "p.storage_location")


def found_batches(pointers: DataFrame, raw: DataFrame) -> DataFrame:
    """The pointers whose batch exists, with its ``body``.

    App and day, as the pointer's location names them, restrict the raw scan to their
    partitions.  The distinct pointers are written first, so Spark knows their size when it
    plans the join; few are sent to that scan, and the bodies are not shuffled.
    """
    day = day_parts(F.col("received_at"))
    # An app may hold slashes: it is what lies between the prefix and the day.
    app = F.regexp_extract(
        "storage_location", rf"(?s)\A{KEY_PREFIX}(.*)/\d{{4,}}/\d\d/\d\d/[^/]*\z", 1)
    wanted = distinct_pointers(pointers).withColumns({f"__{k}": v for k, v in day.items()})
    wanted = materialise(wanted.withColumn("__app_id", app), "wanted")
    bodies = raw.select(F.col("batch_id").alias("__id"), "body", *RAW_PARTITIONS)
    on = F.col("__id") == F.col("batch_id")
    for part in RAW_PARTITIONS:
        on = on & (F.col(part) == F.col(f"__{part}"))
    return bodies.join(wanted, on).select(*POINTER_SCHEMA.fieldNames(), "body")


def missing_batches(pointers: DataFrame, found: DataFrame) -> DataFrame:
    """The pointers that lead nowhere."""
    return distinct_pointers(pointers).join(found.select("batch_id"), "batch_id", "left_anti")


def resolve_pointers(pointers: DataFrame, raw: DataFrame) -> DataFrame:
    """All pointers with the ``body`` of their batch, or the ``error`` row it gives."""
    found = found_batches(pointers, raw)
    lost = missing_batches(pointers, found)
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(
        lost.withColumns({
            "body": F.lit(None).cast("string"),
            "error": F.concat(F.lit(MISSING_BATCH), F.col("batch_id")),
        }))


def replay_raw(raw: DataFrame, start: date, end: date) -> DataFrame:
    """Pointers of all batches received on the days ``start`` up to before ``end``."""
    day = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"),
                      F.col("day").cast("int"))
    return make_pointers(raw.where((day >= F.lit(start)) & (day < F.lit(end))))
