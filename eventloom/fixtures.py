"""Event-shaped views over the generated ``events`` table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.scalars import iso_text, md5_uuid

BATCH_SPAN = 150
FAULT_STEP, FAULT_CYCLE, FAULTS = 53, 1009, 19
ENVELOPE_CYCLE = 23


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def canonical(events: DataFrame) -> DataFrame:
    """One valid stored event per source row; ``n`` is the source's own id."""
    n, user = F.col("event_id"), F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "view", "page")
        .when(F.col("event_type") == "signup", "identify")
        .otherwise("track")
    )
    name = (
        F.when(F.col("event_type") == "view", "page.viewed")
        .when(F.col("event_type") == "click", "button.clicked")
        .when(F.col("event_type") == "purchase", "checkout.completed")
        .when(F.col("event_type") == "error", "app.error")
    )
    anonymous = (n % 5 == 0) | (n % 3 == 0)
    session = F.when(
        n % 11 != 0,
        F.concat(F.lit("sess_"), user.cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")),
    )
    received = F.col("ts") + F.make_dt_interval(secs=2 + n % 7)
    base = events.select(
        n.alias("n"),
        F.concat(F.lit("app"), (user % 3).cast("string")).alias("app_id"),
        md5_uuid(n.cast("string")).alias("event_id"),
        kind.alias("type"),
        name.alias("name"),
        F.col("ts").alias("occurred_at"),
        iso_text(F.col("ts")).alias("occurred_at_iso"),
        F.lit("1.0.0").alias("schema_version"),
        F.element_at(F.array(*map(F.lit, ("web", "ios", "android", "server"))),
                     (n % 4 + 1).cast("int")).alias("platform"),
        F.lit("prod").alias("env"),
        F.when(n % 5 != 0, F.concat(F.lit("user_"), user.cast("string"))).alias("user_id"),
        F.when(anonymous, F.concat(F.lit("anon_"), (user % 50).cast("string")))
        .alias("anonymous_id"),
        session.alias("session_id"),
        received.alias("received_at"),
        (received + F.make_dt_interval(secs=F.lit(0.15).cast("decimal(18,6)") * (n % 13)))
        .alias("processed_at"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        user.alias("user_no"),
        F.expr(f"event_id div {BATCH_SPAN}").alias("w"),
    )
    return base.withColumn(
        "properties",
        F.when(F.col("type") != "identify", F.to_json(F.struct("k", "value"))),
    ).withColumn(
        "traits",
        F.when(F.col("type") == "identify", F.to_json(F.struct(
            F.concat(F.lit("p"), (F.col("user_no") % 4).cast("string")).alias("plan")))),
    ).withColumn("dt", F.to_date("occurred_at"))


def store_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(load(spark, sf_dir, "events"))


def batch_key() -> Column:
    return F.concat_ws("-", F.col("app_id"), F.col("w").cast("string"))


def fault() -> Column:
    """Which rule the event breaks: 1..19, or NULL."""
    r = F.expr(f"n % {FAULT_CYCLE} div {FAULT_STEP}")
    hit = (F.col("n") % FAULT_CYCLE % FAULT_STEP == 0) & r.between(1, FAULTS)
    return F.when(hit, r.cast("int"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _member(key: str, value: Column) -> Column:
    """``"key":value`` or NULL when there is no value; joined by ``concat_ws``."""
    return F.concat(F.lit(f'"{key}":'), value)


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _counted(prefix: str, count: int) -> str:
    return ",".join(f'"{prefix}{i}":{i}' for i in range(count))


def event_json(dirty: bool) -> Column:
    """The event as a client would send it; with ``dirty``, broken as ``fault`` says.

    Values next to a limit but inside it ride on clean rows, so a check that is off
    by one rejects batches that must pass.
    """
    r = F.col("fault") if dirty else F.lit(None).cast("int")

    def broken(number: int, bad: Column, good: Column) -> Column:
        return F.when(r == number, bad).otherwise(good) if dirty else good

    n = F.col("n")
    text = lambda s: F.lit(s)
    forced = F.when(r == 19, "identify").when(r.isNotNull(), "track").otherwise(F.col("type"))
    kind = forced if dirty else F.col("type")
    identify = kind == "identify"
    name = F.when(~identify, F.coalesce(F.col("name"), F.lit("app.forced")))
    odd = n % 2 == 1
    session = F.col("session_id")

    source = _object(
        _member("appId", _quoted(F.col("app_id"))),
        _member("platform", broken(7, text('"tv"'), _quoted(F.col("platform")))),
        _member("env", broken(8, text('"production"'), text('"prod"'))),
        _member("appVersion", broken(9, text(f'"{"9" * 256}"'),
                                     F.when(n % 7 == 0, f'"{"9" * 255}"'))),
    )
    actor = _object(
        _member("userId", _quoted(F.col("user_id"))),
        _member("anonymousId", _quoted(F.col("anonymous_id"))),
        _member("sessionId", F.when(odd, _quoted(session))),
    )
    context = _object(
        _member("sessionId", F.when(~odd, _quoted(session))),
        _member("locale", broken(11, text(f'"{"l" * 51}"'), text(f'"{"l" * 50}"'))),
        _member("page", F.when(F.col("type") == "page", _object(
            _member("url", _quoted(F.concat(F.lit("https://example.com/p/"), n.cast("string")))),
            _member("unknown", F.lit("1"))))),
        _member("filler", F.col("filler")),
    )
    consent = F.when(r == 12, '{"analytics":"true","experimentation":false,'
                              '"personalization":true,"timestamp":"2024-01-01T00:00:00Z"}').when(
        r == 13, '{"analytics":true,"experimentation":false,"personalization":true}').when(
        n % 6 == 0, '{"analytics":true,"experimentation":false,"personalization":true,'
                    '"timestamp":"2024-01-01T00:00:00.000Z"}')
    properties = F.when(r == 14, '{"_hidden":1}').when(
        r == 15, '{"a":{"b":{"c":{"d":1}}}}').when(
        r == 16, "{" + _counted("k", 51) + "}").when(
        r == 17, '{"list":[' + ",".join(["1"] * 101) + "]}").when(
        r == 18, '{"text":"' + "s" * 2049 + '"}').when(
        n % 29 == 1, '{"a":{"b":{"c":1}}}').when(
        n % 29 == 2, "{" + _counted("k", 50) + "}").when(
        n % 29 == 3, '{"list":[' + ",".join(["1"] * 100) + "]}").when(
        n % 29 == 4, '{"text":"' + "s" * 2048 + '"}').otherwise(
        F.coalesce(F.col("properties"), F.lit("{}")))
    traits = F.when(r == 19, '{"Bad":1}').otherwise(F.coalesce(F.col("traits"), F.lit("{}")))
    return _object(
        _member("schemaVersion", broken(1, text('"2.0.0"'), text('"1.0.0"'))),
        _member("eventId", broken(2, text('"not-a-uuid"'), _quoted(F.col("event_id")))),
        _member("occurredAt", broken(3, text('"2024-01-01"'), _quoted(F.col("occurred_at_iso")))),
        _member("type", broken(4, text('"click"'), _quoted(kind))),
        _member("name", broken(6, F.lit(None).cast("string"),
                               broken(5, text('"Button Clicked"'), _quoted(name)))),
        _member("source", source),
        _member("actor", broken(10, text("{}"), actor)),
        _member("context", context),
        _member("consent", consent),
        _member("properties", F.when(~identify, properties)),
        _member("traits", F.when(identify, traits)),
        _member("extra", F.lit("true")),
    )


def batched(events: DataFrame, dirty: bool = False, copies: bool = False,
            large_context: bool = False) -> DataFrame:
    """Request bodies: one row per app and run of ``BATCH_SPAN`` source ids.

    ``copies`` sends some events twice inside their batch; ``large_context`` pads
    one event of some batches far beyond a small payload limit.
    """
    # Narrow rows are shuffled; the text is built, and the batches are formed, after it.
    view = canonical(events).withColumn("batch_key", batch_key()).withColumn("fault", fault())
    view = view.repartition("batch_key", "app_id", "w")
    padded = (F.col("w") % ENVELOPE_CYCLE == 15) & large_context
    view = view.withColumn(
        "filler", F.when(padded, _quoted(F.repeat(F.lit("f"), F.lit(3000)))))
    rows = view.select(
        "app_id", "w", "n", "received_at", "batch_key",
        event_json(dirty).alias("json"),
        F.explode(F.when((F.col("n") % 200 == 0) & copies, F.sequence(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return (
        rows.groupBy("batch_key", "app_id", "w")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "copy", "json"))).alias("items"),
            F.max("received_at").alias("received_at"),
        )
        .select(
            "batch_key", "app_id", "w", "received_at",
            md5_uuid(F.col("batch_key")).alias("batch_id"),
            md5_uuid(F.concat(F.lit("request:"), F.col("batch_key"))).alias("request_id"),
            F.size("items").alias("sent"),
            F.array_join(F.transform("items", lambda i: i["json"]), ",").alias("items"),
        )
        .withColumn("body", F.concat(
            F.lit('{"schemaVersion":"1.0.0","sentAt":"2024-02-01T00:00:00Z","events":['),
            F.col("items"), F.lit("]}")))
    )


def dirty_bodies(events: DataFrame) -> DataFrame:
    """Bodies with envelope-level faults by ``w % 23``; events themselves are clean."""
    base = batched(events, large_context=True)
    slot = F.col("w") % ENVELOPE_CYCLE
    many = F.array_join(F.array_repeat("items", 101), ",")
    start = '{"schemaVersion":"1.0.0","events":['
    return base.withColumn("body", F.when(
        slot == 5, F.concat(F.lit('{"schemaVersion":"1.0.0","sentAt":"yesterday","events":['),
                            F.col("items"), F.lit("]}"))).when(
        slot == 7, F.expr("substring(body, 1, length(body) div 2)")).when(
        slot == 9, "").when(
        slot == 11, start + "]}").when(
        slot == 13, F.concat(F.lit(start), many, F.lit("]}"))).otherwise(F.col("body")))


def redelivered(batches: DataFrame) -> DataFrame:
    """All batches, and those with ``w % 4 = 0`` once more an hour later.

    A batch is built once, whichever way it goes: only the row is doubled.
    """
    twice = F.when(F.col("w") % 4 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    again = F.col("__again")
    columns = {
        "batch_id": F.when(again, md5_uuid(F.concat(F.col("batch_key"), F.lit("-again")))).otherwise(F.col("batch_id")),
        "received_at": F.col("received_at") + F.when(again, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR")),
    }
    return batches.withColumn("__again", F.explode(twice)).withColumns(columns).drop("__again")
