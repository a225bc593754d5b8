"""One callable per operator: ``(spark, sf_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import fixtures as X
from eventloom.functions.cursors import decode_cursor, encode_cursor, sort_key
from eventloom.functions.scalars import iso_text, md5_uuid
from eventloom.model import JSON_TIME, STORE_SCHEMA, EventQuery, Limits
from eventloom.operators import dedup, health, normalise, parsing, processing, retention, validation
from eventloom.plans import many, paging, requests
from eventloom.session import EVENT_CONF, materialise, prepare, scratch
from eventloom.sources import event_store, raw_store, versions
from eventloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = datetime(2024, 12, 31)
STORE_CUT = datetime(2024, 1, 16)
KNOWN_CUT = datetime(2024, 1, 4)
SMALL_PAYLOAD = Limits(max_payload=65_536)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark, EVENT_CONF), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def at(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.load(spark, sf_dir, "events")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.store_view(spark, sf_dir)


# ------------------------------------------------------------------ reads

PAGE = EventQuery("app1", datetime(2024, 1, 5), datetime(2024, 1, 26), types=("track",), limit=50)
FILTERED = ("event_id", "app_id", "type", "name", "user_id", "anonymous_id", "session_id",
            "occurred_at")


def page_columns(df: DataFrame) -> DataFrame:
    return df.select("pos", "event_id", "type", "name", "user_id", "session_id",
                     "occurred_at_iso", "has_more", "next_cursor")


@query
def query_page_desc(spark, sf_dir):
    return page_columns(paging.query_events(store(spark, sf_dir), PAGE))


@query
def query_page_asc(spark, sf_dir):
    q = EventQuery(**{**PAGE.__dict__, "sort": "asc"})
    return page_columns(paging.query_events(store(spark, sf_dir), q))


@query
def query_second_page(spark, sf_dir):
    view = store(spark, sf_dir)
    first = paging.query_events(view, PAGE)
    cursor = first.where("next_cursor IS NOT NULL").select("next_cursor").first()
    q = EventQuery(**{**PAGE.__dict__, "cursor": cursor.next_cursor if cursor else None})
    return page_columns(paging.query_events(view, q))


def filtered(**given) -> Query:
    q = EventQuery(**{"app_id": "app1", "start": datetime(2024, 1, 1),
                      "end": datetime(2024, 2, 1), **given})

    def run(spark, sf_dir):
        view = store(spark, sf_dir)
        return view.where(paging.predicate(view, q)).select(*FILTERED)

    return run


def _named(name: str, fn: Query) -> None:
    fn.__name__ = name
    query(fn)


_named("filter_app", filtered())
_named("filter_types", filtered(types=("page", "identify")))
_named("filter_names", filtered(names=("button.clicked", "app.error")))
_named("filter_user", filtered(user_id="user_7"))
_named("filter_anonymous", filtered(anonymous_id="anon_7"))
_named("filter_session", filtered(session_id="sess_7_20240105"))
_named("filter_all", filtered(types=("track",), names=("checkout.completed",),
                              user_id="user_7", start=datetime(2024, 1, 3)))


@query
def time_range_half_open(spark, sf_dir):
    view = store(spark, sf_dir)
    ts = F.col("occurred_at")
    bounds = view.agg(
        F.min(F.when(ts >= at(datetime(2024, 1, 8)), ts)).alias("start"),
        F.min(F.when(ts >= at(datetime(2024, 1, 20)), ts)).alias("end")).first()
    parts = []
    for app in ("app0", "app1", "app2"):
        q = EventQuery(app, bounds.start, bounds.end)
        parts.append(view.where(paging.predicate(view, q)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*FILTERED)


def raw_requests(spark, sf_dir) -> DataFrame:
    """One request per event, in the text form clients send; some fields are off."""
    n = F.col("n")
    start = F.col("occurred_at_iso")
    end = F.date_format(
        F.col("occurred_at") + F.make_dt_interval(days=(n % 33).cast("int")),
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    limit = F.get(
        F.array(*map(F.lit, ("0", "1", "200", "201", "abc", "25x", " 7"))), (n % 8).cast("int"))
    return store(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.when(n % 37 == 3, "").when(n % 37 != 5, F.col("app_id")).alias("app_id"),
        F.when(n % 41 == 4, "yesterday").when(n % 41 != 6, start).alias("from"),
        F.when(n % 7 != 2, end).alias("to"),
        F.get(F.array(*map(F.lit, ("track,\tpage\n", " ,\u2003", "track,click", "identify"))),
              (n % 9).cast("int")).alias("types"),
        F.get(F.array(*map(F.lit, ("page.viewed,, app.error", ","))), (n % 11).cast("int"))
        .alias("names"),
        F.when(n % 13 == 1, "").when(n % 13 < 4, F.col("user_id")).alias("user_id"),
        F.lit(None).cast("string").alias("anonymous_id"),
        F.lit(None).cast("string").alias("session_id"),
        limit.alias("limit"),
        F.when(n % 17 == 1, "***").when(n % 17 == 2, paging.next_cursor()).when(n % 17 == 3, "")
        .alias("cursor"),
        F.get(F.array(*map(F.lit, ("DESC", "Asc", "up"))), (n % 12).cast("int")).alias("sort"),
    )


@query
def query_many_ids(spark, sf_dir):
    """Requests that each name a user and a session, both as the table has them."""
    rows = store(spark, sf_dir)
    pairs = rows.where("user_id IS NOT NULL AND session_id IS NOT NULL").groupBy(
        "app_id", "user_id", "session_id").agg(F.min("occurred_at").alias("start"), F.max("occurred_at").alias("last"))
    requests = pairs.select(
        F.concat_ws("/", "app_id", "user_id", "session_id").alias("request_id"), "app_id", "start",
        (F.col("last") + F.expr("INTERVAL 1 SECOND")).alias("end"),
        F.lit(None).cast("array<string>").alias("types"), F.lit(None).cast("array<string>").alias("names"),
        "user_id", F.lit(None).cast("string").alias("anonymous_id"), "session_id",
        F.lit(2).alias("limit"), F.lit("desc").alias("sort"))
    return many.query_many(rows, requests).select("request_id", "pos", "event_id", "has_more")


@query
def validate_requests(spark, sf_dir):
    checked = requests.validate_requests(raw_requests(spark, sf_dir), at(datetime(2024, 1, 31)))
    return requests.request_issues(checked)


@query
def typed_requests(spark, sf_dir):
    checked = requests.validate_requests(raw_requests(spark, sf_dir), at(datetime(2024, 1, 31)))
    return requests.valid_requests(checked).select(
        "request_id", "app_id", "start", "end", F.array_join("types", "|").alias("types"),
        F.array_join("names", "|").alias("names"), "user_id", "limit", "sort")


def request_table(spark, sf_dir) -> DataFrame:
    """One request per app and user of the table, of four kinds."""
    u = F.col("user_no")
    kind = u % 4
    who = store(spark, sf_dir).select("app_id", "user_no").distinct()
    start = at(datetime(2024, 1, 2)) + F.make_dt_interval(
        days=(u % 7).cast("int"), hours=(u % 5).cast("int"))
    user = F.col("user_no").cast("string")
    return who.select(
        F.concat_ws("-", "app_id", user).alias("request_id"),
        "app_id",
        start.alias("start"),
        (start + F.make_dt_interval(days=(u % 20 + 1).cast("int"))).alias("end"),
        F.when(u % 8 == 3, F.array(F.lit("track"), F.lit("page"))).alias("types"),
        F.when(u % 8 == 7, F.array(F.lit("app.error"))).alias("names"),
        F.when(kind == 0, F.concat(F.lit("user_"), user)).alias("user_id"),
        F.when((kind == 1) | (u % 16 == 0), F.concat(F.lit("anon_"), (u % 50).cast("string")))
        .alias("anonymous_id"),
        F.when(kind == 2, F.concat(F.lit("sess_"), user, F.lit("_20240110"))).alias("session_id"),
        (u % 20 + 5).cast("int").alias("limit"),
        F.when(u % 3 == 0, "asc").otherwise("desc").alias("sort"),
        F.when(F.expr("user_no div 3 % 3 = 1"), encode_cursor(F.col("app_id"), sort_key(
            iso_text(start + F.make_dt_interval(days=(u % 9).cast("int"))), F.lit("8"))))
        .alias("cursor"),
    )


@query
def query_many(spark, sf_dir):
    pages = many.query_many(store(spark, sf_dir), request_table(spark, sf_dir))
    return pages.select("request_id", "pos", "event_id", "has_more", "next_cursor")


@query
def query_many_shuffled(spark, sf_dir):
    """The same answer when every busy hour is hot."""
    pages = many.query_many(
        store(spark, sf_dir), request_table(spark, sf_dir), hot_rows=2)
    return pages.select("request_id", "pos", "event_id", "has_more", "next_cursor")


@query
def page_walk(spark, sf_dir):
    walk = paging.page_walk(
        store(spark, sf_dir).select("app_id", "occurred_at", "event_id"), 50)
    return walk.select("app_id", "page", "pos", "event_id")


@query
def page_index(spark, sf_dir):
    rows = store(spark, sf_dir).select("app_id", "occurred_at", "occurred_at_iso", "event_id")
    return paging.page_index(paging.page_walk(rows, 50), 50)


@query
def with_cursor(spark, sf_dir):
    return store(spark, sf_dir).select("event_id", paging.next_cursor().alias("cursor"))


@query
def decode_cursors(spark, sf_dir):
    n = F.col("n")
    sk = sort_key(F.col("occurred_at_iso"), F.col("event_id"))
    good = encode_cursor(F.col("app_id"), sk)
    cursor = (
        F.when(n % 6 == 1, encode_cursor(F.concat(F.col("app_id"), F.lit("#user_1")), sk))
        .when(n % 6 == 2, "***")
        .when(n % 6 == 3, F.translate(F.base64(F.encode(F.lit('{"pk":1,"sk":"a"}'), "UTF-8")),
                                      "=", ""))
        .when(n % 6 == 4, encode_cursor(F.col("app_id"), F.concat(sk, F.lit("#x"))))
        .when(n % 6 == 5, encode_cursor(F.lit(""), sk))
        .otherwise(good)
    )
    return store(spark, sf_dir).select(
        F.col("n").alias("row_no"), decode_cursor(cursor).alias("c")
    ).select("row_no", "c.valid", "c.app_id", "c.occurred_at", "c.event_id")


# ------------------------------------------------------------------ shapes

@query
def api_projection(spark, sf_dir):
    return normalise.to_api(store(spark, sf_dir)).drop("context", "app_version", "actor_session_id")


@query
def to_stored(spark, sf_dir):
    view = store(spark, sf_dir).drop("processed_at", "dt")
    return normalise.to_stored(view, at(NOW)).select(
        "event_id", "occurred_at", "received_at", "processed_at",
        F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@query
def derive_keys(spark, sf_dir):
    return normalise.derive_keys(store(spark, sf_dir)).select(
        "pk", "sk", "gsi1pk", "gsi1sk", "gsi2pk", "gsi2sk", "occurred_at_ms", "expires_at", "name")


@query
def derive_day_keys(spark, sf_dir):
    return normalise.derive_day_keys(store(spark, sf_dir)).select(
        "day_pk", "day_sk", "user_day_pk", "anonymous_day_pk")


@query
def canonicalize_session(spark, sf_dir):
    n, session = F.col("n"), F.col("session_id")
    sent = store(spark, sf_dir).select(
        "event_id",
        F.when((n % 2 == 1) | (n % 10 == 0), session).alias("actor_session_id"),
        F.when(n % 14 == 1, "").when(n % 2 == 0, F.concat(session, F.lit("c")))
        .alias("context_session_id"))
    return normalise.canonicalize_session(sent).select(
        "event_id", "actor_session_id", "session_id")


@query
def expires_at(spark, sf_dir):
    return store(spark, sf_dir).select(
        "event_id", normalise.expires_at(F.col("occurred_at")).alias("expires_at"))


@query
def ttl_remaining(spark, sf_dir):
    return store(spark, sf_dir).select(
        "event_id",
        normalise.ttl_remaining(F.col("occurred_at"), at(NOW), 350).alias("ttl"))


def _private_documents(spark, sf_dir) -> DataFrame:
    """A nested document around every text of ``documents``."""
    text = F.col("text")
    return X.load(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(
        text.alias("note"),
        F.lit("x@example.com").alias("userEmail"),
        F.struct(
            F.lit("t").alias("API_KEY"), F.col("lang").alias("lang"),
            F.struct(F.col("source").alias("origin"), F.lit("s").alias("description"),
                     F.struct(F.lit(1).alias("sessionCount"), F.col("n_chars").alias("size"))
                     .alias("deep")).alias("inner"),
        ).alias("meta"),
        F.array(
            F.struct(F.lit("p").alias("Password"), text.alias("body")),
            F.struct(F.lit(None).cast("string").alias("Password"), F.col("lang").alias("body")),
        ).alias("list"),
    )).alias("doc"))


def _redacted_fields(df: DataFrame) -> DataFrame:
    def get(path: str) -> Column:
        return F.try_variant_get("value", path, "string")

    return df.withColumn("value", F.try_parse_json("doc")).select(
        "doc_id", F.md5(get("$.note")).alias("note_md5"), get("$.userEmail").alias("user_email"),
        get("$.meta.API_KEY").alias("api_key"), get("$.meta.lang").alias("lang"),
        get("$.meta.inner.origin").alias("origin"),
        get("$.meta.inner.description").alias("description"),
        get("$.meta.inner.deep.sessionCount").alias("session_count"),
        get("$.meta.inner.deep.size").cast("bigint").alias("size"),
        get("$.list[0].Password").alias("password"),
        F.md5(get("$.list[0].body")).alias("body_md5"), get("$.list[1].body").alias("second_body"))


@query
def redact_props(spark, sf_dir):
    return _redacted_fields(normalise.redact(_private_documents(spark, sf_dir), "doc"))


@query
def redact_any_depth(spark, sf_dir):
    """The same documents six objects further down, one name spelled by escapes."""
    doc = F.replace("doc", F.lit('"Password"'), F.lit(r'"P\u0061ssword"'))
    for level in range(6):
        doc = F.concat(F.lit(f'{{"l{level}":'), doc, F.lit("}"))
    wrapped = _private_documents(spark, sf_dir).withColumn("doc", doc)
    hidden = normalise.redact(wrapped, "doc")
    path = "$" + "".join(f".l{level}" for level in reversed(range(6)))
    return _redacted_fields(hidden.withColumn("doc", F.get_json_object("doc", path)))


# ------------------------------------------------------------------ parse and validate

def opened(bodies: DataFrame) -> DataFrame:
    return parsing.open_envelopes(parsing.parse_bodies(bodies))


@query
def parse_bodies(spark, sf_dir):
    return parsing.parse_bodies(X.dirty_bodies(events(spark, sf_dir))).select(
        "batch_id", "reject", F.col("envelope").isNotNull().alias("parsed"))


@query
def explode_events(spark, sf_dir):
    rows = parsing.explode_events(opened(X.batched(events(spark, sf_dir))).select(
        "batch_id", "events"))
    return rows.select(
        "batch_id", "event_index",
        F.try_variant_get("event", "$.eventId", "string").alias("event_id"),
        F.try_variant_get("event", "$.type", "string").alias("type"))


@query
def batch_summary(spark, sf_dir):
    checked = validation.validate_batches(
        opened(X.batched(events(spark, sf_dir), dirty=True)), body="body")
    summary = parsing.batch_summary(checked.withColumn("accepted", F.size("issues") == 0))
    return summary.select("batch_id", "event_count", "accepted",
                          F.array_join("event_ids", ",").alias("event_ids"))


@query
def stamp_batches(spark, sf_dir):
    n = F.expr("CAST(event_id AS BIGINT)")
    header = (
        F.when(n % 4 == 0, F.upper(md5_uuid(F.concat(F.lit("h"), n.cast("string")))))
        .when(n % 4 == 1, F.concat(F.lit("\u00a0\t "), md5_uuid(n.cast("string")), F.lit(" \r\n")))
        .when(n % 4 == 2, "not-a-uuid")
    )
    sent = events(spark, sf_dir).select(
        F.col("event_id").alias("row_no"), header.alias("request_header"))
    return parsing.stamp_batches(
        sent, now=at(NOW), content_key=F.col("row_no").cast("string")
    ).select("row_no", "batch_id", "request_id", "received_at")


@query
def strip_unknown(spark, sf_dir):
    checked = validation.validate_batches(opened(X.batched(events(spark, sf_dir))), body="body")
    typed = validation.accepted_events(checked)
    page = F.try_parse_json("context")
    return typed.select(
        "batch_id", "event_index", "event_id", "app_id", "type", "name", "occurred_at",
        "platform", "env", "user_id", "anonymous_id", "session_id", "actor_session_id",
        F.length("app_version").alias("app_version_length"),
        F.try_variant_get(page, "$.sessionId", "string").alias("context_session_id"),
        F.try_variant_get(page, "$.page.url", "string").alias("page_url"),
        F.try_variant_get(page, "$.page.unknown", "string").alias("page_unknown"),
        F.col("consent.analytics").alias("consent_analytics"),
        F.get_json_object("properties", "$.k").cast("int").alias("k"),
        F.get_json_object("traits", "$.plan").alias("plan"))


def dirty_checked(spark, sf_dir) -> DataFrame:
    bodies = X.batched(events(spark, sf_dir), dirty=True)
    return validation.validate_batches(opened(bodies), body="body")


@query
def validation_issues(spark, sf_dir):
    return validation.validation_issues(dirty_checked(spark, sf_dir)).drop("issue_index")


@query
def envelope_issues(spark, sf_dir):
    bodies = parsing.parse_bodies(X.dirty_bodies(events(spark, sf_dir))).where("reject IS NULL")
    checked = validation.validate_batches(
        parsing.open_envelopes(bodies), SMALL_PAYLOAD, body="body")
    return validation.validation_issues(checked).drop("issue_index")


@query
def gate_batches(spark, sf_dir):
    return validation.gate_batches(dirty_checked(spark, sf_dir))


@query
def sanitize_messages(spark, sf_dir):
    messages = X.load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    return validation.sanitize_messages(messages).select(
        "doc_id", F.md5("message").alias("message_md5"))


# ------------------------------------------------------------------ raw batches

def raw_table(spark, sf_dir, dirty: bool = False, copies: bool = False) -> DataFrame:
    """Raw batches with redeliveries; every 23rd slot of batches is lost."""
    batches = X.redelivered(X.batched(events(spark, sf_dir), dirty=dirty, copies=copies))
    return raw_store.to_raw_batches(opened(batches))


def all_pointers(spark, sf_dir, **kind) -> DataFrame:
    return raw_store.make_pointers(raw_table(spark, sf_dir, **kind))


def surviving(raw: DataFrame, spark, sf_dir) -> DataFrame:
    """Raw batches without those whose slot is lost."""
    keys = X.redelivered(
        X.batched(events(spark, sf_dir)).select("batch_id", "batch_key", "w", "received_at"))
    lost = keys.where(F.col("w") % X.ENVELOPE_CYCLE == 17).select("batch_id")
    return raw.join(lost, "batch_id", "left_anti")


@query
def raw_key(spark, sf_dir):
    return raw_table(spark, sf_dir).select(
        "batch_id", "request_id", "event_count", "app_id", "year", "month", "day",
        "storage_location")


@query
def make_pointers(spark, sf_dir):
    return all_pointers(spark, sf_dir)


@query
def write_raw_batches(spark, sf_dir):
    """Written twice; every batch is there once."""
    path = scratch(spark, "raw")
    raw = materialise(raw_table(spark, sf_dir), "raw-input")
    raw_store.write_raw_batches(raw.where("day < '16'"), path)
    raw_store.write_raw_batches(raw, path)
    return raw_store.read_raw(spark, path).select(
        "batch_id", "request_id", "received_at", "event_count", "app_id", "storage_location")


@query
def raw_partitions_hive(spark, sf_dir):
    path = scratch(spark, "hive")
    raw_store.write_raw_hive(raw_table(spark, sf_dir), path)
    back = spark.read.schema(
        "batch_id STRING, event_index INT, event VARIANT, app_id STRING, env STRING, dt STRING,"
        " hour STRING").json(path)
    return back.select(
        "batch_id", "event_index", F.try_variant_get("event", "$.eventId", "string")
        .alias("event_id"), "app_id", "env", "dt", "hour")


@query
def decode_pointers(spark, sf_dir):
    sent = all_pointers(spark, sf_dir)
    plain = raw_store.encode_pointers(sent).withColumn("form", F.lit("plain"))
    coded = raw_store.encode_pointers(sent, base64=True).withColumn("form", F.lit("base64"))
    torn = plain.withColumns({
        "message": F.expr("substring(message, 1, length(message) div 2)"),
        "form": F.lit("torn")})
    return raw_store.decode_pointers(plain.unionByName(coded).unionByName(torn)).select(
        "form", "batch_id", "request_id", "received_at", "storage_location", "reject")


@query
def resolve_pointers(spark, sf_dir):
    raw = materialise(raw_table(spark, sf_dir), "raw")
    resolved = raw_store.resolve_pointers(
        raw_store.make_pointers(raw), surviving(raw, spark, sf_dir))
    return resolved.select(
        "batch_id", "request_id",
        F.size(F.try_variant_get(F.try_parse_json("body"), "$.events", "array<variant>"))
        .alias("events"), "error")


@query
def replay_raw(spark, sf_dir):
    path = scratch(spark, "raw")
    raw_store.write_raw_batches(raw_table(spark, sf_dir), path)
    return raw_store.replay_raw(
        raw_store.read_raw(spark, path), date(2024, 1, 5), date(2024, 1, 21))


# ------------------------------------------------------------------ idempotency and processing

def early(spark, sf_dir, cut: datetime = STORE_CUT) -> DataFrame:
    view = store(spark, sf_dir)
    return view.where(F.col("occurred_at") < at(cut))


@query
def events_exist(spark, sf_dir):
    ids = store(spark, sf_dir).select("event_id")
    return dedup.events_exist(ids, early(spark, sf_dir))


def delivered(spark, sf_dir) -> DataFrame:
    """Every event with its batch; batches in slots ``w % 4 = 0`` arrive twice, and
    some events stand twice inside their batch."""
    view = store(spark, sf_dir).withColumn("batch_key", X.batch_key())
    rows = view.select(
        "*", F.explode(F.when(F.col("n") % 200 == 0, F.array(F.lit(0), F.lit(1)))
                       .otherwise(F.array(F.lit(0)))).alias("copy")
    ).withColumns({
        "batch_id": md5_uuid(F.col("batch_key")),
        "event_index": (F.col("n") * 2 + F.col("copy")).cast("int"),
    })
    again = rows.where(F.col("w") % 4 == 0).withColumns({
        "batch_id": md5_uuid(F.concat(F.col("batch_key"), F.lit("-again"))),
        "received_at": F.col("received_at") + F.make_dt_interval(hours=F.lit(1)),
        "value": F.col("value") + 1,
    })
    return rows.unionByName(again)


@query
def split_duplicates(spark, sf_dir):
    new, skipped = dedup.split_duplicates(delivered(spark, sf_dir), early(spark, sf_dir))
    fresh = new.select("batch_id", "event_index", "event_id",
                       F.lit(None).cast("string").alias("reason"))
    return fresh.unionByName(skipped)


@query
def dedup_within(spark, sf_dir):
    return dedup.dedup_within(delivered(spark, sf_dir)).select(
        "event_id", "batch_id", "event_index", "value")


STORED = ("event_id", "app_id", "occurred_at", "received_at", "value")


def in_store_form(rows: DataFrame) -> DataFrame:
    """Rows with the columns of the store that the generated events lack."""
    lacking = [f for f in STORE_SCHEMA.fields if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})


@query
def append_events(spark, sf_dir):
    """First write wins: two commits on disk, the second one repeated."""
    path = scratch(spark, "store")
    both = in_store_form(delivered(spark, sf_dir))
    event_store.append_events(both.where(F.col("occurred_at") < at(STORE_CUT)), path, "a")
    event_store.append_events(both, path, "b")
    event_store.append_events(both, path, "b")
    return event_store.read_store(spark, path).select(
        "event_id", "app_id", "occurred_at", "received_at",
        F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@query
def upsert_events(spark, sf_dir):
    old = early(spark, sf_dir).select(*STORED)
    changes = delivered(spark, sf_dir).where("w % 4 = 0").select(*STORED).distinct()
    return dedup.upsert_events(old, changes)


@query
def upsert_stats(spark, sf_dir):
    return dedup.upsert_stats(early(spark, sf_dir), delivered(spark, sf_dir))


def processed(spark, sf_dir) -> processing.Processed:
    raw = materialise(raw_table(spark, sf_dir, dirty=True, copies=True), "raw")
    return processing.process_batches(
        raw_store.make_pointers(raw), surviving(raw, spark, sf_dir),
        early(spark, sf_dir, KNOWN_CUT), now=at(NOW))


@query
def process_batches(spark, sf_dir):
    return processed(spark, sf_dir).stored.select(
        "event_id", "app_id", "type", "name", "occurred_at", "user_id", "session_id",
        "batch_id", "received_at", "processed_at")


@query
def batch_report(spark, sf_dir):
    return processed(spark, sf_dir).report


@query
def batch_errors(spark, sf_dir):
    return processed(spark, sf_dir).errors


@query
def dead_letters(spark, sf_dir):
    return processed(spark, sf_dir).dead_letters.select(
        "batch_id", "request_id", "received_at", "event_count", "reason")


@query
def write_failures(spark, sf_dir):
    """Reports when the store refuses the batches of one app."""
    raw = materialise(raw_table(spark, sf_dir), "raw")
    refused = raw.where("app_id = 'app2'").select("batch_id", F.lit("refused").alias("error"))
    done = processing.process_batches(
        raw_store.make_pointers(raw), raw, early(spark, sf_dir, KNOWN_CUT), now=at(NOW),
        write_errors=refused)
    return done.report


@query
def redrive(spark, sf_dir):
    """One delivery per event of a batch key; an error event is a failed one."""
    attempts = events(spark, sf_dir).select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
        .alias("batch_id"),
        (F.col("event_type") == "purchase").alias("success"))
    return processing.redrive(attempts)


# ------------------------------------------------------------------ layouts and retention

def layout_input(spark, sf_dir) -> DataFrame:
    return store(spark, sf_dir).drop("value", "k", "user_no", "w", "n")


@query
def build_layouts(spark, sf_dir):
    """Rows, and an order-free checksum, of each copy on disk."""
    path = scratch(spark, "layouts")
    view = layout_input(spark, sf_dir)
    event_store.build_layouts(view, path, 8)
    parts = []
    for layout in ("app", "user", "session"):
        rows = event_store.open_layout(spark, path, layout, view.schema)
        parts.append(rows.groupBy("app_id").agg(
            F.count("*").alias("events"),
            F.sum(F.unix_micros(F.col("occurred_at").cast("timestamp")) % 1_000_003)
            .alias("checksum"),
            F.countDistinct("user_id").alias("users"),
            F.countDistinct("session_id").alias("sessions"),
        ).select(F.lit(layout).alias("layout"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def layout_pages(spark, sf_dir):
    """The same request through the path that suits it."""
    path = scratch(spark, "layouts")
    view = layout_input(spark, sf_dir)
    event_store.build_layouts(view, path, 8)
    out = None
    asked = (("app", {}), ("user", {"user_id": "user_7"}),
             ("session", {"session_id": "sess_7_20240105"}))
    for label, given in asked:
        q = EventQuery("app1", datetime(2024, 1, 2), datetime(2024, 1, 30), limit=20, **given)
        page = paging.query_page(event_store.layout_for(spark, path, q, view.schema), q)
        rows = page.select(F.lit(label).alias("layout"), "pos", "event_id", "has_more")
        out = rows if out is None else out.unionByName(rows)
    return out


# App ids as clients may choose them: with what means something in a path, or to Spark's folders.
ODD_APPS = ("app1", "shop:eu", "z/../app_id=app1", "a/b", "50%")


def odd_store(spark, sf_dir) -> DataFrame:
    """The stored events, dealt to apps with awkward names."""
    app = F.get(F.array(*map(F.lit, ODD_APPS)), (F.col("user_no") % len(ODD_APPS)).cast("int"))
    return store(spark, sf_dir).withColumn("app_id", app)


@query
def upsert_store(spark, sf_dir):
    """A store on disk before and after events of some apps and batches move to another day."""
    path = scratch(spark, "upsert")
    view = odd_store(spark, sf_dir)
    columns = layout_input(spark, sf_dir).columns
    moved = view.where("user_no % 5 = 2 OR w % 4 = 0")
    late = F.col("occurred_at") + F.make_dt_interval(days=F.lit(40))
    moved = moved.withColumns({"occurred_at": late, "dt": F.to_date(late)})
    event_store.upsert_into(in_store_form(view.select(*columns)), path, ("app_id", "event_id"))
    event_store.upsert_into(in_store_form(moved.select(*columns)), path, ("app_id", "event_id"))
    return event_store.read_store(spark, path).select(
        "app_id", "event_id", "occurred_at", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@query
def stream_compact_upsert(spark, sf_dir):
    """A streamed store is compacted where it lies, goes on streaming, and takes an upsert."""
    root = _run_ingest(spark, sf_dir, dirty=False)
    events_path = f"{root}/out/events"
    _run_process(spark, root)
    event_store.compact_in_place(spark, events_path)
    # A new checkpoint delivers every pointer again: all of it is known by now.
    jobs.stream_process(
        spark, f"{root}/pointers", f"{root}/raw", f"{root}/out", f"{root}/ckpt-again",
        now=at(NOW), max_files=4).awaitTermination()
    event_store.compact_in_place(spark, events_path)
    rows = event_store.read_store(spark, events_path)
    changes = materialise(rows.where("app_id = 'app1'").withColumn("name", F.lit("changed")), "changes")
    event_store.upsert_into(changes, events_path)
    return event_store.read_store(spark, events_path).select(
        "event_id", "app_id", "name", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


def _two_commits(spark, sf_dir) -> str:
    """A store of two commits, the second one delivered twice."""
    path = scratch(spark, "store")
    rows = in_store_form(layout_input(spark, sf_dir))
    event_store.append_events(rows.where(F.col("occurred_at") < at(STORE_CUT)), path, "a")
    event_store.append_events(rows, path, "b")
    event_store.append_events(rows, path, "b")
    return path


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("app_id", "event_id", "occurred_at", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@query
def compact_store(spark, sf_dir):
    """Merged, then app1's page events a second time at another hour, then merged again: the store
    keeps every version of its key."""
    path = _two_commits(spark, sf_dir)
    event_store.compact_in_place(spark, path)
    later = F.col("occurred_at") + F.expr("INTERVAL 1 HOUR")
    moved = event_store.read_store(spark, path).where("app_id = 'app1' AND type = 'page'").withColumns(
        {"occurred_at": later, "dt": F.to_date(later)})
    event_store.upsert_into(materialise(moved, "moved"), path)
    event_store.merge_files(spark, path, 2, None)
    event_store.compact_in_place(spark, path)
    return _kept(event_store.read_store(spark, path))


@query
def purge_then_append(spark, sf_dir):
    """What has expired can be stored again; what has not is known."""
    path = _two_commits(spark, sf_dir)
    retention.purge_store(spark, path, datetime(2024, 12, 31, 7, 30), 340)
    rows = in_store_form(layout_input(spark, sf_dir)).withColumn("name", F.lit("again"))
    event_store.append_events(rows, path, "c")
    return event_store.read_store(spark, path).select(
        "event_id", "name", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@query
def store_version(spark, sf_dir):
    """A reader of the version before an upsert still sees the rows of that version."""
    path = _two_commits(spark, sf_dir)
    before = versions.latest(spark, path)
    changes = event_store.read_store(spark, path).where("app_id = 'app1'").withColumn("name", F.lit("changed"))
    event_store.upsert_into(materialise(changes, "changes"), path)
    versions.vacuum(spark, path)
    rows = event_store.read_store(spark, path).withColumn("reader", F.lit("new")).unionByName(
        event_store.read_store(spark, path, version=before).withColumn("reader", F.lit("old")))
    return rows.select("reader", "event_id", "name")


@query
def page_lookup(spark, sf_dir):
    """Pages 0 and 3 of every app, each found by the counts of the store's files."""
    path = _two_commits(spark, sf_dir)
    out = None
    for app in sorted(r.app_id for r in versions.files(spark, path).where(
            "live AND kind = 'events'").select("app_id").distinct().collect()):
        for page in (0, 3):
            rows = paging.page_at(spark, path, app, page, 25)
            rows = rows.select("app_id", "page", "pos", "event_id")
            out = rows if out is None else out.unionByName(rows)
    return out


@query
def purge_expired(spark, sf_dir):
    return retention.purge_expired(store(spark, sf_dir), NOW, 340).select(
        "event_id", "occurred_at")


@query
def purge_actions(spark, sf_dir):
    return retention.purge_actions(store(spark, sf_dir), NOW, 340).withColumn(
        "dt", F.date_format("dt", "yyyy-MM-dd"))


@query
def purge_store(spark, sf_dir):
    path = scratch(spark, "purge")
    view = odd_store(spark, sf_dir).select(*layout_input(spark, sf_dir).columns)
    folder = f"{path}/commit_id=a"
    view.hint("rebalance", "app_id", "dt").write.partitionBy("app_id", "dt").parquet(folder)
    retention.purge_store(spark, path, datetime(2024, 12, 31, 7, 30), 340)
    return spark.read.schema(view.schema).option("basePath", path).parquet(path).select(
        "event_id", "occurred_at")


def _tiers(spark, sf_dir, tiers: retention.Tiers, now: datetime) -> DataFrame:
    batches = X.batched(events(spark, sf_dir)).select(
        "batch_id", "received_at", F.col("sent").alias("event_count"))
    return retention.raw_tiers(batches, at(now), tiers)


@query
def raw_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir, retention.INFREQUENT_TIERS, datetime(2024, 4, 14))


@query
def raw_tiers_cool(spark, sf_dir):
    return _tiers(spark, sf_dir, retention.COOL_TIERS, datetime(2024, 4, 14))


# ------------------------------------------------------------------ health

@query
def alarm_errors(spark, sf_dir):
    """Rejected batches per six hours, from the processor's own report."""
    gate = validation.gate_batches(dirty_checked(spark, sf_dir))
    times = X.batched(events(spark, sf_dir)).select("batch_id", "received_at")
    report = gate.join(times, "batch_id").withColumn(
        "outcome", F.when(F.col("accepted"), "processed").otherwise("rejected"))
    return health.error_alarm(report, "received_at", health.Alarm("sum", 1, 2, 21_600))


@query
def alarm_status(spark, sf_dir):
    status = (F.when(F.col("event_type") == "error", 500)
              .when(F.col("event_type") == "signup", 429).otherwise(200))
    outcomes = events(spark, sf_dir).select("ts", status.alias("status"))
    return health.status_alarms(
        outcomes, "ts", "status", health.Alarm("sum", 3, 2, 3600),
        health.Alarm("sum", 4, 2, 3600))


@query
def alarm_latency(spark, sf_dir):
    return health.latency_alarm(store(spark, sf_dir), health.Alarm("avg", 950, 3, 3600), "app_id")


def _arrivals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every event as a pointer; pages are never done, others after their delay."""
    view = store(spark, sf_dir)
    pointers = view.select(F.col("event_id").alias("batch_id"), "received_at")
    done = view.where("type <> 'page'").select(
        F.col("event_id").alias("batch_id"),
        (F.col("received_at") + F.make_dt_interval(mins=(F.col("n") % 90).cast("int")))
        .alias("processed_at"))
    return pointers, done


@query
def backlog_age(spark, sf_dir):
    pointers, done = _arrivals(spark, sf_dir)
    return health.backlog_age(
        pointers, done, at(datetime(2024, 2, 1)), health.Alarm("max", 600, 2, 3600))


@query
def dlq_depth(spark, sf_dir):
    letters = processed(spark, sf_dir).dead_letters
    return health.dead_letter_alarm(letters, alarm=health.Alarm("sum", 0, 1, 3600))


# ------------------------------------------------------------------ streams

def _write_bodies(spark, sf_dir, dirty: bool) -> str:
    path = scratch(spark, "inbox")
    bodies = X.redelivered(X.batched(events(spark, sf_dir), dirty=dirty, copies=True))
    # Files of a fair size: a stream takes so many at a time, whatever is in them.
    bodies.select(F.lit(None).cast("string").alias("request_header"), "body", "received_at") \
        .hint("rebalance").write.options(**JSON_TIME).json(path)
    return path


def _run_ingest(spark, sf_dir, dirty: bool) -> str:
    root = scratch(spark, "stream")
    jobs.stream_ingest(
        spark, _write_bodies(spark, sf_dir, dirty), f"{root}/raw", f"{root}/pointers",
        f"{root}/rejects", f"{root}/ckpt-ingest", max_files=4).awaitTermination()
    return root


def _run_process(spark, root: str) -> str:
    jobs.stream_process(
        spark, f"{root}/pointers", f"{root}/raw", f"{root}/out", f"{root}/ckpt-process",
        now=at(NOW), max_files=4).awaitTermination()
    return f"{root}/out"


@query
def stream_ingest(spark, sf_dir):
    """Accepted batches: time, app and size, as found in the raw table."""
    root = _run_ingest(spark, sf_dir, dirty=True)
    raw = raw_store.read_raw(spark, f"{root}/raw").select(
        "batch_id", "received_at", "app_id", "event_count")
    pointers = spark.read.option("recursiveFileLookup", "true").schema(
        "batch_id STRING").json(f"{root}/pointers")
    return raw.join(pointers, "batch_id").select("received_at", "app_id", "event_count")


@query
def stream_rejects(spark, sf_dir):
    root = _run_ingest(spark, sf_dir, dirty=True)
    return spark.read.schema(jobs.REJECT_SCHEMA).parquet(f"{root}/rejects").select(
        "received_at", "reason")


@query
def stream_process(spark, sf_dir):
    """Redelivered batches and repeats inside a batch leave one row per event."""
    out = _run_process(spark, _run_ingest(spark, sf_dir, dirty=False))
    return event_store.read_store(spark, f"{out}/events").select(
        "event_id", "app_id", "type", "name", "occurred_at", "user_id", "session_id",
        F.date_format("dt", "yyyy-MM-dd").alias("dt"))


def _poison_root(spark, sf_dir) -> str:
    """Raw batches and pointers that no ingest has checked."""
    root = scratch(spark, "stream")
    raw = raw_table(spark, sf_dir, dirty=True, copies=True)
    raw_store.write_raw_batches(raw, f"{root}/raw")
    pointers = raw_store.make_pointers(raw_store.read_raw(spark, f"{root}/raw"))
    pointers.repartition(8, "batch_id").write.options(**JSON_TIME).json(f"{root}/pointers")
    return root


@query
def stream_dead_letters(spark, sf_dir):
    out = _run_process(spark, _poison_root(spark, sf_dir))
    return spark.read.parquet(f"{out}/dead_letters").select(
        "batch_id", "received_at", "event_count", "reason")


@query
def stream_dedup_watermark(spark, sf_dir):
    """Copies and first copies come in any order, hours behind the newest."""
    source, root = scratch(spark, "copies"), scratch(spark, "stream")
    rows = delivered(spark, sf_dir).select("event_id", "app_id", "received_at")
    rows.repartition(4, F.xxhash64("event_id", "received_at")).write.parquet(source)
    stream = spark.readStream.option("maxFilesPerTrigger", 2).schema("event_id STRING, app_id STRING, received_at TIMESTAMP_NTZ") \
        .parquet(source)
    jobs.stream_dedup(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return spark.read.schema("event_id STRING, app_id STRING").parquet(f"{root}/out").select(
        "event_id", "app_id")


@query
def stream_alarm(spark, sf_dir):
    """Errors per hour over closed hours, judged as they close."""
    source, root = scratch(spark, "arrivals"), scratch(spark, "stream")
    events(spark, sf_dir).select("ts", (F.col("event_type") == "error").cast("bigint")
                                 .alias("errors")) \
        .repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema("ts TIMESTAMP_NTZ, errors BIGINT").parquet(source)
    jobs.stream_alarm(
        stream, "ts", F.col("errors"), health.Alarm("sum", 3, 2, 3600), root, f"{root}/ckpt",
        "1 hour").awaitTermination()
    return spark.read.schema(
        "window_start TIMESTAMP_NTZ, stat BIGINT, breach BOOLEAN, alarm BOOLEAN"
    ).parquet(f"{root}/alarms").select("window_start", "stat", "breach", "alarm")
