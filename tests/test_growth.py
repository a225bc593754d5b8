"""What keeps the cost of a job in step with its input."""

import hashlib
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventloom import fixtures as X
from eventloom.functions.cursors import decode_cursor, encode_cursor
from eventloom.functions.scalars import md5_uuid
from eventloom.model import JSON_TIME, Limits
from eventloom.operators import dedup, rules
from eventloom.plans import many
from eventloom.session import materialise, scratch
from eventloom.sources import raw_store
from eventloom.streaming import jobs

BASE = datetime(2024, 1, 1)
REQUESTS = (
    "request_id string, app_id string, start timestamp_ntz, end timestamp_ntz, types array<string>,"
    " names array<string>, user_id string, anonymous_id string, session_id string, limit int, sort string")


def test_a_cursor_is_worked_out_once(spark):
    cursor = encode_cursor(F.concat(F.lit("a"), F.col("id")), F.lit("2024-01-01T00:00:00.000000Z#e"))
    out = spark.range(3).select(decode_cursor(cursor).alias("c"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") + plan.count("StructsToJsonEvaluator") == 1
    assert {(r.c.valid, r.c.app_id, r.c.event_id) for r in out.collect()} == {
        (True, f"a{i}", "e") for i in range(3)}


def test_requests_on_a_busy_app_meet_few_rows(spark, monkeypatch):
    """3,000 rows an hour are some pages, yet no request is paired with whole hours."""
    at = F.lit(BASE.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 1.2)
    rows = spark.range(12_000).select(
        F.lit("busy").alias("app_id"), F.concat(F.lit("e"), F.lpad(F.col("id"), 6, "0")).alias("event_id"),
        F.lit("track").alias("type"), F.lit("n.a").alias("name"), at.alias("occurred_at"),
        *[F.lit(None).cast("string").alias(c) for c in ("user_id", "anonymous_id", "session_id")])
    rows = materialise(rows.withColumn("occurred_at_iso", F.date_format(
        "occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), "busy")
    asked = spark.createDataFrame(
        [(str(i), "busy", BASE + timedelta(minutes=7 * i), BASE + timedelta(days=1), None, None, None, None, None,
          20, "asc" if i % 2 else "desc") for i in range(10)], REQUESTS)
    paired, meet = [], many._meet

    def counted(events, needed):
        out = materialise(meet(events, needed), "pairs")
        paired.append(out.count())
        return out

    monkeypatch.setattr(many, "_meet", counted)
    got = {}
    for r in many.query_many(rows, asked).orderBy("pos").collect():
        got.setdefault(r.request_id, []).append(r.event_id)
    assert sum(paired) <= 10 * 20 * 4
    for i in range(10):
        first = -(-7 * i * 60 * 10 // 12)
        want = range(first, first + 20) if i % 2 else range(11_999, 11_979, -1)
        assert got[str(i)] == [f"e{n:06d}" for n in want]


def _some_events(spark, count):
    return spark.range(count).select(
        F.col("id").alias("event_id"),
        (F.lit(BASE.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int")))
        .alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"))


def test_a_commit_of_pointers_is_few_files_and_leads_to_its_own_batches(spark):
    inbox, root = scratch(spark, "inbox"), scratch(spark, "stream")
    X.batched(_some_events(spark, 3000)).select(
        F.lit(None).cast("string").alias("request_header"), "body", "received_at") \
        .repartition(2, "received_at").write.options(**JSON_TIME).json(inbox)
    jobs.stream_ingest(spark, inbox, f"{root}/raw", f"{root}/pointers", f"{root}/rejects", f"{root}/ckpt",
                       max_files=1).awaitTermination()
    pointers = spark.read.option("recursiveFileLookup", "true").schema(
        "batch_id STRING, received_at TIMESTAMP_NTZ").options(**JSON_TIME).json(f"{root}/pointers")
    per_commit = pointers.groupBy(F.regexp_extract("_metadata.file_path", "commit_id=([^/]*)", 1).alias("c")) \
        .agg(F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("n")).collect()
    assert len(per_commit) == 2 and all(r.files == 1 for r in per_commit)
    one = pointers.where(F.col("_metadata.file_path").contains(f"commit_id={per_commit[0].c}"))
    found = jobs.raw_of(spark, one, f"{root}/raw")
    assert found.count() == per_commit[0].n
    assert raw_store.read_raw(spark, f"{root}/raw").count() == sum(r.n for r in per_commit)
    assert set(found.columns) == set(raw_store.read_raw(spark, f"{root}/raw").columns)


def test_redelivered_batches_are_built_once(spark):
    built = X.redelivered(X.batched(_some_events(spark, 2000)))
    assert built._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    rows = built.select("w", "batch_key", "batch_id", "received_at", "body").collect()
    keys = {r.batch_key for r in rows}
    assert len(rows) == len({r.batch_id for r in rows})
    assert len(rows) == len(keys) + len({r.batch_key for r in rows if r.w % 4 == 0})


def test_only_long_literals_are_unescaped():
    """Counting the units of a literal takes two regular expressions; bytes tell that most are short."""
    assert "octet_length(s) > 2048" in rules.event_issues(Limits())


def test_a_clean_event_is_told_without_lists_per_part():
    """The lists of issues are only put together where an event has one; its text is written once."""
    sql = rules.event_issues(Limits())
    fine = sql.index("CASE WHEN coalesce(")
    assert fine < sql.index("ELSE concat(array_compact(")
    assert "to_json(" not in sql


def test_places_are_asked_for_repeated_ids_only(spark, monkeypatch):
    """An id that occurs once and is new costs a count, neither a sort nor a place."""
    def rows(ids, batch):
        at = BASE + timedelta(days=ord(batch))
        return [(f"e{i}" if i is not None else None, batch, n, at) for n, i in enumerate(ids)]

    schema = "event_id string, batch_id string, event_index int, received_at timestamp_ntz"
    asked, look = [], dedup.copies_lookup

    def counted(events):
        asked.append(events.count())
        return look(events)

    monkeypatch.setattr(dedup, "copies_lookup", counted)
    store = spark.createDataFrame([("e1",)], "event_id string")
    single = spark.createDataFrame(rows([*range(50), None, None], "b"), schema)
    fate = {(r.event_id, r.event_index): r.fate for r in dedup.classify(single, store).collect()}
    assert not asked
    assert {k for k, v in fate.items() if v != "stored"} == {("e1", 1)} and len(fate) == 52
    again = single.unionByName(spark.createDataFrame(rows([3, 4, 4, 60, 60, 1], "c"), schema))
    fate = {(r.event_id, r.batch_id, r.event_index): r.fate for r in dedup.classify(again, store).collect()}
    assert asked == [9]
    assert {k: v for k, v in fate.items() if v != "stored"} == {
        ("e1", "b", 1): "duplicate", ("e1", "c", 5): "duplicate", ("e3", "c", 0): "duplicate",
        ("e4", "c", 1): "duplicate", ("e4", "c", 2): "duplicate", ("e60", "c", 4): "repeat"}


def test_ids_in_uuid_shape_without_a_pattern(spark):
    made = spark.range(20).select("id", md5_uuid(F.col("id").cast("string")).alias("u"))
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
    for r in made.collect():
        assert r.u == str(uuid.UUID(hashlib.md5(str(r.id).encode()).hexdigest()))
    assert spark.range(1).select(md5_uuid(F.lit(None).cast("string")).alias("u")).first().u is None
