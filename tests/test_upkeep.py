"""Versions of the store, merges, ids that prune and expire, and lookups by the table of files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.model import STORE_SCHEMA, EventQuery
from eventloom.operators import health, retention
from eventloom.plans import many, paging
from eventloom.session import materialise, scratch
from eventloom.sources import event_store, id_table, versions
from eventloom.streaming import jobs
from tests.test_store import BASE, answer, make_rows


@pytest.fixture(scope="module")
def rows():
    return make_rows(900, seed=11)


@pytest.fixture(scope="module")
def events(spark, rows):
    full = [{f: r.get(f) for f in STORE_SCHEMA.fieldNames()} for r in rows]
    return materialise(spark.createDataFrame(full, STORE_SCHEMA), "events")


def keys(df):
    return sorted((r.app_id, r.occurred_at, r.event_id, r.name) for r in df.select(
        "app_id", "occurred_at", "event_id", "name").collect())


def live(spark, path, kind=versions.EVENTS):
    return {r.file for r in versions.files(spark, path).where(F.col("live") & (F.col("kind") == kind)).collect()}


def scanned(df):
    """Rows that left the scans of files once the query has run."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


# ------------------------------------------------------------------ versions

def test_a_version_is_made_once(spark, events):
    path = scratch(spark, "v-race")
    event_store.append_events(events.limit(50), path, "one")
    base = versions.latest(spark, path)
    extra, _ = event_store._write(events.where("app_id = 'a1'"), path, "x")
    versions.switch(spark, path, base, [extra])
    seen = event_store.read_store(spark, path).count()
    with pytest.raises(versions.ConcurrentChange):
        versions.switch(spark, path, base, [extra])
    assert event_store.read_store(spark, path).count() == seen


def test_what_no_version_names_is_not_seen(spark, events):
    """A writer that died after its rows and before its version leaves nothing behind to read."""
    path = scratch(spark, "v-crash")
    event_store.append_events(events.where("dt = DATE'2024-01-01'"), path, "one")
    before = keys(event_store.read_store(spark, path))
    event_store._write(events, path, "two")
    event_store._ids_of(events, path, "two")
    assert keys(event_store.read_store(spark, path)) == before
    event_store.append_events(events, path, "two")
    assert keys(event_store.read_store(spark, path)) == keys(events)


def test_readers_keep_their_version(spark, events):
    path = scratch(spark, "v-reader")
    event_store.append_events(events, path, "one")
    reader = event_store.read_store(spark, path)
    changed = events.where("app_id = 'a1'").withColumn("name", F.lit("changed"))
    event_store.upsert_into(changed, path)
    versions.vacuum(spark, path)
    assert keys(reader) == keys(events)
    now = keys(event_store.read_store(spark, path))
    assert now == keys(events.where("app_id != 'a1'").unionByName(changed))
    versions.vacuum(spark, path, 0)
    assert keys(event_store.read_store(spark, path)) == now
    plain = spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(path)
    assert keys(plain) == now


def test_pieces_are_written_together(spark, events):
    path = scratch(spark, "v-pieces")
    parts = [materialise(events.where(F.pmod(F.crc32("event_id"), F.lit(4)) == i), "part") for i in range(4)]
    most, versions.MOST_PIECES = versions.MOST_PIECES, 2
    try:
        for i, part in enumerate(parts):
            event_store.append_events(part, path, str(i))
    finally:
        versions.MOST_PIECES = most
    assert len(versions.latest(spark, path).pieces) <= 2
    assert keys(event_store.read_store(spark, path)) == keys(events)


# ------------------------------------------------------------------ merges and upserts

def test_only_crowded_days_are_merged(spark, events):
    path = scratch(spark, "m-crowded")
    event_store.append_events(events.where("dt <= DATE'2024-01-02'"), path, "one")
    first = live(spark, path)
    event_store.append_events(events, path, "two")
    event_store.append_events(events.where("dt = DATE'2024-01-02'").withColumn(
        "event_id", F.concat(F.lit("more-"), "event_id")), path, "three")
    want = keys(event_store.read_store(spark, path))
    event_store.merge_files(spark, path, 2, None)
    after = live(spark, path)
    # Of the first commit only the second day lay in several files.
    assert {f for f in first if "dt=2024-01-01" in f} <= after
    assert not {f for f in first if "dt=2024-01-02" in f} & after
    assert keys(event_store.read_store(spark, path)) == want
    assert event_store.merge_files(spark, path, 2, None) == 0
    assert live(spark, path) == after


def test_merges_keep_every_version_of_the_key(spark, events):
    """Compact, store some events at a second time, add others, compact again."""
    path = scratch(spark, "m-versions")
    few = materialise(events.orderBy("event_id").limit(25), "few")
    event_store.append_events(few.limit(20), path, "one")
    event_store.compact_in_place(spark, path)
    moved = materialise(few.limit(5).withColumn(
        "occurred_at", F.col("occurred_at") + F.expr("INTERVAL 1 MINUTE")), "moved")
    event_store.upsert_into(moved, path)
    event_store.append_events(few, path, "two")
    want = keys(event_store.read_store(spark, path))
    assert len(want) == 30
    event_store.compact_in_place(spark, path)
    event_store.compact_in_place(spark, path)
    assert keys(event_store.read_store(spark, path)) == want


def test_upsert_rewrites_touched_files_only(spark, events):
    path = scratch(spark, "u-files")
    event_store.append_events(events, path, "one")
    before = live(spark, path)
    one = materialise(events.where("app_id = 'a1' AND dt = DATE'2024-01-02'").limit(1)
                      .withColumn("name", F.lit("new")), "one")
    event_store.upsert_into(one, path)
    gone = before - live(spark, path)
    assert len(gone) == 1 and "app_id=a1/dt=2024-01-02" in gone.pop()
    assert event_store.read_store(spark, path).count() == events.count()
    assert event_store.read_store(spark, path).where("name = 'new'").count() == 1


def test_upsert_leaves_versions_of_other_keys_alone(spark, events):
    """By (app, id): rows that share a file with a changed one stay, equal ids among them."""
    path = scratch(spark, "u-others")
    twice = materialise(events.where("app_id = 'a1'").unionByName(events.where("app_id = 'a1'").withColumn(
        "occurred_at", F.col("occurred_at") + F.expr("INTERVAL 1 SECOND"))), "twice")
    event_store.upsert_into(twice, path)
    ident = twice.orderBy("event_id").first().event_id
    change = materialise(events.where(F.col("event_id") == ident).withColumn("name", F.lit("new")), "change")
    event_store.upsert_into(change, path, ("app_id", "event_id"))
    want = keys(twice.where(F.col("event_id") != ident).unionByName(change))
    assert keys(event_store.read_store(spark, path)) == want


def test_null_app_and_day(spark, events):
    path = scratch(spark, "u-null")
    odd = materialise(events.limit(6).withColumns({
        "app_id": F.lit(None).cast("string"), "dt": F.lit(None).cast("date")}), "odd")
    event_store.append_events(odd.unionByName(events.where("app_id = 'a1'")), path, "one")
    event_store.upsert_into(odd.limit(2).withColumn("name", F.lit("new")), path, ("app_id", "event_id"))
    got = event_store.read_store(spark, path)
    assert got.where("app_id IS NULL").count() == 6
    assert got.where("name = 'new'").count() == 2


# ------------------------------------------------------------------ known ids

def test_few_ids_open_few_row_groups(spark):
    """500 ids against a million: new ones open next to nothing, a batch that comes again few groups."""
    root = scratch(spark, "ids-large")
    made = spark.range(1_000_000).select(
        F.md5(F.col("id").cast("string")).alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 20)).alias("seen"),
        F.lit("2024-01-01").cast("date").alias("dt"))
    id_table.add_ids(made, root, "event_id", "all")
    known = id_table.read_ids(spark, root, "event_id")
    new = spark.range(500).select(F.md5(F.concat(F.lit("new"), "id")).alias("event_id"))
    again = made.where("seen >= '2024-01-01 05:00:00' AND seen < '2024-01-01 05:00:25'").select("event_id")
    none = id_table.already_known(new, known, "event_id")
    assert sum(scanned(none)) <= 4 * id_table.GROUP_ROWS and none.count() == 0
    found = id_table.already_known(again, known, "event_id")
    assert sum(scanned(found)) <= 12 * id_table.GROUP_ROWS
    assert found.count() == 500


def test_many_ids_and_many_buckets(spark):
    """More buckets on one day than on another, and more ids than are named to a scan."""
    root = scratch(spark, "ids-buckets")
    ids = spark.range(5000).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit(BASE).cast("timestamp_ntz").alias("seen"),
        F.expr("IF(id < 4000, DATE'2024-01-01', DATE'2024-01-02')").alias("dt"))
    size, id_table.BUCKET_IDS = id_table.BUCKET_IDS, 1000
    try:
        id_table.add_ids(ids, root, "event_id", "a")
    finally:
        id_table.BUCKET_IDS = size
    known = id_table.read_ids(spark, root, "event_id")
    assert {(str(r.dt), r.buckets) for r in known.select("dt", "buckets").distinct().collect()} == {
        ("2024-01-01", 4), ("2024-01-02", 1)}
    for count in (3, 2500):
        asked = materialise(spark.range(count).select(F.concat(F.lit("e"), F.col("id") * 2).alias("event_id")), "asked")
        got = id_table.already_known(asked, known, "event_id")
        assert got.count() == min(count, 2500)
    assert id_table.already_known(spark.createDataFrame([(None,)], "event_id string"), known, "event_id").count() == 0


def test_ids_go_with_their_events(spark, events):
    path = scratch(spark, "ids-expiry")
    event_store.append_events(events, path, "one")
    now = BASE + timedelta(days=11, hours=6)
    retention.purge_store(spark, path, now, days=10)
    left = event_store.read_store(spark, path).count()
    assert 0 < left < events.count()
    assert event_store.known_events(spark, path).count() == left
    retention.purge_store(spark, path, now + timedelta(days=30), days=10)
    assert event_store.known_events(spark, path).count() == event_store.read_store(spark, path).count() == 0
    event_store.append_events(events, path, "two")
    assert keys(event_store.read_store(spark, path)) == keys(events)


# ------------------------------------------------------------------ reads

@pytest.mark.parametrize("sort", ["asc", "desc"])
def test_page_lookup_equals_the_ranked_page(spark, events, rows, sort):
    path = scratch(spark, "page-at")
    event_store.append_events(events.where(F.crc32("event_id") % 2 == 0), path, "one")
    event_store.append_events(events, path, "two")
    q = EventQuery("a0", BASE, BASE + timedelta(days=9), limit=200, sort=sort)
    ranked = answer(rows, q)
    size = 40
    for page in (0, 1, len(ranked) // size, len(ranked) // size + 1):
        got = paging.page_at(spark, path, "a0", page, size, sort)
        if page == 1:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
        assert [r.event_id for r in got.orderBy("pos").collect()] == ranked[page * size:(page + 1) * size]


def test_a_range_names_its_own_files(spark, events, rows):
    path = scratch(spark, "range")
    event_store.append_events(events, path, "one")
    q = EventQuery("a1", BASE + timedelta(hours=1), BASE + timedelta(hours=30), limit=100)
    narrow = event_store.read_range(spark, path, q.app_id, q.start, q.end)
    assert {f.split("app_id=")[1].split("/")[0] for f in narrow.inputFiles()} == {"a1"}
    assert len(narrow.inputFiles()) < len(live(spark, path))
    got = paging.query_page(narrow, q)
    assert [r.event_id for r in got.orderBy("pos").collect()] == answer(rows, q)[:100]


def test_rare_values_open_few_row_groups(spark):
    """No layout sorts by anonymous id: the filters beside the files tell which groups can hold it."""
    path = scratch(spark, "bloom")
    rows = spark.range(60_000).select(
        F.lit("a0").alias("app_id"), F.concat(F.lit("e"), "id").alias("event_id"),
        F.concat(F.lit("x"), F.expr("pmod(xxhash64(id), 30000)")).alias("anonymous_id"),
        F.lit(BASE).cast("timestamp_ntz").alias("occurred_at"), F.lit(BASE.date()).alias("dt"))
    rows = materialise(rows, "rows").repartition(24)
    lacking = [f for f in STORE_SCHEMA.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    folder = f"{path}/commit_id=a"
    rows.write.options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in event_store.SKIPPING}) \
        .partitionBy("app_id", "dt").parquet(folder)
    store = event_store.read_store(spark, path)
    one = store.where("anonymous_id = 'x77'").select("event_id")
    assert sum(scanned(one)) <= 60_000 / 4
    event_store.append_events(rows, scratch(spark, "bloom-append"), "a")


def test_two_ids_are_paired_with_their_own_rows(spark):
    """A user and a session with 20,000 rows each, that share 30 of them."""
    rng = random.Random(2)
    at = F.lit(BASE.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 0.1)
    busy = spark.range(40_000).select(
        F.lit("busy").alias("app_id"), F.concat(F.lit("e"), F.lpad(F.col("id"), 6, "0")).alias("event_id"),
        F.lit("track").alias("type"), F.lit("n.a").alias("name"), at.alias("occurred_at"),
        F.when(F.col("id") < 20_015, "u").alias("user_id"), F.lit(None).cast("string").alias("anonymous_id"),
        F.when(F.col("id") >= 19_985, "s").alias("session_id"))
    busy = materialise(busy.withColumn("occurred_at_iso", F.date_format(
        "occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), "busy")
    asked = spark.createDataFrame(
        [(str(i), "busy", BASE, BASE + timedelta(days=1), None, None, "u", None, "s", 10, rng.choice(["asc", "desc"]))
         for i in range(10)],
        "request_id string, app_id string, start timestamp_ntz, end timestamp_ntz, types array<string>,"
        " names array<string>, user_id string, anonymous_id string, session_id string, limit int, sort string")
    paired, meet = [], many._meet

    def counted(events, needed):
        out = materialise(meet(events, needed), "pairs")
        paired.append(out.count())
        return out

    many._meet = counted
    try:
        assert many.query_many(busy, asked).count() == 100
    finally:
        many._meet = meet
    assert sum(paired) <= 10 * 30


def test_alarm_state_stays_small(spark):
    """However many micro-batches have passed, one folder is carried on beside the newest."""
    source, root = scratch(spark, "a-src"), scratch(spark, "a-out")
    made = [(BASE + timedelta(minutes=m), 10) for m in range(0, 120)]
    df = spark.createDataFrame(made, "ts timestamp_ntz, errors long").orderBy("ts")
    df.repartitionByRange(12, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("ts TIMESTAMP_NTZ, errors BIGINT").parquet(source)
    alarm = health.Alarm("sum", 40, 3, 300)
    jobs.stream_alarm(stream, "ts", F.col("errors"), alarm, root, f"{root}/ckpt", "1 minute").awaitTermination()
    assert len(jobs._epochs(spark, f"{root}/windows")) > 4
    assert len(jobs._epochs(spark, f"{root}/carried")) <= 2
    got = spark.read.parquet(f"{root}/alarms").orderBy("window_start").collect()
    # Files come in any order, so late rows may be missing; runs of breaches are judged all the same.
    breaches = {r.window_start for r in got if r.stat > 40}
    back = [timedelta(seconds=300 * k) for k in range(3)]
    assert [r.alarm for r in got] == [all(r.window_start - b in breaches for b in back) for r in got]


def test_a_second_stream_does_not_replace_the_first(spark):
    assert jobs.commit_name(3, "/a/ckpt") != jobs.commit_name(3, "/b/ckpt")
    assert jobs.commit_name(2, "/a/ckpt") < jobs.commit_name(10, "/a/ckpt")
    assert datetime(2024, 1, 1) == BASE
