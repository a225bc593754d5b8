"""A table of requests answered together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.cursors import decode_cursor
from eventloom.plans.paging import next_cursor
from eventloom.session import materialise

# A request goes by all the ids it names together: there are eight such paths, that of the app alone too.
IDS = ("session_id", "user_id", "anonymous_id")
APP = "app"
DAY, HOUR, MINUTE, SECOND = 86_400, 3600, 60, 1
#: Hours with more rows than this, a few pages, are narrowed to seconds.
HOT_ROWS = 500

REQUEST_COLUMNS = (
    "request_id", "app_id", "start", "end", "types", "names", "user_id", "anonymous_id",
    "session_id", "limit", "sort", "cursor",
)
MEETING = ("app_id", "path", "key", "bucket")


def query_many(store: DataFrame, requests: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pages of all requests: matching rows with ``request_id``, ``pos``,
    ``has_more`` and ``next_cursor``.

    A request may carry a ``cursor`` and then goes on behind it; one that cannot be read
    gives no rows, as ``validate_requests`` reports it.

    Requests meet events on app, the ids they name and the hour.  A request that names several
    ids goes by all of them as one key, so the counts are of rows that match them all, however
    many rows each id has.  Row counts per day, then per hour of the days in question, tell which
    hours a request needs to fill its page; an hour with more rows than a few pages is narrowed to
    minutes and seconds the same way.  So a request is compared with some dozens of counts a step
    and paired with a few pages of rows, unless a single second holds more.
    """
    wanted = materialise(_with_path(requests).distinct(), "requests")
    facts = wanted.agg(
        F.collect_set("r_path").alias("paths"), F.max("r_limit").alias("limit"),
        F.min("r_start").alias("start"), F.max("r_end").alias("end")).first()
    events = _by_path(store, sorted(facts.paths) or [APP], facts.start, facts.end)

    keys = _renamed(wanted).select("app_id", "path", "key").distinct()
    sizes = _sizes(_bucketed(events, HOUR).join(keys, ["app_id", "path", "key"], "left_semi"), "sizes")
    days = _needed(_coarser(sizes, HOUR, DAY), wanted, DAY).drop("rows")
    needed = materialise(_needed(sizes, materialise(days, "days"), HOUR, DAY), "hours")
    calm, hot = needed.where(F.col("rows") <= hot_rows), needed.where(F.col("rows") > hot_rows)
    pairs = _meet(_bucketed(events, HOUR), calm)
    if not hot.isEmpty():
        in_hot_hours = _bucketed(events, HOUR).join(
            materialise(_renamed(hot).select(*MEETING).distinct(), "hot"),
            list(MEETING), "left_semi")
        fine = _sizes(_bucketed(in_hot_hours, SECOND), "fine-sizes")
        minutes = _needed(_coarser(fine, SECOND, MINUTE), hot.drop("rows"), MINUTE, HOUR).drop("rows")
        seconds = _needed(fine, materialise(minutes, "minutes"), SECOND, MINUTE)
        pairs = pairs.unionByName(_meet(_bucketed(events, SECOND), materialise(seconds, "seconds")))
    return _pages(pairs, facts.limit or 0)


def _with_path(requests: DataFrame) -> DataFrame:
    named = F.concat_ws("+", *[F.when(F.col(name).isNotNull(), name) for name in IDS])
    path = F.when(named == "", APP).otherwise(named)
    key = F.concat(*[F.coalesce(_key_part(name), F.lit("")) for name in IDS])
    if "cursor" not in requests.columns:
        requests = requests.withColumn("cursor", F.lit(None).cast("string"))
    given = F.coalesce(F.col("cursor") != "", F.lit(False))
    place = decode_cursor(F.col("cursor"))
    typed = requests.select(
        *[F.col(c).alias(f"r_{c}") for c in REQUEST_COLUMNS],
        path.alias("r_path"), key.alias("r_key"),
        F.when(given, place).alias("place"), given.alias("given"))
    typed = typed.where(~F.col("given") | F.col("place.occurred_at").isNotNull()).withColumns({
        "r_after": F.col("place.occurred_at"), "r_after_id": F.col("place.event_id")})
    # Nothing before the cursor is needed: the range begins, or ends, where it stands.
    up, microsecond = F.col("r_sort") == "asc", F.expr("INTERVAL 0.000001 SECOND")
    return typed.drop("place", "given").withColumns({
        "r_start": F.when(up, F.greatest("r_start", "r_after")).otherwise(F.col("r_start")),
        "r_end": F.when(up, F.col("r_end")).otherwise(
            F.least(F.col("r_end"), F.col("r_after") + microsecond))})


def _key_part(name: str) -> Column:
    """The id behind its length, so that ids put together stay apart."""
    return F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name))


def _path_key(path: str) -> Column:
    """An event's key on a path; null if it lacks one of the ids."""
    return F.lit("") if path == APP else F.concat(*[_key_part(name) for name in path.split("+")])


def _by_path(store: DataFrame, paths: list[str], start, end) -> DataFrame:
    """Each event once per path in use, within the time any request asks for."""
    rows = store
    if start is not None:
        rows = rows.where(
            (F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end)))
        if "dt" in store.columns:
            rows = rows.where(F.col("dt").between(F.lit(start.date()), F.lit(end.date())))
    entries = [
        F.struct(F.lit(p).alias("path"), _path_key(p).alias("key"))
        for p in paths
    ]
    keyed = rows.withColumn("__entry", F.explode(F.array(*entries)))
    return keyed.withColumns({
        "path": F.col("__entry.path"), "key": F.col("__entry.key"),
    }).drop("__entry").where(F.col("key").isNotNull())


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds)).cast("bigint")


def _bucketed(events: DataFrame, seconds: int) -> DataFrame:
    return events.withColumn("bucket", _bucket(F.col("occurred_at"), seconds))


def _renamed(spread: DataFrame) -> DataFrame:
    return spread.withColumnsRenamed({"r_app_id": "app_id", "r_path": "path", "r_key": "key"})


def _labels_match() -> Column:
    types, names = F.col("r_types"), F.col("r_names")
    named = (F.col("type") != "identify") & F.coalesce(
        F.array_contains(names, F.col("name")), F.lit(False))
    return (types.isNull() | F.array_contains(types, F.col("type"))) & (names.isNull() | named)


def _behind_cursor() -> Column:
    ts, at = F.col("occurred_at"), F.col("r_after")
    ident, last = F.col("event_id"), F.col("r_after_id")
    return at.isNull() | F.when(
        F.col("r_sort") == "asc", (ts > at) | ((ts == at) & (ident > last))
    ).otherwise((ts < at) | ((ts == at) & (ident < last)))


def _sizes(events: DataFrame, label: str) -> DataFrame:
    """Row counts of the buckets by what a request may ask of their events.

    Counts are written: their join with the requests can then split a hot app.
    """
    return materialise(events.groupBy(*MEETING, "type", "name").agg(F.count("*").alias("__rows")), label)


def _coarser(sizes: DataFrame, seconds: int, wider: int) -> DataFrame:
    """The counts of buckets of ``wider`` seconds from those of ``seconds``."""
    bucket = F.floor(F.col("bucket") / F.lit(wider // seconds)).cast("bigint")
    return sizes.withColumn("bucket", bucket).groupBy(*MEETING, "type", "name").agg(
        F.sum("__rows").alias("__rows"))


def _needed(sizes: DataFrame, wanted: DataFrame, seconds: int, within: int | None = None) -> DataFrame:
    """The buckets, in the request's order, until the page is full.

    Events are counted before they meet the requests.  Only buckets that lie wholly
    inside the range count towards the page.  ``wanted`` has the buckets of ``within`` seconds
    that were found to be needed, if any were looked for.
    """
    on = ((sizes["app_id"] == wanted["r_app_id"]) & (sizes["path"] == wanted["r_path"])
          & (sizes["key"] == wanted["r_key"])
          & sizes["bucket"].between(_bucket(wanted["r_start"], seconds), _bucket(wanted["r_end"], seconds)))
    if within is not None:
        wanted = wanted.withColumnRenamed("bucket", "__within")
        on = on & (F.floor(sizes["bucket"] / F.lit(within // seconds)).cast("bigint") == wanted["__within"])
    kept = [c for c in wanted.columns if c != "__within"]
    found = (
        sizes.join(wanted, on)
        .where(_labels_match())
        .groupBy(*kept, "bucket").agg(F.sum("__rows").alias("rows"))
    )
    whole = (F.col("bucket") > _bucket(F.col("r_start"), seconds)) & (
        F.col("bucket") < _bucket(F.col("r_end"), seconds))
    sure = F.when(whole, F.col("rows")).otherwise(0)
    step = F.when(F.col("r_sort") == "asc", F.col("bucket")).otherwise(-F.col("bucket"))
    before = Window.partitionBy("r_request_id").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return (
        found.withColumn("__before", F.coalesce(F.sum(sure).over(before), F.lit(0)))
        .where(F.col("__before") <= F.col("r_limit")).drop("__before")
    )


def _meet(events: DataFrame, needed: DataFrame) -> DataFrame:
    """Requests with the events of the buckets they need."""
    asked = _renamed(needed.drop("rows"))
    ts = F.col("occurred_at")
    return (
        events.join(asked, list(MEETING))
        .where((ts >= F.col("r_start")) & (ts < F.col("r_end")) & _labels_match() & _behind_cursor())
        .drop("path", "key", "bucket")
    )


def _pages(pairs: DataFrame, largest: int) -> DataFrame:
    """The first ``limit`` rows per request; the literal bound lets every task cut its
    rows before the shuffle."""
    ascending = F.col("r_sort") == "asc"
    order = [
        F.when(ascending, F.col("occurred_at")).asc(),
        F.when(ascending, F.col("event_id")).asc(),
        F.when(~ascending, F.col("occurred_at")).desc(),
        F.when(~ascending, F.col("event_id")).desc(),
    ]
    by_request = Window.partitionBy("r_request_id")
    top = (
        pairs.withColumn("pos", F.row_number().over(by_request.orderBy(*order)))
        .where(F.col("pos") <= largest + 1)
        .where(F.col("pos") <= F.col("r_limit") + 1)
    )
    return (
        top.withColumn("has_more", F.max("pos").over(by_request) > F.col("r_limit"))
        .where(F.col("pos") <= F.col("r_limit"))
        .withColumn("request_id", F.col("r_request_id"))
        .withColumn("next_cursor", F.when(
            F.col("has_more") & (F.col("pos") == F.col("r_limit")), next_cursor()))
        .drop("r_after", "r_after_id",
              *[f"r_{c}" for c in REQUEST_COLUMNS if f"r_{c}" in top.columns])
    )
