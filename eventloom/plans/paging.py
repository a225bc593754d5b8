"""Filtered, ordered, keyset-paginated reads."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions.cursors import encode_cursor, sort_key
from eventloom.model import EVENT_TYPES, EventQuery, Limits
from eventloom.operators.normalise import to_api
from eventloom.session import materialise
from eventloom.sources import versions
from eventloom.sources.event_store import read_store


def check_query(q: EventQuery, limits: Limits | None = None) -> None:
    """The request rules for a single call's arguments."""
    limits = limits or Limits()
    problems = []
    if not q.app_id:
        problems.append("appId is required")
    if q.end <= q.start:
        problems.append("to must be after from")
    if q.end - q.start > timedelta(days=limits.max_window_days):
        problems.append(f"Date range must not exceed {limits.max_window_days} days")
    if not 1 <= q.limit <= limits.max_page:
        problems.append(f"limit must be between 1 and {limits.max_page}")
    if q.sort not in ("asc", "desc"):
        problems.append("sort must be asc or desc")
    if set(q.types) - set(EVENT_TYPES):
        problems.append("unknown event type")
    if "" in (q.user_id, q.anonymous_id, q.session_id):
        problems.append("ids must not be empty")
    if problems:
        raise ValueError("; ".join(problems))


def predicate(store: DataFrame, q: EventQuery) -> Column:
    """All filters of the request.

    Bounds on the partition day are added by hand: a filter on the time alone would
    not prune folders.
    """
    where = (
        (F.col("app_id") == q.app_id)
        & (F.col("occurred_at") >= _at(q.start))
        & (F.col("occurred_at") < _at(q.end))
    )
    if "dt" in store.columns:
        where = where & F.col("dt").between(F.lit(q.start.date()), F.lit(q.end.date()))
    if q.types:
        where = where & F.col("type").isin(*q.types)
    if q.names:
        where = where & (F.col("type") != "identify") & F.col("name").isin(*q.names)
    for column in ("user_id", "anonymous_id", "session_id"):
        value = getattr(q, column)
        if value is not None:
            where = where & (F.col(column) == value)
    return where


def _at(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def read_cursor(cursor: str) -> tuple[datetime, str]:
    """The position a cursor parameter names; ``ValueError`` unless well formed."""
    try:
        padded = cursor + "=" * (-len(cursor) % 4)
        fields = json.loads(base64.urlsafe_b64decode(padded).decode("utf-8"))
        if not (isinstance(fields["pk"], str) and fields["pk"]):
            raise ValueError("no pk")
        iso, event_id = fields["sk"].split("#")
        return datetime.fromisoformat(iso.removesuffix("Z")), event_id
    except (ValueError, KeyError, TypeError, AttributeError, binascii.Error) as problem:
        raise ValueError("Invalid pagination cursor") from problem


def after_cursor(q: EventQuery) -> Column:
    """Strictly behind the cursor in the request's order."""
    if q.cursor is None:
        return F.lit(True)
    at, event_id = read_cursor(q.cursor)
    ts, ident = F.col("occurred_at"), F.col("event_id")
    if q.sort == "asc":
        return (ts >= _at(at)) & ((ts > _at(at)) | (ident > event_id))
    return (ts <= _at(at)) & ((ts < _at(at)) | (ident < event_id))


def ordering(sort: str) -> list[Column]:
    columns = [F.col("occurred_at"), F.col("event_id")]
    return [c.asc() if sort == "asc" else c.desc() for c in columns]


def next_cursor() -> Column:
    return encode_cursor(F.col("app_id"), sort_key(F.col("occurred_at_iso"), F.col("event_id")))


def query_page(store: DataFrame, q: EventQuery, limits: Limits | None = None) -> DataFrame:
    """One page: up to ``limit`` rows with ``pos``, ``has_more`` and ``next_cursor``.

    One row more than asked for is fetched to learn whether there is a next page.
    Ordering and limit are one step, so each task hands over ``limit + 1`` rows; the
    window after it sees no more than that.
    """
    check_query(q, limits)
    top = (
        store.where(predicate(store, q) & after_cursor(q))
        .orderBy(*ordering(q.sort)).limit(q.limit + 1)
    )
    numbered = top.withColumn(
        "pos", F.row_number().over(Window.partitionBy("app_id").orderBy(*ordering(q.sort)))
    ).withColumn("has_more", F.count("*").over(Window.partitionBy("app_id")) > q.limit)
    return numbered.where(F.col("pos") <= q.limit).withColumn(
        "next_cursor",
        F.when(F.col("has_more") & (F.col("pos") == q.limit), next_cursor()))


def query_events(store: DataFrame, q: EventQuery, limits: Limits | None = None) -> DataFrame:
    """A page as a reader sees it."""
    return to_api(query_page(store, q, limits), "pos", "has_more", "next_cursor")


def number_rows(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Adds ``rank``, the 1-based position of each row within its ``keys``.

    Rows are cut into ordered ranges over keys and order together, so a single key
    with most of the rows, or a burst at one instant, spreads over all tasks.  A
    rank is the position inside the range plus the sizes of the ranges before it.
    The ranges are written down first, since cutting them again may cut elsewhere.
    """
    cut = rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
        "__range", F.spark_partition_id())
    cut = materialise(cut, "ranges")
    sizes = cut.groupBy(*keys, "__range").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    return (
        cut.withColumn("__pos", F.row_number().over(inside))
        .join(offsets, [*keys, "__range"])
        .withColumn("rank", F.col("__pos") + F.col("__offset"))
        .drop("__range", "__pos", "__offset")
    )


def page_walk(store: DataFrame, page_size: int, sort: str = "desc") -> DataFrame:
    """Every page of every app: each row with its ``page`` (from 0) and ``pos``."""
    ranked = number_rows(store, ("app_id",), ordering(sort))
    return ranked.withColumns({
        "page": F.expr(f"(rank - 1) div {page_size}"),
        "pos": (F.pmod(F.col("rank") - 1, F.lit(page_size)) + 1).cast("int"),
    }).drop("rank")


def page_index(walk: DataFrame, page_size: int) -> DataFrame:
    """Per page: its size, the cursor that opens it and the one that leads on."""
    last = F.max_by(F.struct("occurred_at_iso", "event_id"), F.col("pos"))
    pages = walk.groupBy("app_id", "page").agg(
        F.count("*").alias("items"), last.alias("last"))
    closing = pages.select("app_id", "page", "items", encode_cursor(
        F.col("app_id"), sort_key(F.col("last.occurred_at_iso"), F.col("last.event_id"))
    ).alias("closing"))
    opening = closing.select("app_id", (F.col("page") + 1).alias("page"),
                             F.col("closing").alias("start_cursor"))
    final = pages.groupBy("app_id").agg(F.max("page").alias("last_page"))
    return (
        closing.join(opening, ["app_id", "page"], "left")
        .join(final, "app_id")
        .select(
            "app_id", "page", "items", "start_cursor",
            (F.col("page") < F.col("last_page")).alias("has_more"),
            F.when(F.col("page") < F.col("last_page"), F.col("closing")).alias("next_cursor"),
        )
    )


def page_at(
    spark: SparkSession, path: str, app_id: str, page: int, page_size: int, sort: str = "desc",
) -> DataFrame:
    """Page ``page`` (from 0) of an app, without ranking the app or walking there by cursors.

    The table of files says how many rows each day of the app has; the day that holds the page
    is counted by the hour, and only the hours that hold it are ordered.  So what is read is the
    files of one day or two, the wide columns of one hour or two.  Rows of days and hours that
    come before are only counted, by at most one row a day and an hour on the driver.
    """
    first, up = page * page_size, sort == "asc"
    held = versions.files(spark, path).where(
        F.col("live") & (F.col("kind") == versions.EVENTS) & (F.col("app_id") == app_id))
    days = held.groupBy("dt").agg(F.sum("rows").alias("n")).collect()
    before, days = _spans({r.dt: r.n for r in days}, first, page_size, up)
    rows = read_store(spark, path, chosen=(F.col("app_id") == app_id) & F.col("dt").isin(days))
    hour = F.date_trunc("hour", F.col("occurred_at")).cast("timestamp_ntz")
    counts = rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).collect()
    skipped, hours = _spans({r.hour: r.n for r in counts}, first - before, page_size, up)
    if not hours:
        rows = rows.limit(0)
    else:
        rows = rows.where((F.col("occurred_at") >= _at(min(hours)))
                          & (F.col("occurred_at") < _at(max(hours) + timedelta(hours=1))))
    skip = first - before - skipped
    top = rows.orderBy(*ordering(sort)).limit(skip + page_size)
    numbered = top.withColumn("__row", F.row_number().over(
        Window.partitionBy("app_id").orderBy(*ordering(sort))))
    return numbered.where(F.col("__row") > skip).withColumns({
        "page": F.lit(page).cast("bigint"), "pos": (F.col("__row") - skip).cast("int")}).drop("__row")


def _spans(counts: dict, first: int, size: int, up: bool) -> tuple[int, list]:
    """The spans that hold rows ``first`` up to ``first + size``, and how many rows come before them."""
    before, skipped, found = 0, 0, []
    for span in sorted(counts, reverse=not up):
        if before + counts[span] <= first:
            skipped = before + counts[span]
        elif before < first + size:
            found.append(span)
        before += counts[span]
    return skipped, found
