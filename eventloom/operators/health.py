"""Threshold alarms over the tables the jobs themselves produce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalars import epoch_seconds, from_epoch_seconds

STATISTICS = {"sum": F.sum, "avg": F.avg, "max": F.max}


@dataclass(frozen=True)
class Alarm:
    statistic: str
    threshold: float
    periods: int = 2
    seconds: int = 300


# The published alarm settings.
INGEST_ERRORS = Alarm("sum", 5)
QUERY_ERRORS = Alarm("sum", 5)
PROCESSOR_ERRORS = Alarm("sum", 10)
CLIENT_ERRORS = Alarm("sum", 50)
SERVER_ERRORS = Alarm("sum", 10)
LATENCY = Alarm("avg", 1000)
BACKLOG_AGE = Alarm("max", 600)
DEAD_LETTERS = Alarm("sum", 0, periods=1)


def window_index(ts: Column, seconds: int) -> Column:
    """Number of the tumbling window a time falls into."""
    return F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("bigint")


def window_statistic(df: DataFrame, ts: str, metric: Column, alarm: Alarm, *keys: str) -> DataFrame:
    return (
        df.groupBy(*keys, window_index(F.col(ts), alarm.seconds).alias("window_no"))
        .agg(STATISTICS[alarm.statistic](metric).alias("stat"))
    )


def raise_alarms(
    stats: DataFrame, alarm: Alarm, *keys: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Windows with ``breach`` and ``alarm``.

    A missing window does not breach, so a window raises the alarm exactly if the
    breaching window ``periods - 1`` places back is that many windows back.  Only one
    row per key and window takes part in the ordering.
    """
    breach = F.coalesce(F.col("stat") > F.lit(alarm.threshold), F.lit(False))
    flagged = stats.withColumn("breach", breach)
    ordered = Window.partitionBy(*keys, "breach").orderBy("window_no")
    back = alarm.periods - 1
    earlier = F.lag("window_no", back).over(ordered) if back else F.col("window_no")
    run = F.col("breach") & F.coalesce(earlier == F.col("window_no") - back, F.lit(False))
    return flagged.select(
        *keys,
        from_epoch_seconds(F.col("window_no") * alarm.seconds).alias("window_start"),
        "stat", "breach", run.alias("alarm"), *keep,
    )


def windowed_alarm(df: DataFrame, ts: str, metric: Column, alarm: Alarm, *keys: str) -> DataFrame:
    """Statistic per tumbling window, and an alarm where it stays above the threshold
    for the given number of consecutive windows."""
    return raise_alarms(window_statistic(df, ts, metric, alarm, *keys), alarm, *keys)


def error_alarm(report: DataFrame, ts: str = "received_at", alarm: Alarm = PROCESSOR_ERRORS,
                *keys: str) -> DataFrame:
    """Batches per window that failed in any way."""
    failed = F.col("outcome").isin("rejected", "missing", "write_failed").cast("bigint")
    return windowed_alarm(report, ts, failed, alarm, *keys)


def status_alarms(
    outcomes: DataFrame, ts: str, status: str, client: Alarm = CLIENT_ERRORS,
    server: Alarm = SERVER_ERRORS,
) -> DataFrame:
    """Alarms on 4xx and 5xx answers, from one pass over the outcomes."""
    classes = F.col(status)
    counted = outcomes.groupBy(window_index(F.col(ts), client.seconds).alias("window_no")).agg(
        F.count_if(classes.between(400, 499)).alias("4xx"),
        F.count_if(classes.between(500, 599)).alias("5xx"),
    )
    parts = []
    for name, alarm in (("4xx", client), ("5xx", server)):
        stats = counted.select(F.lit(name).alias("status_class"), "window_no",
                               F.col(name).alias("stat"))
        parts.append(raise_alarms(stats, alarm, "status_class"))
    return parts[0].unionByName(parts[1])


def latency_alarm(events: DataFrame, alarm: Alarm = LATENCY, *keys: str) -> DataFrame:
    """Average milliseconds from receipt to processing."""
    micros = F.unix_micros(F.col("processed_at").cast("timestamp")) - F.unix_micros(
        F.col("received_at").cast("timestamp"))
    return windowed_alarm(events, "received_at", micros / 1000, alarm, *keys)


def backlog_age(pointers: DataFrame, done: DataFrame, now: Column,
                alarm: Alarm = BACKLOG_AGE) -> DataFrame:
    """Age of the oldest waiting pointer at the end of every window up to ``now``.

    ``done`` has ``batch_id`` and ``processed_at``.  Pointers are reduced to the oldest
    one per last window of waiting; from there on there is one row per window.
    """
    size = alarm.seconds
    waiting = pointers.select("batch_id", "received_at").join(
        done.select("batch_id", "processed_at"), "batch_id", "left")
    last_end = F.floor(epoch_seconds(now) / size).cast("bigint") - 1
    # A pointer done inside a window no longer waits at that window's end.
    last = F.coalesce(window_index(F.col("processed_at"), size) - 1, last_end)
    latest = waiting.select(F.least(last, last_end).alias("last"), "received_at").where(
        F.col("last") >= window_index(F.col("received_at"), size)
    ).groupBy("last").agg(F.min("received_at").alias("received_at"))
    # At the end of window w waits whoever waits at least until w and came before its
    # end; the oldest of all that wait until w or longer has come, or nobody has.
    by_last = Window.orderBy("last")
    oldest = F.min("received_at").over(by_last.rowsBetween(0, Window.unboundedFollowing))
    spans = latest.select("last", F.lag("last").over(by_last).alias("before"),
                          oldest.alias("oldest"))
    first = F.greatest(F.col("before") + 1, window_index(F.col("oldest"), size))
    ages = spans.select(
        F.explode(F.sequence(first, F.col("last"))).alias("window_no"), "oldest"
    ).select(
        "window_no",
        ((F.col("window_no") + 1) * size - epoch_seconds(F.col("oldest"))).alias("stat"),
    )
    return raise_alarms(ages, alarm)


def dead_letter_alarm(dead: DataFrame, ts: str = "received_at",
                      alarm: Alarm = DEAD_LETTERS) -> DataFrame:
    return windowed_alarm(dead, ts, F.lit(1).cast("bigint"), alarm)
