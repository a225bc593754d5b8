"""Expiry of stored events and storage tiers of raw batches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.model import RETENTION_DAYS
from eventloom.operators.normalise import expires_at
from eventloom.session import materialise, run_folder
from eventloom.sources.event_store import adopt, drop_days, read_store


@dataclass(frozen=True)
class Tiers:
    """Ages in days.  ``strict`` tiers start after the day, others on it."""

    names: tuple[str, str, str]
    second: int
    third: int
    delete: int
    strict: bool


# The two published lifecycle settings.
INFREQUENT_TIERS = Tiers(("standard", "infrequent_access", "archive_instant"), 90, 180, 365, False)
COOL_TIERS = Tiers(("hot", "cool", "archive"), 30, 90, 365, True)


def purge_expired(store: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Events that are still alive at ``now``.

    The day bound drops whole partitions; the exact test only touches the last one.
    """
    boundary = now - timedelta(days=days)
    alive = store.where(expires_at(F.col("occurred_at"), days) > F.lit(_epoch(now)))
    if "dt" in store.columns:
        alive = alive.where(F.col("dt") >= F.lit(boundary.date()))
    return alive


def _epoch(now: datetime) -> int:
    return (now - datetime(1970, 1, 1)) // timedelta(seconds=1)


def purge_actions(store: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Per app and day: drop the folder, rewrite it, or keep it."""
    boundary = F.lit((now - timedelta(days=days)).date())
    return store.groupBy("app_id", "dt").agg(F.count("*").alias("events")).withColumn(
        "action",
        F.when(F.col("dt") < boundary, "drop").when(F.col("dt") == boundary, "rewrite")
        .otherwise("keep"),
    )


def purge_store(spark: SparkSession, path: str, now: datetime, days: int = RETENTION_DAYS) -> None:
    """Applies expiry to a store on disk: old days go, the boundary day is rewritten, younger
    days are not read.

    Ids go with their events, so an event can be stored again after its time.  Files of old
    days leave the table by name alone, however many commits they lie in, and are deleted.
    """
    boundary = (now - timedelta(days=days)).date()
    adopt(spark, path)
    with run_folder(spark, "purge"):
        that_day = read_store(spark, path, chosen=F.col("dt") == F.lit(boundary))
        kept = materialise(purge_expired(that_day, now, days), "purge")
        drop_days(spark, path, boundary, kept)


def raw_tier(age_days: Column, tiers: Tiers) -> Column:
    def reached(limit: int) -> Column:
        return age_days > limit if tiers.strict else age_days >= limit

    first, second, third = tiers.names
    return (
        F.when(reached(tiers.delete), "expired")
        .when(reached(tiers.third), third)
        .when(reached(tiers.second), second)
        .otherwise(first)
    )


def raw_tiers(raw: DataFrame, now: Column, tiers: Tiers = INFREQUENT_TIERS) -> DataFrame:
    """Batches and events per storage tier."""
    age = F.datediff(now, F.col("received_at"))
    return raw.withColumn("tier", raw_tier(age, tiers)).groupBy("tier").agg(
        F.count("*").alias("batches"), F.sum("event_count").alias("events"))
