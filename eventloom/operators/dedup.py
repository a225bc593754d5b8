"""Idempotency: known ids, first copies, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.session import materialise
from eventloom.sources.id_table import already_known, among

# Fixed value: why an event was skipped.
DUPLICATE_REASON = "Duplicate event (already processed)"
FIRST_COPY = ("received_at", "batch_id", "event_index")


def known_ids(ids: DataFrame, store: DataFrame, same_day: bool = False) -> DataFrame:
    """The given ``event_id`` values that the store already holds, once each.

    ``store`` is an event table, of which only the id column is read, or an id table
    (``sources.id_table``), of which only the touched parts are.  The distinct ids are
    written first, so Spark knows their size in bytes when it plans the join.  With
    ``same_day`` an id counts as known only within its app and day, and only those folders
    of the store are read: enough where a repeated event carries the same time.
    """
    if not same_day:
        return already_known(ids, store, "event_id")
    on = ["event_id", "app_id", "dt"]
    wanted = materialise(ids.select(*on).distinct(), "wanted")
    return store.select(*on).join(wanted, on, "left_semi").select("event_id").distinct()


def events_exist(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``exists``: is the ``event_id`` in the store?"""
    hits = known_ids(ids, store).withColumn("__hit", F.lit(True))
    return (
        ids.join(hits, "event_id", "left")
        .withColumn("exists", F.col("__hit").isNotNull())
        .drop("__hit")
    )


def mark_known(events: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``known``: one join over the events, whichever side of the split is wanted."""
    hits = materialise(known_ids(events, store), "known").withColumn("known", F.lit(True))
    return events.join(hits, "event_id", "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def split_duplicates(events: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events not yet stored, and the skipped rest with the reason."""
    marked = mark_known(events, store)
    skipped = marked.where("known").select(
        "batch_id", "event_index", "event_id", F.lit(DUPLICATE_REASON).alias("reason")
    )
    return marked.where("not known").select(*events.columns), skipped


def dedup_within(events: DataFrame, order: tuple[str, ...] = FIRST_COPY) -> DataFrame:
    """Keeps the first copy of every ``event_id``.

    The rank limit is applied before the shuffle as well, so each task passes on at
    most one copy of an id however often it occurs.
    """
    return first_per_key(events, ("event_id",), [F.col(c) for c in order])


def once_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``first_per_key`` for wide rows that hardly ever repeat: keys are counted first,
    and only rows of repeated keys are ranked."""
    repeated = df.groupBy(key).agg(F.count("*").alias("__copies")).where("__copies > 1")
    repeated = materialise(repeated.select(key), "repeats")
    single = df.join(repeated, key, "left_anti")
    return single.unionByName(first_per_key(df.join(repeated, key, "left_semi"), (key,), order))


def first_per_key(df: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def copies_lookup(events: DataFrame) -> DataFrame:
    """For ids that occur more than once: where the first copy is.

    Counts are combined before the shuffle, so a hot id costs one row per task.
    """
    return (
        events.groupBy("event_id")
        .agg(F.count("*").alias("copies"), F.min(F.struct(*FIRST_COPY)).alias("first"))
        .where("copies > 1")
        .select("event_id", "first")
    )


def classify(events: DataFrame, store: DataFrame, same_day: bool = False) -> DataFrame:
    """Adds ``fate`` as if batches were handled one after another by arrival:

    ``stored`` for the first copy of a new event, ``repeat`` for further copies in
    the same batch, ``duplicate`` for events of the store or of an earlier batch.

    Only ids are shuffled to find repeated and known ones, counted in the tasks that read
    them; where a first copy stands is asked for repeated ids alone.  What is found is written,
    so Spark sends it to the events while it is small, and these stay where they are.
    """
    counted = materialise(events.groupBy("event_id").agg(F.count("*").alias("copies")), "counted")
    known = known_ids(events, store, same_day) if same_day else among(counted, store, "event_id")
    known = materialise(known, "known")
    place = StructType(events.select(*FIRST_COPY).schema.fields)
    lookup = known.select("event_id", F.lit(None).cast(place).alias("first"), F.lit(True).alias("known"))
    repeated = counted.where("copies > 1 and event_id is not null").select("event_id")
    if repeated.head(1):
        first = copies_lookup(events.join(repeated, "event_id", "left_semi"))
        fresh = materialise(first.join(known, "event_id", "left_anti"), "fresh")
        lookup = lookup.unionByName(fresh.withColumn("known", F.lit(False)))
    other_batch = F.col("first.batch_id") != F.col("batch_id")
    other_place = F.col("first.event_index") != F.col("event_index")
    fate = (
        F.when(F.col("known") | F.coalesce(other_batch, F.lit(False)), "duplicate")
        .when(other_place, "repeat")
        .otherwise("stored")
    )
    return (
        events.join(lookup, "event_id", "left").withColumn("fate", fate).drop("first", "known")
    )


def upsert_events(
    store: DataFrame, changes: DataFrame, key: tuple[str, ...] = ("app_id", "occurred_at", "event_id"),
    version: str = "received_at",
) -> DataFrame:
    """The store after the changes: a change wins over the stored row, of several changes the
    last version, and of one version the last by batch and place in it."""
    both = store.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    ties = [c for c in ("batch_id", "event_index") if c in both.columns]
    order = [F.col("__new").desc(), F.col(version).desc(), *[F.col(c).desc() for c in ties]]
    return first_per_key(both, key, order).drop("__new")


def upsert_stats(
    store: DataFrame, changes: DataFrame, key: tuple[str, ...] = ("app_id", "event_id")
) -> DataFrame:
    """How many keys an upsert creates and how many it replaces, per app."""
    wanted = changes.select(*key).distinct()
    hits = (
        store.select(*key).join(wanted, list(key), "left_semi").distinct()
        .withColumn("__hit", F.lit(1))
    )
    return wanted.join(hits, list(key), "left").groupBy("app_id").agg(
        F.count_if(F.col("__hit").isNull()).alias("created"),
        F.count_if(F.col("__hit").isNotNull()).alias("updated"),
    )
