"""Known ids, kept so that a check of few ids opens few row groups and old ones can expire.

Ids lie in folders of their day, and each day's are dealt by hash to a number of buckets that
grows with the day: a power of two, part of the folder's name, so that tables of any age are
read together.  Inside a file they stand in the order of arrival, in row groups of GROUP_ROWS
with a Bloom filter each (Parquet's own).  New ids are told from the filters alone, and the
ids of a batch that is delivered again stand together, in few groups.  Files are listed by
version (``versions``); small ones are merged, and whole days dropped, without a reader noticing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import materialise
from eventloom.sources import paths, versions

BUCKET = "id_bucket"
#: Ids of a day per bucket, as a rule; the bucket count is the next power of two.
BUCKET_IDS = 1 << 20
GROUP_ROWS = 1 << 13
#: A check of up to so many ids goes through the Bloom filters; more of them are joined.
FEW_IDS = 2_000
#: Chance that a filter says yes for nothing: for FEW_IDS of them together two in a hundred.
FALSE_HITS = 1e-5


def _schema(key: str) -> T.StructType:
    return T.StructType([
        T.StructField(key, T.StringType()),
        T.StructField("seen", T.TimestampNTZType()),
        T.StructField("commit_id", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("buckets", T.LongType()),
        T.StructField(BUCKET, T.LongType()),
    ])


def bucket_of(key: Column, buckets: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(buckets - 1)


def table_of(path: str) -> str:
    """Where the ids of a table without versions of its own are kept."""
    return f"{path.rstrip('/')}.ids"


def write_files(ids: DataFrame, root: str, key: str, commit_id: str) -> DataFrame:
    """Writes ``ids`` (key, ``seen``, ``dt``) to a folder of their own; the rows that describe
    its files.  Nothing reads them before a version names them."""
    spark = ids.sparkSession
    folder = f"_ids/commit_id={commit_id}.{uuid.uuid4().hex[:12]}"
    known = ids.where(F.col(key).isNotNull())
    # At most one row per day that is larger than a bucket.
    large = known.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_IDS).collect()
    buckets = F.lit(1).cast("long")
    for day in large:
        more = 1 << (-(-day.n // BUCKET_IDS) - 1).bit_length()
        buckets = F.when(F.col("dt").eqNullSafe(F.lit(day.dt)), F.lit(more).cast("long")).otherwise(buckets)
    rows = known.groupBy(key, "dt").agg(F.min("seen").alias("seen")).withColumn("buckets", buckets)
    rows = rows.withColumn(BUCKET, bucket_of(F.col(key), F.col("buckets")))
    parts = ("dt", "buckets", BUCKET)
    (
        rows.hint("rebalance", *parts).sortWithinPartitions(*parts, "seen", key)
        .write.options(**{
            f"parquet.bloom.filter.enabled#{key}": "true",
            f"parquet.bloom.filter.expected.ndv#{key}": str(GROUP_ROWS),
            f"parquet.bloom.filter.fpp#{key}": str(FALSE_HITS),
            "parquet.block.row.count.limit": str(GROUP_ROWS),
        }).partitionBy(*parts).parquet(f"{root}/{folder}")
    )
    written = spark.read.schema(_schema(key)).option("basePath", f"{root}/_ids").parquet(f"{root}/{folder}")
    return versions.describe(written, root, versions.IDS, folder, commit_id, F.lit(None), F.col("seen"))


def open_ids(spark: SparkSession, root: str, key: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], _schema(key))
    return spark.read.schema(_schema(key)).option("basePath", f"{root}/_ids").parquet(*names)


def read_ids(spark: SparkSession, root: str, key: str, commit_id: str | None = None) -> DataFrame:
    """All known ids with their bucket, but for those of one commit (which is being repeated)."""
    found = versions.files(spark, root).where(F.col("kind") == versions.IDS)
    chosen = None if commit_id is None else F.col("commit_id") != commit_id
    return open_ids(spark, root, key, versions.places(found, root, chosen))


def add_ids(ids: DataFrame, root: str, key: str, commit_id: str) -> None:
    """Adds a commit's ids (key, ``seen``, ``dt``); repeating a commit replaces them."""
    spark = ids.sparkSession
    base = versions.latest(spark, root)
    own = versions.files(spark, root, base).where(F.col("live") & (F.col("commit_id") == commit_id))
    versions.switch(spark, root, base, [write_files(ids, root, key, commit_id)], own)


def exists(spark: SparkSession, root: str) -> bool:
    return paths.exists(spark, f"{root}/_versions")


def touched(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The part of ``known`` that can hold any of ``ids``, by the buckets of every bucket count."""
    counts = sorted(r.buckets for r in known.select("buckets").distinct().collect())
    here = []
    for count in counts:
        numbers = [0]
        if count > 1:
            own = ids.select(bucket_of(F.col(key), F.lit(count)).alias(BUCKET)).distinct()
            # As many numbers as there are buckets, at most.
            numbers = sorted(r[BUCKET] for r in own.collect())
        here.append((F.col("buckets") == count) & F.col(BUCKET).isin(numbers))
    return known.where(reduce(Column.__or__, here)) if here else known


def already_known(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct ``ids`` that are in ``known``, an id table or any table with that column.

    Few ids are named to the scan of an id table, which then skips row groups by their Bloom
    filters; many are joined with the buckets they can be in.
    """
    return among(materialise(ids.select(key).distinct(), "wanted"), known, key)


def among(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``already_known`` for ids that are distinct and written down already."""
    if BUCKET in known.columns:
        few = [r[key] for r in wanted.where(F.col(key).isNotNull()).limit(FEW_IDS + 1).collect()]
        if len(few) <= FEW_IDS:
            buckets = wanted.where(F.col(key).isNotNull())
            return touched(buckets, known, key).where(F.col(key).isin(few)).select(key).distinct()
        known = touched(wanted, known, key)
    return known.select(key).join(wanted.select(key), key, "left_semi").distinct()
