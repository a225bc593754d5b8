"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on.  They are set on the running session, so
# they also hold when the caller brings its own.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# For event jobs besides: many rows, of which a step needs few columns or few rows.
EVENT_CONF = {
    **RUNTIME_CONF,
    # Tasks of this size are enough to keep all cores busy to the end of a stage.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A side whose partitions are this small is hashed, so the other, wide one is not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
}

_local_scratch: str | None = None
_runs = threading.local()


def build_session(app: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**EVENT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession, settings: dict[str, str] = RUNTIME_CONF) -> SparkSession:
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="eventloom-")
    return _local_scratch


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created or reused."""
    opened = getattr(_runs, "folders", [])
    top = opened[-1] if opened else shared_dir(spark)
    return f"{top}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder of its own for what a job writes in between, removed when the job is over.

    Only for jobs that write their results elsewhere before they end: a DataFrame made
    inside cannot be read after it.
    """
    folder = scratch(spark, label)
    _runs.folders = [*getattr(_runs, "folders", []), folder]
    try:
        yield folder
    finally:
        _runs.folders = _runs.folders[:-1]
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written.

    Spark itself removes them only when the driver happens to collect its garbage, so a job of
    many steps would hold the shuffles of all of them.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages then restart from files that survive a lost executor, and
    non-deterministic columns keep one value for every reader.
    """
    path = scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
