"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths and table names given to this process's queries.
_handed_out: list[str] = []
_tables: list[str] = []


def build_session(app: str = "loopweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; extra settings override the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(MERGED_BYTES),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession, most_bytes: int = 32 << 20) -> None:
    """Count the Arrow batches of this session in bytes as well: rows may be blocks of thousands of values."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most_bytes:
        spark.conf.set(setting, str(most_bytes))


#: Shuffled bytes that adaptive execution may merge into one task.
MERGED_BYTES = 8 << 20


def bound_merging(spark: SparkSession) -> None:
    """Keep adaptive execution from merging partitions into tasks that grow with the input.

    By default a stage is merged into about as many tasks as there are cores, of up to 64 MB of compressed
    rows, and a task's hash tables and sorts hold many times that. A smaller setting stays.
    """
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = spark.conf.get(setting) or "64m"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > MERGED_BYTES:
        spark.conf.set(setting, str(MERGED_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so it is refused.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loopweave-checkpoint-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh table name and its path below the shared folder; ``clear_scratch`` removes both."""
    table = f"{name}_{uuid.uuid4().hex}"
    _tables.append(table)
    return table, scratch_path(spark, name)


def drop_scratch(spark: SparkSession, table: str, path: str) -> None:
    """Remove one scratch table before the others."""
    spark.sql(f"drop table if exists {table}")
    drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove one scratch path before the others."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of every action go when it ends; else they stay until the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote below its scratch paths, once no result reads it any more."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _handed_out:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
