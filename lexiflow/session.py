"""Session helpers.

The library never hard-codes cluster settings into queries.  ``get_session`` is
what tests, ``bench.py`` and examples use; on a cluster the caller's session is
used as is and only missing settings are filled in.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a query relies on for scale: AQE re-plans joins from runtime sizes
# (a join side is only broadcast when its *materialised* size is below the
# adaptive threshold; the static planner, which only has estimates, never
# broadcasts on its own), splits skewed partitions and coalesces small ones.
# Explicit ``broadcast()`` is used only for tables with a proven size bound.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, partitions: int = 8, app: str = "lexiflow",
                extra: dict | None = None, driver_memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = driver_memory
    conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Rows of an Arrow batch that holds texts: a task's memory follows this, not the partition.
ROWS_PER_BATCH = 512


def text_batches(spark: SparkSession | None = None) -> None:
    """Lower the Arrow batch size of the session (the active one) to ROWS_PER_BATCH rows if it is higher."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used unchanged.  Only
    when it is unset and the master is ``local`` (tests) a scratch folder is
    created so that ``DataFrame.checkpoint()`` works; on a cluster an unset
    folder raises, since a folder of one machine loses what others write.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="lexiflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Compression of stored steps and derived inputs: small, at little time.
COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a write made inside go when it ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read back.  Lineage ends here as with a checkpoint, in compressed
    columns, and the shuffle files behind it are dropped."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(**COMPACT).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; whatever read them must have been stored itself by then."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
