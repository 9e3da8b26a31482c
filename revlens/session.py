"""Session helpers.

On a cluster the session comes from the platform and already names a shared
``spark.checkpoint.dir``; we only read it. Tests and local runs set their own
folder, and only when the setting is absent.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "revlens", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_CONFIGURED: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Where none is set a temporary one is made in local
    mode only; on a cluster that is an error, as other machines could not read it."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None)
    if not path:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master is {master})")
        path = tempfile.mkdtemp(prefix="revlens-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(CHECKPOINT_CONF, path)
    app = spark.sparkContext.applicationId
    if _CONFIGURED.get(app) != path:
        spark.sparkContext.setCheckpointDir(path)
        _CONFIGURED[app] = path
    return path


def checkpoint(df):
    """Reliable checkpoint into the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder (Parquet) and read back: lineage is cut, a lost
    executor costs no recomputation, and every later reader scans only the columns it needs.

    Columns are stored by position, so names that differ in case only, or hold odd characters,
    are kept; a column of nothing but untyped nulls is not stored."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    fields = [(f"c{i}", f) for i, f in enumerate(df.schema.fields)]
    stored = [(c, f) for c, f in fields if not isinstance(f.dataType, T.NullType)]
    (df.toDF(*[c for c, _ in fields]).select(*[c for c, _ in stored]).write.parquet(path))
    back = spark.read.schema(T.StructType([T.StructField(c, f.dataType) for c, f in stored])).parquet(path)
    return back.select(*[(F.lit(None) if isinstance(f.dataType, T.NullType) else F.col(c)).alias(f.name)
                         for c, f in fields])


def drop_other_folders(spark: SparkSession, path: str, keep: str) -> None:
    """Delete the folders below ``path`` but one, through the path's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(at):
        if found.isDirectory() and found.getPath().getName() != keep:
            fs.delete(found.getPath(), True)


def local_test_session(cores: int | None = None) -> SparkSession:
    """Session for tests / bench: local mode, few shuffle partitions."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return get_session(master=f"local[{n}]", shuffle_partitions=n,
                       driver_memory=os.environ.get("REVLENS_DRIVER_MEMORY", "16g"))
