"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None
_STAGES: set[str] = set()


def get_session(app: str = "loomstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; parquet keeps filters and pruned columns at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only on one machine (a local master) a temporary folder stands in where
    that is unset; on a cluster its absence is an error.
    """
    global _LOCAL_DIR
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="loomstone-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return "file://" + os.path.abspath(_LOCAL_DIR)


def stage_dir(spark: SparkSession) -> str:
    """This application's folder of written stages, removed when it ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/loomstone-{context.applicationId}"
    if folder not in _STAGES:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _STAGES.add(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    A written table survives lost executors, is compressed and columnar, and
    is computed exactly once, unlike a cached plan.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle width of this session, at least the number of cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, 1)
