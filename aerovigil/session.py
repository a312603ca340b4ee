"""Session helpers: a default local session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_SIDE_ROWS = 100_000


def build_session(name: str = "aerovigil", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide feature projections rely on; safe to apply to any session.

    HotSpot never JIT-compiles methods above 8000 bytes of bytecode. With this limit Spark splits
    such stages into small functions instead of running one interpreted giant. Timestamps without a
    zone are read as UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder, read back from there.

    Cuts the lineage, fixes the rows whatever executor is lost later, and lets readers prune columns.
    """
    path = shared_folder(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count was checked; the frame itself when it is larger."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder of ``spark.checkpoint.dir``, which all executors must share.

    Only a local session may do without the setting; it then uses a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def discard(*frames: DataFrame) -> None:
    """Delete the stage tables that ``frames`` read; a frame that reads none is left alone."""
    for df in frames:
        spark = df.sparkSession
        root = spark.sparkContext.getCheckpointDir()
        for file in df.inputFiles():
            folder = file.rsplit("/", 1)[0]
            if root and "/stage-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
