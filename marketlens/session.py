"""Session helpers: a local session for tests and benchmarks, and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "marketlens", cores: int | None = None, shuffle: int = 8) -> SparkSession:
    """A local session in UTC, for tests and benchmarks; a cluster brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``, read lazily by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where a local session names none."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketlens-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder (in a folder for each value of ``by``, where given) and read back: what
    several plans use is computed once, and a lost executor costs none of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
