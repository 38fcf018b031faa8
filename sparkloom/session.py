"""Session set-up and the durable cut of long lineages."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "sparkloom", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster the session comes from outside."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder the cluster names in spark.checkpoint.dir; only where none is named, as in tests, set a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        named = os.path.join(tempfile.gettempdir(), f"sparkloom-checkpoint-{os.getuid()}")
    sc.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so a lost executor costs nothing that came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
