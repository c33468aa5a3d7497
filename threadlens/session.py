"""Session helpers: a local session for tests/bench and a shared checkpoint dir."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "threadlens") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("THREADLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only in local mode (tests, local runs).

    On a cluster a folder of the driver's machine would be out of the executors' reach, so an unset
    folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="threadlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def write_shared(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    It cuts the lineage (a lost executor costs nothing that came before), computes ``df`` once for several
    readers, and gives later plans true sizes instead of estimates that multiply with every self-join.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of ``df`` from the optimiser's statistics (file sizes for stored tables)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast of ``df`` only if its estimated size is within ``max_bytes``; no job is run.

    For stored tables and ``write_shared`` results the estimate is the size of the columns on disk. For tables
    derived in the same plan it is a large upper bound, so the join is left to AQE, which decides by
    the measured size.
    """
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


def spread(df: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """Deal a small stored table over the cores when its scan has fewer splits than there are cores.

    A small table stored as one row group scans as one task, which would do all per-row work (regexes,
    generators) alone. Tables above ``max_bytes`` keep their own splits, so nothing large is shuffled.
    """
    if plan_bytes(df) > max_bytes:
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def materialize_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Compute a derived table once (shared folder) and broadcast it if what was written is small.

    Used for per-key aggregates joined back to big tables: the big side is then not shuffled for that join.
    """
    return maybe_broadcast(write_shared(df, "small"), max_bytes)
