"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans are written for. Adaptive execution turns a
# shuffle join into a broadcast join only after it has measured the small side,
# and splits the partitions of hot keys.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("impactframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "localhost")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only local runs get their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="impactframe-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that one plan reads several times, until ``release``."""
    _kept.append(df.persist())
    return df


def release() -> None:
    """Drop the caches of earlier plans. Frames still in use are computed again when read."""
    while _kept:
        _kept.pop().unpersist()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several later stages read, and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
