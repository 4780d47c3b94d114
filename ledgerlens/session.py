"""Session helpers for tests, benchmarks and local runs.

On a cluster the session comes from the launcher; nothing here overrides
settings that are already present there.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Sizing knobs that matter at scale.  AQE coalesces small shuffle partitions and
# splits skewed ones at runtime, so the static partition count can stay high.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "ledgerlens", driver_memory: str = "16g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    for key, value in CLUSTER_DEFAULTS.items():
        if key != "spark.sql.adaptive.advisoryPartitionSizeInBytes":
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_cluster_defaults(spark: SparkSession) -> None:
    """Give a session the defaults above that its launcher and Spark's own
    configuration leave unset."""
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in CLUSTER_DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a scratch folder; a cluster
    session without one is an error, never a machine-local folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    try:
        context = spark.sparkContext
    except Exception:  # Spark Connect: only the session setting is visible
        context = None
    current = context.getCheckpointDir() if context is not None else None
    if current:
        return current
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        # a driver-local folder is invisible to executors on a cluster
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    current = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", current)
    if context is not None:
        context.setCheckpointDir(current)
    return current
