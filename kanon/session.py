"""Session helpers.

Only tests and ``bench.py`` build their own session; library code takes the
session it is given and never changes cluster-wide settings.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "kanon") -> SparkSession:
    """Local session for tests / bench. On a cluster use the session the platform provides."""
    master = master or os.environ.get("KANON_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KANON_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS / object store) folder and is
    read as-is — from the running context, the session conf or the launch conf.
    Only on a local master (tests) may it be unset: a scratch folder is made then.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    current = current or spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="kanon-ckpt-")
        try:
            spark.conf.set(CHECKPOINT_CONF, current)
        except Exception:  # noqa: BLE001 — some deployments reject core confs at runtime
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
