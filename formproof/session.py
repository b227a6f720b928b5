"""Session settings the plans rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime settings only: a caller's own master, memory and executor layout win.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share.

    It lies in the folder named by ``spark.checkpoint.dir``, or in the session's
    warehouse where that is unset; a session with neither is refused.
    """
    conf = spark.sparkContext.getConf()
    for key in ("spark.checkpoint.dir", "spark.sql.warehouse.dir"):
        if root := spark.conf.get(key, None) or conf.get(key, None):
            return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
