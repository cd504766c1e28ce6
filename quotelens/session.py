"""Session helpers: build a session for tests / bench, and a shared
checkpoint folder read from the session (set only when unset)."""

from __future__ import annotations

import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "quotelens", extra: dict | None = None) -> SparkSession:
    """Session for local runs. On a cluster the submitter owns the conf."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # the tasks share the cores; each does its own arithmetic
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("QUOTELENS_DRIVER_MEM", "16g"))
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; only when it is unset (tests, local runs)
    create a scratch folder and register it."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quotelens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


class Shared:
    """A driver object for tasks, broadcast by value: workers need no copy of
    the package to read it, and each keeps one."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast({"raw": cloudpickle.dumps(value)})

    def get(self):
        held = self.held.value
        if "value" not in held:
            held["value"] = cloudpickle.loads(held["raw"])
        return held["value"]
