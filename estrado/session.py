"""Session settings that the results depend on, defaults for local runs, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, the cluster's own session is used as it is."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName("estrado")
    return b.config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``. A local session that names none (tests) gets a temporary one; a cluster must name one."""
    app, told = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="estrado-")
        told = _local[app]
    return f"{told.rstrip('/')}/estrado-{app}"
