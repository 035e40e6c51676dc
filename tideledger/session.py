"""Session defaults. On a cluster the submitted configuration wins."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_STAND_INS: dict[str, str] = {}


def local_session(cpus: int | str = 8, name: str = "tideledger") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by the session.  A temporary one stands in on one machine only: on a
    cluster its executors would not share it, so there a missing setting is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    # The setting is fixed once a session runs, so the stand-in is remembered here.
    application = spark.sparkContext.applicationId
    if application not in _STAND_INS:
        _STAND_INS[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _STAND_INS[application]
