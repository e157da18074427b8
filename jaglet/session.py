"""Sessions set up for the engine, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Settings that the engine relies on.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "jaglet", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword settings use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """The engine's runtime settings on a session that exists."""
    spark.conf.set("spark.sql.session.timeZone", CONF["spark.sql.session.timeZone"])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on this machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        else:
            named = tempfile.mkdtemp(prefix="jaglet-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")
