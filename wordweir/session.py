"""Sessions for the command line, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session. On a cluster, spark-submit's own settings apply and this is not used."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(master).appName("wordweir").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names; where none is named (tests), in a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordweir-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
