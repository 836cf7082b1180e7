"""Session defaults used by tests, the bench and the command line."""

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tolqyn", master: str | None = None, **conf) -> SparkSession:
    """A UTC session with adaptive execution. Keyword settings: dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("TOLQYN_SHUFFLE", "8"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in defaults.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
