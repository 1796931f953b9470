"""A session with the settings the operators are designed for; any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "loomset", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | conf).getOrCreate()
