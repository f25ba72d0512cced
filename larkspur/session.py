"""Session defaults: adaptive execution and UTC; sizes are left to the cluster's configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(name: str = "larkspur") -> SparkSession.Builder:
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
