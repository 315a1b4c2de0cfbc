"""The session that frames are made in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    return spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
