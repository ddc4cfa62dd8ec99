"""Sensor readings as a stream: validate, and mark usability at an explicit instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan import schemas
from fieldscan.operators.contract import sensor_errors, usable_at


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.SENSORS).json(path)


def mark_usable(readings: DataFrame, as_of: Column, max_age_seconds: float = C.SENSOR_MAX_AGE_SECONDS) -> DataFrame:
    """Stateless on purpose: the instant is given, never the wall clock, so a replay
    gives the same answer. Works on static and streaming readings alike."""
    return readings.withColumn("errors", sensor_errors()).withColumn(
        "usable", (F.size("errors") == 0) & usable_at(as_of, max_age_seconds))
