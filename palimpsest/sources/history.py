"""Operation histories: JSON lines of invoke and complete events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "id long, phase string, worker long, op string, key string, value string, invoked double, outcome string, result string, returned double"


def merge(events: DataFrame) -> DataFrame:
    """One row per invoked operation; completion fields are null where none came."""
    invoked = events.filter("phase = 'invoke'").select("id", "worker", "op", "key", "value", "invoked")
    completed = events.filter("phase = 'complete'").groupBy("id").agg(F.max(F.struct("returned", "outcome", "result")).alias("c"))
    return invoked.join(completed, "id", "left").select(*invoked.columns, "c.outcome", "c.result", "c.returned")


def read(spark: SparkSession, path: str) -> DataFrame:
    return merge(spark.read.schema(EVENTS).json(path))
