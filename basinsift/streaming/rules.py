"""The stateless rule cascade over a stream of establishments (an extension: the study itself is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basinsift.plans import cascade
from basinsift.plans.catalogue import Catalogue


def read_registry(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def classify(stream: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Every output of the cascade for each arriving row; no state, so any output mode and late rows work."""
    return cascade.classify(stream, catalogue)


def priority_counts(stream: DataFrame, time: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Classified rows counted by window and field priority, with late rows up to the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "prioridad_campo").agg(F.count("*").alias("n"))
