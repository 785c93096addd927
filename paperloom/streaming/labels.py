"""An extension: lines of arriving files labelled as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def label_stream(spark: SparkSession, folder: str) -> DataFrame:
    """line, auto_label of each text file that appears in the folder; stateless, so late files need no watermark."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"), T.auto_label(F.col("value")).alias("auto_label")).where(T.strip(F.col("line")) != "")
