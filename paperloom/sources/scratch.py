"""Tables between stages, on storage that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet below ``spark.checkpoint.dir`` and read again.

    It cuts the lineage, so that what is used several times is made once and survives lost executors.
    Only where the setting is missing and the master is local does a temporary folder take its place.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
