"""Tables without their lineage, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> None:
    """Sets the folder that ``spark.checkpoint.dir`` names; a temporary one only where none is set, on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage."""
    shared(df.sparkSession)
    return df.checkpoint()
