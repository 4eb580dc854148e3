"""Cutting lineage between rounds, and what a Python worker holds at once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Records and bytes of one Arrow batch: what a worker holds of long texts does not grow with the rows of its partition.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again, so that lost executors cost no rounds. The folder is
    spark.checkpoint.dir; where that is unset it is a temporary one in local mode, as in tests, and an error on a cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="sievegate-"))
    return df.checkpoint()


def bounded(spark: SparkSession) -> SparkSession:
    """Sets BATCHES where the session does not set them itself. A query calls it while it is built."""
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in BATCHES.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark
