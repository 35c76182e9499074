"""Session settings and the cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the folder that driver and executors share (spark.checkpoint.dir), read again."""
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadrille-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get()
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
