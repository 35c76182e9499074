"""Helpers that the operators of this folder share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents that a Python worker holds as Python objects at one time.
SLICE = 512


def text_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns, whatever their names, go."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if told is None and known.isDefined():
        return known.get()
    if told is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="quadrille-")  # one machine, as in tests
    if not known.isDefined():
        context.setCheckpointDir(told)
    return told


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: its lineage ends there and outlives any executor."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more; what was made of them must have been written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Has the driver drop plans that nothing holds any more, upon which Spark deletes their shuffle files; left alone, it may keep them to the end."""
    gc.collect()
    spark._jvm.System.gc()


def map_slices(frame: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, size: int = SLICE) -> DataFrame:
    """mapInArrow over slices of `size` rows. `make` is called once a task and returns the function of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = each(batch.slice(at, size))
                if out is not None:
                    yield out

    return frame.mapInArrow(run, schema)


def sha_hex(value: Column) -> Column:
    return F.sha2(value, 256)
