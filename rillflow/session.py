"""Getting the package's own code to the executors, and tables between the steps of iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows that goes to a Python worker; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to what Python workers can import, once per application, and bounds what they get at once."""
    context = spark.sparkContext
    if not context.getConf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(context, "_rillflow_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="rillflow-"), "rillflow.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("rillflow", os.path.relpath(path, here)))
    context.addPyFile(target)
    context._rillflow_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    One is made only where none is named and all of Spark runs in this process; elsewhere
    a folder of one machine would be lost to the others, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder as a table and read from there.

    What follows survives lost executors, and Spark plans it by the size of the files: a
    checkpoint would carry on the estimates of the plan that made it, which self-joins
    multiply from round to round.
    """
    folder = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._settled_in = folder
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """The same rows, to be joined by a shuffle however small their files look.

    Files of numbers are a small part of the rows that they hold, so Spark would send whole
    tables of cells through the driver to all tasks, once in each round.
    """
    return df.hint("merge")


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a settled table that nothing will read any more."""
    folder = getattr(df, "_settled_in", None)
    if folder is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
