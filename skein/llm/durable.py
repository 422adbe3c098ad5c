"""Results kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``.

    Where it is unset a session of one machine (``local[...]``) gets a folder of its
    own; on a cluster that is an error, since executors would not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once, as a table, to the checkpoint folder, so that losing executors costs nothing and no stage runs twice.

    Unlike ``checkpoint()``, which computes its rows once to count and once to write
    them, a table is computed once, is compressed, and is read by column.  The
    folder goes when the session ends.
    """
    spark = df.sparkSession
    ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
