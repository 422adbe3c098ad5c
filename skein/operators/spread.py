"""Use all cores for small inputs of few files, which a scan cannot split."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Largest input, in bytes, that is spread; above it a scan has parts enough.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it comes from a few small files; otherwise as it is.

    Only the names and sizes of the files are looked at; large inputs are never
    shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or 2 * len(files) >= cores:
        return df
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    total = 0
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(cores) if total <= SMALL_BYTES else df
