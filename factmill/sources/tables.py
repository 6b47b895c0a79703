"""Tables written on the way, to cut lineage: they survive lost executors and are computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out to all cores, for work that takes long for each row however few bytes the rows are.

    A table of few bytes is read by one task and adaptive execution puts small partitions together; a number given here holds.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the folder of spark.checkpoint.dir and read it back.

    A folder of this machine is set only in local mode, where the session names none. (checkpoint() itself would compute its rows twice.)
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factmill-"))
        root = context.getCheckpointDir().get()
    path = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(path)
