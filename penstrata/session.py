"""Sessions and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as tests do.
LOCAL = "/tmp/checkpoints/penstrata"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the folder that driver and executors share, for steps that read it more than once.

    The files go when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(folder or 'file://' + LOCAL).rstrip('/')}/penstrata/kept-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(p)
    store.deleteOnExit(p)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
