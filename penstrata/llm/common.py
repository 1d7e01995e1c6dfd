"""Helpers that several operators share: the shared folder, samples and folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder of its own and runs on one machine, as tests do.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/penstrata"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where that is unset and
    all runs on one machine, a folder of that machine stands in; on a cluster
    executors would each write to their own disk, so that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return f"file://{LOCAL_CHECKPOINTS}"


#: Folders made inside ``scratch``, innermost last.
_OPEN: list[list[str]] = []


def _path(spark: SparkSession, folder: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. What is left of it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/penstrata/{name}-{uuid.uuid4().hex}"
    p, store = _path(spark, folder)
    store.mkdirs(p)
    store.deleteOnExit(p)
    if _OPEN:
        _OPEN[-1].append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside go at its end, so all that reads them must have run by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            p, store = _path(spark, folder)
            store.delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p, store = _path(df.sparkSession, path)
        store.delete(p, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def bounded_sample(rows: DataFrame, by: str, most: int, key: str, seed: int = 7, groups: int = 1000) -> DataFrame:
    """Rows of about ``most`` ids per value of ``by`` (all where there are fewer), chosen by a hash of ``key``.

    The choice depends on the ids alone, so that a repeated task picks the
    same rows, and the expected sample is ``most`` rows a value however large
    the table is. Of more than ``groups`` values those with most rows are in
    it, ties to the smaller value: that many counts at most reach the driver.
    """
    counts = rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(groups).collect()
    if not counts:
        return rows
    told = [(r[by], min(1.0, most / r["count"])) for r in counts]
    shares = rows.sparkSession.createDataFrame(told, f"{by} {dict(rows.dtypes)[by]}, _share double")
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(shares), by).where(unit < F.col("_share")).drop("_share")
