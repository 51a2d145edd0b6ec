"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: What this process has written and not dropped.
_PATHS: list[str] = []


@lru_cache(1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``. Where that is unset, below a temporary folder if driver and executors are one process on
    one machine (tests); on a cluster that raises an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own()
    _PATHS.append(f"{base}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written out and reread: its lineage ends there, so neither what follows nor a lost executor computes it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def once(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written from ``df`` unless an earlier run has written it to its end."""
    if not done(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this process, once results that read them have been written; gives their number."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
