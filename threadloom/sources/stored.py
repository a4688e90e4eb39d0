"""Tables in the shared folder: results that several later steps read, without evaluating them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset on one machine, as in tests, below a local one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not told and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not told and app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="threadloom-")
    return f"{(told or _LOCAL[app]).rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once; they stay until the shared folder is cleared, as lazy results may read them."""
    path = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
