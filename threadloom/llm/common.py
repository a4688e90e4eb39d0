"""What the operators of this subpackage share: table access and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset on one machine, as in tests, a new local folder."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not told and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not told and app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="threadloom-")
    return told or _LOCAL[app]


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a table written in the shared folder: no lineage, and it survives lost executors.

    Tables stay until `drop` or until the folder is cleared; a lazy result may still read them.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `cut` that no later result reads."""
    for stored in tables:
        context = stored.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(stored: DataFrame) -> int:
    """Size of the files of a table made by `cut`."""
    context = stored.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished phases; call it after `cut` when the phase wrote much.

    Spark's listeners keep the last finished query until another one ends, so an empty one is run first.
    """
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
