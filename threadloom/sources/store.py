"""A stored graph that is replaced conversation by conversation and is whole at any time.

Rows lie in folders by bucket (a hash of the conversation).  A write makes new folders for the buckets it touches, from
their old rows and the new ones, and then puts down one small file, the next manifest, which names the folder of every
bucket.  Readers take the last manifest.  So a job that is lost before that leaves the store as it was, readers of an
older manifest keep their folders until `vacuum`, and of two writers that start from one manifest only one can commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since this one began; nothing was changed."""


class GraphStore:
    """Node rows, edge rows or items under one path; the first write fixes their columns."""

    def __init__(self, spark: SparkSession, path: str, key: str = "conv_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # -- manifests -----------------------------------------------------------------------------------------------------

    def _hadoop(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._hadoop().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, folder = self._files(), self._hadoop("manifest")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"schema": None, "buckets": self.buckets, "folders": {}}
        rows = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True)
        return json.loads(rows.first()[0])  # one entry a bucket

    def _commit(self, version: int, manifest: dict) -> None:
        """Puts the manifest down under its number, or fails if that number is taken."""
        files, beside, to = self._files(), self._hadoop("manifest", f"_{uuid.uuid4().hex}.json"), self._hadoop("manifest", f"{version}.json")
        out = files.create(beside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a rename that does not replace
            jvm.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, to, plain)
        except Exception as failed:
            files.delete(beside, False)
            if files.exists(to):
                raise Conflict(f"version {version} of {self.path} is taken") from failed
            raise

    # -- reading and writing -------------------------------------------------------------------------------------------

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        folders = [f for b, f in sorted(manifest["folders"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of the one named."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no version of a graph at {self.path}")
        return self._rows(self._manifest(known[-1] if version is None else version))

    def write(self, rows: DataFrame) -> int:
        """Replaces the rows of every conversation in `rows`, and returns the new version; conversations that are not in
        `rows` stay.  Only their buckets are read and written.  Rows without a conversation are one of their own."""
        known = self.versions()
        manifest = self._manifest(known[-1] if known else None)
        bucket = F.pmod(F.hash(self.key), F.lit(manifest["buckets"]))
        new = rows.withColumn("__bucket", bucket)
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most the number of buckets
        if not touched and known:
            return known[-1]
        if manifest["schema"]:
            old = self._rows(manifest, touched).withColumn("__bucket", bucket)
            same = rows.select(F.col(self.key).alias("__key")).distinct()
            kept = old.join(same, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
            new = kept.unionByName(new.select(*kept.columns))
        folder = f"data/{uuid.uuid4().hex}"
        new.repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        folders = manifest["folders"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
        version = known[-1] + 1 if known else 0
        self._commit(version, {"schema": manifest["schema"] or schema, "buckets": manifest["buckets"], "folders": folders})
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last `keep`, and data that no kept manifest names; returns the folders deleted.

        Not to be run while a writer is at work: its folders are in no manifest yet.
        """
        files, known = self._files(), self.versions()
        kept, gone = known[-keep:], known[:-keep]
        named = {f for v in kept for f in self._manifest(v)["folders"].values()}
        for version in gone:
            files.delete(self._hadoop("manifest", f"{version}.json"), False)
        deleted, data = 0, self._hadoop("data")
        for write in files.listStatus(data) if files.exists(data) else []:
            inner = [f"data/{write.getPath().getName()}/{b.getPath().getName()}" for b in files.listStatus(write.getPath()) if b.isDirectory()]
            for folder in [f for f in inner if f not in named]:
                files.delete(self._hadoop(folder), True)
                deleted += 1
            if not any(f in named for f in inner):
                files.delete(write.getPath(), True)
        return deleted


# -- clustered tables ------------------------------------------------------------------------------------------------------


def write_clustered(rows: DataFrame, name: str, path: str, key: str = "conv_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows as a table of the catalog, bucketed and sorted by conversation, whose groupings and joins by conversation
    need no exchange.  A conversation is in one bucket, so a giant one is read by one task, row by row."""
    dealt = rows.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)
