"""Tables that are merged into: copy on write by bucket, with one small list of folders for each version.

A key's rows lie in the bucket of its hash. A merge reads and rewrites the buckets that the
delta touches, and then publishes a version: a one-file table that names the folder of each
bucket. Its file appears by one rename, so a reader sees all of a merge or none; folders that no
version names are left by merges that failed. One writer at a time is expected; of two, the one
that publishes later fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: folders that one read names
BUCKETS = 64


class VersionedTable:
    """A table under ``path`` with unique, non-null keys; ``buckets`` holds from its first version on."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def folders(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """(version, {bucket: folder}) of a version, by default the last; (0, {}) before the first. At most ``buckets`` rows."""
        try:
            known = self.spark.read.schema("bucket int, folder string, version int").parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        last = known.agg(F.max("version")).first()[0] if version is None else version
        rows = known.filter(F.col("version") == last).filter("bucket is not null").collect() if last else []
        return last or 0, {r.bucket: r.folder for r in rows}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last one. Older versions stay readable."""
        return self._read(list(self.folders(version)[1].values()))

    def merge(self, delta: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Publish ``combine(old rows, delta)`` and return the version's number.

        Only the buckets of the delta's keys are read and written. ``combine`` gives the columns
        of the table and must keep a key's rows within its key. Rows without a key are left out.
        An empty delta publishes nothing.
        """
        number, folders = self.folders()
        delta = delta.filter(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in delta.select(self._bucket()).distinct().collect())  # at most ``buckets``
        if not touched:
            return number
        done = combine(self._read([folders[b] for b in touched if b in folders]), delta).select(*self.schema.names)
        place = f"{self.path}/data/{number + 1}-{uuid.uuid4().hex}"
        done.withColumn("bucket_", self._bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(place)
        written = {r[0] for r in self.spark.read.parquet(place).select("bucket_").distinct().collect()}
        now = {b: f for b, f in folders.items() if b not in touched} | {b: f"{place}/bucket_={b}" for b in touched if b in written}
        self.publish(number + 1, now)
        return number + 1

    def publish(self, version: int, folders: dict[int, str]) -> None:
        """Name the folders of a version; it fails where the version was published. An empty table has one too."""
        if self.folders()[0] >= version:
            raise ValueError(f"version {version} of {self.path} was published by another writer")
        rows = sorted(folders.items()) or [(None, "")]
        self.spark.createDataFrame(rows, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")  # what a failed attempt left goes


def yields(base: DataFrame, delta: DataFrame, key: str = "source") -> DataFrame:
    """UPS4: (key, total, hq, quality, last_seen) after the finds of ``delta`` (key, total, hq, last_seen): counts add up, the share of good ones in percent follows, cut."""
    b, d = base.alias("b"), delta.alias("d")
    both = b.join(d, F.col(f"b.{key}") == F.col(f"d.{key}"), "full_outer").select(
        F.coalesce(f"b.{key}", f"d.{key}").alias(key), *[(F.coalesce(f"b.{x}", F.lit(0)) + F.coalesce(f"d.{x}", F.lit(0))).alias(x) for x in ("total", "hq")], F.greatest("b.last_seen", "d.last_seen").alias("last_seen")
    )
    return both.withColumn("quality", F.when(F.col("total") > 0, F.floor(F.col("hq") * 100 / F.col("total")).cast("int")).otherwise(0))
