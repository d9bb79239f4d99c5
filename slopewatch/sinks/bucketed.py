"""A keyed table in buckets: a merge reads and writes only the buckets its rows fall into.

Rows lie in buckets by the hash of their key. A manifest names the folder of each
bucket; a merge writes new folders for the touched buckets and then one new
manifest, so readers see the table before or after it, never between. Untouched
buckets keep their files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
Merge = Callable[[DataFrame, DataFrame], DataFrame]  # (old rows, new rows) of the touched buckets


class BucketedTable:
    """Table at ``path``; ``keys`` identify a row, ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifests(self) -> DataFrame | None:
        """Rows (version, bucket, folder, merge_id) of all versions; no table yet: None."""
        try:
            return self.spark.read.schema("bucket int, folder string, merge_id string, version int").parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def current(self, version: int | None = None) -> tuple[int, dict[int, str], set[str]]:
        """(version, folder of every bucket, merges done); at most a row per bucket and merge is read."""
        rows = self.manifests()
        if rows is None:
            return 0, {}, set()
        last = rows.agg(F.max("version")).first()[0] if version is None else version
        if last is None:
            return 0, {}, set()
        own = rows.filter(F.col("version") == last).collect()
        done = {r["merge_id"] for r in rows.select("merge_id").distinct().collect()}
        return last, {r["bucket"]: r["folder"] for r in own if r["folder"]}, done

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, the latest by default."""
        return self._rows(sorted(set(self.current(version)[1].values())))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted keys; only their buckets are read."""
        touched = [r[0] for r in wanted.select(self.bucket()).distinct().collect()]  # at most one row per bucket
        folders = self.current()[1]
        return self._rows([folders[b] for b in touched if b in folders]).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _written(self, run: str) -> list:
        """Buckets that a merge left rows in, from what it wrote."""
        try:
            return self.spark.read.parquet(f"{self.path}/data/{run}").select("_bucket").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return []

    def merge(self, new: DataFrame, rule: Merge, merge_id: str) -> int:
        """Apply ``rule`` to the touched buckets and return the new version; a ``merge_id`` that is done changes nothing."""
        version, folders, done = self.current()
        if merge_id in done:
            return version
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())  # at most one row per bucket
        old = self._rows([folders[b] for b in touched if b in folders])
        merged = rule(old, new).select(*self.schema.fieldNames()).withColumn("_bucket", self.bucket())
        run = f"v{version + 1:08d}"
        # one task per touched bucket at least; a large bucket may be several files
        merged.repartition(max(len(touched), 1), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{run}")
        left = {r[0] for r in self._written(run)}
        swapped = {**folders, **{b: f"{run}/_bucket={b}" if b in left else "" for b in touched}}
        rows = [(b, f, merge_id) for b, f in sorted(swapped.items())] or [(-1, "", merge_id)]
        told = self.spark.createDataFrame(rows, "bucket int, folder string, merge_id string").withColumn("version", F.lit(version + 1))
        told.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.path}/manifest")
        return version + 1
