"""State of a stream kept as a table in buckets of its key.

A batch reads the buckets that its keys fall into and writes these anew, nothing else, so what it reads does not
grow with the number of batches before it.  A small map says which batch wrote each bucket last; it is written after
the buckets, so a batch that fails halfway is simply run again from the state before it.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketTable:
    """Rows by key in a folder; `schema` is DDL and has the key columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _maps(self) -> list[int]:
        folder = self._path("maps")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _map(self, batch: int) -> dict[int, int]:
        return {int(b): n for b, n in json.loads(self.spark.read.text(f"{self.path}/maps/{batch}").first()[0]).items()}

    def before(self, batch: int | None = None) -> dict[int, int]:
        """Which batch wrote each bucket, as it was before a batch (or now)."""
        known = [m for m in self._maps() if batch is None or m < batch]
        return self._map(known[-1]) if known else {}

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of some rows fall into, `buckets` of them at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, written: dict[int, int], only: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        paths = [f"{self.path}/batch={n}/_bucket={b}" for b, n in written.items() if only is None or b in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, batch: int, rows: DataFrame, touched: list[int]) -> None:
        """Makes these rows the whole content of the touched buckets."""
        before = self.before(batch)
        if touched:
            rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/batch={batch}")
        now = before | {b: batch for b in touched}
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/maps/{batch}")
        self._sweep(batch)

    def _sweep(self, batch: int) -> None:
        """Removes what only maps older than the last two name."""
        known = [m for m in self._maps() if m <= batch]
        for old in known[:-2]:
            kept = self._map(known[known.index(old) + 1])
            for b, n in self._map(old).items():
                if kept.get(b) != n:
                    self._files.delete(self._path(f"batch={n}/_bucket={b}"), True)
            self._files.delete(self._path(f"maps/{old}"), True)

    def rows(self) -> DataFrame:
        """The table as it is now."""
        return self.read(self.before())
