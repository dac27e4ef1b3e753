"""Stored states of fusions: a merge reads and writes the hash buckets it touches, earlier versions stay readable."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.session import pin, release

#: A version lists its buckets in one small table, which is read as a whole.
MOST_BUCKETS = 10_000


@dataclass(frozen=True)
class StateTable:
    """A mergeable state (of ranks, votes, counts) under ``path``, which all executors share.

    Rows lie in hash buckets of ``keys``; name all columns that tell rows of
    the state apart, so that no bucket is larger than others. Each version lists the version that
    holds each bucket's rows. The list is one file written last, so a version
    whose writing failed is never seen, and writing it again replaces it. One writer at a time.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: object

    @classmethod
    def create(cls, state: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> StateTable:
        """Version 1 from a first state, which may be empty."""
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
        table = cls(state.sparkSession, path.rstrip("/"), tuple(keys), buckets, state.schema)
        table._write(state, 1, {})
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, older: dict[int, int]) -> None:
        place = f"{self.path}/data/version={version}"
        dealt = rows.withColumn("_bucket", self._bucket()).repartition("_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(place)
        written = self.spark.read.schema("_bucket int").parquet(place).select("_bucket").distinct()
        holders = older | {r._bucket: version for r in written.collect()}
        listed = self.spark.createDataFrame(sorted(holders.items()), "bucket int, holder int").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def holders(self, version: int | None = None) -> dict[int, int]:
        """bucket -> version that holds its rows; a bucket without rows is left out."""
        listed = self.spark.read.schema("bucket int, holder int, version int").parquet(f"{self.path}/versions")
        return {r.bucket: r.holder for r in listed.filter(F.col("version") == (version or self.version())).collect()}

    def version(self) -> int:
        """The latest version: the greatest number among the lists."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        complete = [f.getPath().getParent().getName() for f in system.globStatus(root.suffix("/version=*/_SUCCESS"))]
        return max(int(name.split("=")[1]) for name in complete)

    def _rows(self, holders: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/_bucket={b}" for b, v in sorted(holders.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The state as of ``version``, or the latest."""
        return self._rows(self.holders(version))

    def touched(self, delta: DataFrame) -> dict[int, int]:
        """The stored buckets that a merge with ``delta`` reads."""
        hit = {r.b for r in delta.select(self._bucket().alias("b")).distinct().collect()}
        return {b: v for b, v in self.holders().items() if b in hit}

    def upsert(self, delta: DataFrame, merge: Callable[..., DataFrame]) -> int:
        """Merge the state ``delta`` into the stored one by ``merge(old, new)``; the new version.

        Buckets that ``delta`` has no row for are neither read nor written.
        """
        fresh = not getattr(delta, "_pinned", None)
        delta = pin(delta, "delta")
        older, version = self.holders(), self.version() + 1
        old = self._rows(self.touched(delta))
        merged = merge(old, delta.select(*old.columns))
        self._write(merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema]), version, older)
        if fresh:
            release(delta)
        return version
