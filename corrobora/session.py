"""Session helpers: the shared folder and pinned (written) intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "16g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corrobora")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster a
    machine-local folder would be lost with its machine, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corrobora-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores if it has fewer partitions than there are cores.

    A file with one row group is one task, however many cores wait. Inputs of
    a cluster's size have partitions enough and come back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` as Parquet and drop the shuffle files of doing so: what is read afterwards is the table."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def pin(df: DataFrame, name: str = "pin", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning and filter
    pushdown, and gives the planner the true size of the table. A table that
    :func:`pin` returned is not written again. Inside :func:`scratch` the table goes when the scope
    ends; :func:`release` frees it earlier.
    """
    if getattr(df, "_pinned", None):
        return df
    path = scratch_path(df.sparkSession, name)
    write_once(df, path, **options)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._pinned = path
    if _scopes:
        _scopes[-1].append(written)
    return written


def narrow(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Some columns of a table, perhaps renamed, still known as pinned if it was: reading fewer columns needs no new copy."""
    out = df.select(*columns)
    out._pinned = getattr(df, "_pinned", None)
    return out


def release(*tables: DataFrame) -> None:
    """Delete pinned tables that nothing will read any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_pinned", None)
        if isinstance(path, str):
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: Settings by which Spark relies on the order of bucket files, and aggregates sorted rows as they come.
_ORDERED = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.execution.replaceHashWithSortAgg")
#: Spark refuses tables of 100,000 buckets and more.
MOST_BUCKETS = 50_000


@contextmanager
def bucketed(
    df: DataFrame, keys: Sequence[str], then: Sequence[str] = (), bucket_bytes: int = 64 << 20
) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed by ``keys`` and sorted by ``keys`` and ``then``; dropped when the scope ends.

    ``df`` is pinned first, so that the bucket count comes from its true size and not from an estimate: one per
    ``bucket_bytes``, at least one per core and at most :data:`MOST_BUCKETS`. Aggregations and joins on the keys
    read the table without a shuffle; as each bucket is one sorted file, the scope also lets Spark rely on that order, so
    that they neither sort nor hash its rows.
    """
    spark = df.sparkSession
    fresh = not getattr(df, "_pinned", None)
    df = pin(df, "unbucketed")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-size // bucket_bytes)))
    name, path = f"bucketed_{uuid.uuid4().hex}", scratch_path(spark, "bucketed")
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *then).saveAsTable(name)
    if fresh:
        release(df)
    table = spark.table(name)
    before = {c: spark.conf.get(c, None) for c in _ORDERED}
    for c in _ORDERED:
        spark.conf.set(c, "true")
    try:
        yield table
    finally:
        for c, value in before.items():
            spark.conf.set(c, value) if value is not None else spark.conf.unset(c)
        spark.sql(f"DROP TABLE {name}")
        table._pinned = path
        release(table)


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """A scope whose pinned tables are deleted at its end: read results before it closes.

    >>> with scratch():
    ...     vote_fuse(claims).write.parquet(path)
    """
    _scopes.append([])
    try:
        yield
    finally:
        release(*_scopes.pop())
