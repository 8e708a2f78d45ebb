"""Written tables and files in the folder that driver and executors share, and helpers that several operators use."""

from __future__ import annotations

import uuid
from contextvars import ContextVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.store import shared_folder

MOST_RANGES = 512


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The scopes that are open in this thread.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


class Passing:
    """A scope of written tables: what is written inside goes at its end, unless it is kept for the scope around it. Only what the result still reads has to be kept."""

    def __enter__(self) -> Passing:
        self.paths: list[str] = []
        self.token = _open.set((*_open.get(), self.paths))
        return self

    def keep(self, *tables: DataFrame) -> None:
        for table in tables:
            self.paths.remove(table.written_path)
            if len(_open.get()) > 1:
                _open.get()[-2].append(table.written_path)

    def __exit__(self, *_) -> None:
        _open.reset(self.token)
        for path in self.paths:
            store, where = fs.FileSystem.from_uri(path)
            store.delete_dir(where)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once and read again: nothing above it is computed twice, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _open.get():
        _open.get()[-1].append(path)
    return out


def bucketed(df: DataFrame, key: str, name: str, dealt: bool, codec: str = "zstd") -> DataFrame:
    """df, written once in buckets of key and read again: what joins or groups by key later moves the other side alone. dealt: whether a task has all rows of its keys already, as behind a grouping
    by key. The table has no name any more once it can be read."""
    spark, n = df.sparkSession, spread(df.sparkSession)
    path, called = new_folder(spark, name), f"bucketed_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, key)).write.format("parquet").option("path", path).option("compression", codec).bucketBy(n, key).saveAsTable(called)
    out = spark.table(called)
    out.schema  # noqa: B018  resolved before the name goes; the files of a table with a path stay
    spark.sql(f"DROP TABLE {called}")
    out.written_path = path
    if _open.get():
        _open.get()[-1].append(path)
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    for paths in _open.get():
        if table.written_path in paths:
            paths.remove(table.written_path)
    store, where = fs.FileSystem.from_uri(table.written_path)
    store.delete_dir(where)


def key_ranges(df: DataFrame, key: str, parts: int, null_by: Column) -> Column:
    """The number of the range of key, from at most MOST_RANGES about equal ranges; nulls go by null_by to as many below zero. The bounds are literals, so that every run of a task deals rows alike."""
    parts = min(parts, MOST_RANGES)
    probabilities = [i / parts for i in range(1, parts)]
    cuts = sorted(set(df.approxQuantile(key, probabilities, 0.2 / parts))) if parts > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else None
    within = F.lit(0)
    if bounds is not None:
        within = F.size(F.filter(bounds, lambda c: c <= F.col(key)))
    return F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(null_by), F.lit(parts))).otherwise(within).cast("long")


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows as a table, by Arrow. Plain rows would be an RDD of Python objects, for which each executor starts a daemon and workers beside those of its other tasks."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
