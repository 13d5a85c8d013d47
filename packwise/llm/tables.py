"""Reading inputs, staging results and small batch helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwise.session import shared_folder, staged

__all__ = ["TwoPlaces", "ascii_lower", "crc_bucket", "read", "rows_of", "smallest", "staged", "texts_of", "tidied", "whole_vector"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_bucket(column: Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo `buckets`."""
    return F.crc32(column.cast("string").cast("binary")) % buckets


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_vector(column: str, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles (from 2^53 on they are whole already); null where the vector is null or
    empty or a component is null or not finite, before or after scaling."""
    given = F.transform(F.col(column), lambda x: x.cast("double") * scale)
    finite = F.forall(given, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    whole = F.transform(given, lambda y: F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y))
    return F.when((F.size(F.col(column)) > 0) & finite, whole)


def smallest(df: DataFrame, order: list, k: int, spread: int = 8) -> DataFrame:
    """The first k rows by `order`. Every task passes on k rows, `spread` tasks merge those, and only their spread * k rows
    meet at the end: what the driver sees does not grow with the number of partitions."""
    own = Window.partitionBy("spread__").orderBy(*order)
    some = df.withColumn("spread__", F.spark_partition_id() % spread).withColumn("place__", F.row_number().over(own))
    return some.where(F.col("place__") <= k).drop("spread__", "place__").orderBy(*order).limit(k)


class TwoPlaces:
    """Staged results of rounds, written in turn to two folders: a round reads the one and overwrites the other."""

    def __init__(self, spark: SparkSession):
        self.spark, self.turn = spark, 0
        self.base = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        path, self.turn = f"{self.base}-{self.turn % 2}", self.turn + 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as large strings without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most_bytes`, so that working arrays stay small whatever the text lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, step = 0, max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        while at < batch.num_rows:
            part = batch.slice(at, step)
            yield part
            at += part.num_rows


def give_back() -> None:
    """Return memory that this process has freed to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def drop_old_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs stay on disk until the driver's garbage collector meets their plans: let it run now."""
    if hasattr(spark, "_jvm"):
        spark._jvm.System.gc()


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What an earlier task of this worker made under that name, or `make()`. Functions sent to workers reach it by this call
    alone, so it is the worker's own."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def drop_held(but: str | None = None) -> None:
    """Forget what tasks of other functions have held."""
    for name in [n for n in _HELD if n != but]:
        del _HELD[name]


def tidied(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches, holds: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow; when a task ends, the caches are emptied and its memory goes back, since Python
    workers live on and wait for other stages. What is `held` under the name `holds` stays until a task of another function starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(holds)
        try:
            yield from function(batches)
        finally:
            for cache in caches:
                cache.cache_clear()
            give_back()

    return run


def annotated(df: DataFrame, text: str, keep: list[str], fields: str, function, *caches) -> DataFrame:
    """One output row for each input row: `doc` (a struct of the columns in keep, so that no name can clash) and
    the columns of `fields`, which `function` makes from an Arrow array of texts (null: empty)."""
    inner = df.select(F.struct(*dict.fromkeys([*keep, text])).alias("doc"))
    kept = df.select(*keep).schema
    schema = f"doc struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in kept)}>, {fields}"
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = batch.column(0)
            doc = pa.StructArray.from_arrays([rows.field(n) for n in names], names=names)
            made = function(texts_of(rows.field(text)))
            yield pa.RecordBatch.from_arrays([doc, *made.values()], names=["doc", *made])

    return inner.mapInArrow(tidied(run, *caches), schema)
