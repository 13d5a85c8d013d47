"""Order-dependent helpers that do not depend on how large one key is.

A plain `window partitionBy(key)` sorts all rows of a key in one task.  The two
helpers here give the same answers with work split below the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number_within(
    df: DataFrame, keys: list[str], order: list[Column | str], slot: Column, name: str
) -> DataFrame:
    """Exact 1-based row number per key.

    `slot` must be non-decreasing along `order` (for example its first column, or
    that column divided by a constant).  Rows are counted per (key, slot) with
    map-side combine, the small counts are summed up along the slots, and rows are
    only sorted within one slot.
    """
    tmp = f"__{name}_slot"
    marked = df.withColumn(tmp, slot)
    counts = marked.groupBy(*keys, tmp).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(tmp).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(tmp).alias("__slot"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col(tmp).eqNullSafe(F.col("__slot"))]
    inside = Window.partitionBy(*keys, tmp).orderBy(*order)
    return (
        marked.join(starts, same, "inner")
        .withColumn(name, F.col("__start") + F.row_number().over(inside))
        .drop("__start", "__slot", tmp, *[f"__k_{k}" for k in keys])
    )


def number_dealt(
    df: DataFrame, keys: list[str], order: list[Column | str], slot: Column, name: str, most: int = 1_000_000
) -> DataFrame:
    """`number_within` for rows that lie together by their keys: one sort and no exchange while the largest key has at most
    `most` rows, which a first pass counts; beyond that the sort is split as there."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        return number_within(df, keys, order, slot, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def with_lookahead(
    df: DataFrame,
    keys: list[str],
    order: str,
    payload: Column,
    ahead: int = 4,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    block: int = 256,
) -> DataFrame:
    """Add `next1`..`next{ahead}`: the payload of the following rows of the key.

    `order` must be numbered 1, 2, 3, ... within the key.  Rows are cut into blocks
    of consecutive numbers; the first `ahead` rows of each block are copied to the
    block before, so each block can be worked on alone and the number of rows one
    task has to sort together is bounded by `block + ahead`.  The copies are dropped.
    `prepare` adds columns the payload is made of.
    """
    own = F.floor((F.col(order) - 1) / block).cast("long")
    edge = (F.col(order) > block) & (F.pmod(F.col(order) - 1, F.lit(block)) < ahead)
    spread = df.withColumn(
        "__block", F.explode(F.when(edge, F.array(own, own - 1)).otherwise(F.array(own)))
    )
    # An explicit exchange first: what `prepare` and the payload add is computed after it and not shuffled.
    spread = prepare(spread.repartition(*keys, "__block")).withColumn("__payload", payload)
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    for k in range(1, ahead + 1):
        spread = spread.withColumn(f"next{k}", F.lead("__payload", k).over(w))
    return spread.where(F.col("__block") == own).drop("__block")


def tasks_for(spark: SparkSession, rows: int, most: int, least: int = 5_000) -> int:
    """How many tasks share these rows: at most `most` rows each, and enough tasks for all cores if each still gets `least`."""
    busy = min(-(-rows // least), 2 * spark.sparkContext.defaultParallelism)
    return max(1, busy, -(-rows // most))


def dealt(rows: DataFrame, keys: list[str], most: int = 25_000) -> DataFrame:
    """Rows of which each will become many, dealt out by their keys into tasks of about `most` rows.

    What is made of a row then lies with all others of its key: folds, windows and groups by these keys (or by more) exchange
    nothing, and a task sorts in memory. The rows are counted first.
    """
    return rows.repartition(tasks_for(rows.sparkSession, rows.count(), most, 500), *keys)
