"""Running values and dense order numbers that no single task has to hold.

A plain window puts a whole key into one task. One key may own a third of all
rows, so the running values here split such keys into order ranges, summarise
each range with a map-side combined aggregate and add what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .key_filter import marked

# Rows of one key that a single window group may hold.
GROUP_ROWS = 1_000_000

_AGGREGATE = {"max": F.max, "min": F.min, "sum": F.sum}
_MERGE = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def frequent_keys(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` rows: at most rows / more_than of them.

    Only the key columns are read, and partial counts are combined before the shuffle.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than).select(*keys)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row, written once."""
    return cut(frequent_keys(df, [key], 1))


def with_again(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``again``, which is false only where no other row has the same ``key``.

    The repeated keys become a bitmap, so no row moves; a few rows of other keys may be true.
    """
    repeated = repeated_keys(df, key)
    many = repeated.count()
    if not many:
        return df.withColumn("again", F.lit(False))
    return marked(df, repeated, key, many, "again").withColumn("again", F.col("again") | F.col(key).isNull())


def running_before(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``values`` (name -> (max | min | sum, expression)) over the rows of the
    same key that come strictly before in ``order``.

    ``order`` must be a unique integer, so a range of ``group_rows`` numbers holds
    at most that many rows. Only keys beyond ``group_rows`` are cut into ranges;
    all others stay in one group and cost a single shuffle of the data.
    """
    source = df
    for name, (_, expression) in values.items():
        source = source.withColumn(f"_in_{name}", expression)
    # broadcast is bounded: a listed key owns more than group_rows rows
    hot = F.broadcast(frequent_keys(source, keys, group_rows).withColumn("_hot", F.lit(True)))
    part = F.when(F.col("_hot"), F.floor(F.col(order) / group_rows)).otherwise(F.lit(-1)).cast("bigint")
    # dealt by range as well: an input that is hashed by the keys alone would satisfy
    # the window below and leave all ranges of a frequent key in one task
    parted = source.join(hot, keys, "left").withColumn("_part", part).drop("_hot").repartition(*keys, "_part")

    per_part = (
        source.join(hot, keys, "inner")
        .withColumn("_part", part)
        .groupBy(*keys, "_part")
        .agg(*[_AGGREGATE[op](f"_in_{name}").alias(f"_all_{name}") for name, (op, _) in values.items()])
    )
    # one row per range of a frequent key
    earlier_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys,
        "_part",
        *[_AGGREGATE[op](f"_all_{name}").over(earlier_parts).alias(f"_off_{name}") for name, (op, _) in values.items()],
    )

    earlier_rows = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.select(
        "*",
        *[_AGGREGATE[op](f"_in_{name}").over(earlier_rows).alias(f"_loc_{name}") for name, (op, _) in values.items()],
    )
    merged = local.join(offsets, [*keys, "_part"], "left")
    return merged.select(
        *[merged[c] for c in df.columns],
        *[_MERGE[op](F.col(f"_loc_{name}"), F.col(f"_off_{name}")).alias(name) for name, (op, _) in values.items()],
    )


def with_order_number(df: DataFrame, order: list[str | Column], name: str = "seq") -> DataFrame:
    """Dense 0-based numbers in a global order, without a one-task window.

    A range-partitioned sort is written once; each row's number is its place in
    its file partition plus the rows of the partitions before. The join side has
    one row per sort partition.
    """
    slot = F.monotonically_increasing_id()
    ordered = cut(
        df.orderBy(*order).select(
            "*",
            F.shiftright(slot, 33).alias("_slice"),
            slot.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
    )
    per_slice = ordered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # as many rows as the sort has partitions, whatever the data size
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    numbered = ordered.join(F.broadcast(offsets), "_slice")
    return numbered.withColumn(name, F.col("_start") + F.col("_place")).drop("_slice", "_place", "_start")


def with_total_before(df: DataFrame, order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """Sums of ``values`` (name -> expression) over all rows that come before in a global order.

    Like ``with_order_number``: totals run within each sort partition, and each partition
    adds what the partitions before it hold.
    """
    slot = F.monotonically_increasing_id()
    ordered = cut(
        df.orderBy(*order).select(
            "*",
            *[value.alias(f"_value_{name}") for name, value in values.items()],
            F.shiftright(slot, 33).alias("_slice"),
            slot.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
    )
    per_slice = ordered.groupBy("_slice").agg(*[F.sum(f"_value_{name}").alias(f"_rows_{name}") for name in values])
    # as many rows as the sort has partitions, whatever the data size
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("_slice", *[F.coalesce(F.sum(f"_rows_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in values])
    within = Window.partitionBy("_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.select("*", *[F.coalesce(F.sum(f"_value_{name}").over(within), F.lit(0)).alias(f"_local_{name}") for name in values])
    joined = local.join(F.broadcast(offsets), "_slice")
    return joined.select(*[joined[c] for c in df.columns], *[(F.col(f"_start_{name}") + F.col(f"_local_{name}")).alias(name) for name in values])


def with_total_before_in(df: DataFrame, key: str, order: list[str], values: dict[str, Column], hot: DataFrame) -> DataFrame:
    """Sums of ``values`` over the rows of the same ``key`` that come before in ``order``.

    The keys in ``hot``, which are few and hold too many rows for a window group, are sorted
    with all tasks (:func:`with_total_before`); all others cost a single shuffle.
    """
    earlier = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def grouped(of: DataFrame) -> DataFrame:
        return of.select("*", *[F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name) for name, value in values.items()])

    if hot.isEmpty():
        return grouped(df)
    totals = with_total_before(df.join(F.broadcast(hot), key, "left_semi"), [key, *order], values)
    # one row per frequent key
    bases = totals.groupBy(key).agg(*[F.min(name).alias(f"_base_{name}") for name in values])
    far = totals.join(F.broadcast(bases), key).select(*df.columns, *[(F.col(name) - F.col(f"_base_{name}")).alias(name) for name in values])
    return grouped(df.join(F.broadcast(hot), key, "left_anti")).unionByName(far)
