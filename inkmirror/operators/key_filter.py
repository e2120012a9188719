"""A filter of keys that runs in the scan of a wide table, before its rows are moved.

A join of few wanted keys with a table of whole pages sends every page through the
shuffle first. Here the wanted keys become a bitmap: each sets one of ``BITS`` bits per key,
the bitmap is cut into pages of 4 kB, and the pages are sent to all executors. A row of the
wide table stays if the bit of its key is set, which all wanted rows' are and about one
in ``BITS`` of the others. What is left goes through the join as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16  # per key
PAGE_BITS = 1 << 15  # of the bitmap aggregate
# Pages that are sent at most (64 MB); more keys than they hold are not filtered by.
MAX_PAGES = 1 << 14


def only_wanted(wide: DataFrame, keys: DataFrame, key: str, at_most: int) -> DataFrame:
    """The rows of ``wide`` whose ``key`` may be among ``keys`` (same column name): all that
    are, few others. Rows without a key go.

    ``at_most`` bounds the rows of ``keys`` and sizes the bitmap; with more keys than it may
    hold all rows stay. A bound that is too low lets more rows through, never less.
    """
    held = wide.where(F.col(key).isNotNull())
    return marked(held, keys, key, at_most, "_wanted", "inner").where("_wanted").select(*wide.columns)


def marked(wide: DataFrame, keys: DataFrame, key: str, at_most: int, name: str, how: str = "left") -> DataFrame:
    """``wide`` with a column that is false only where ``key`` is not among ``keys``; ``inner``
    may leave such rows out."""
    pages = max(1, -(-at_most * BITS // PAGE_BITS))
    if pages > MAX_PAGES:
        return wide.withColumn(name, F.lit(True))
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_hash"))
    bit = F.pmod(F.col("_hash"), F.lit(pages * PAGE_BITS))
    # at most MAX_PAGES rows of 4 kB
    bitmap = hashed.groupBy(F.shiftright(bit, 15).alias("_page")).agg(F.bitmap_construct_agg(bit % PAGE_BITS).alias("_bits"))
    asked = wide.withColumn("_hash", F.xxhash64(key)).withColumn("_page", F.shiftright(bit, 15)).join(F.broadcast(bitmap), "_page", how)
    within = (bit % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), within % 8 + 1)
    return asked.select(*wide.columns, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)).alias(name))
