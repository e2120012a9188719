"""What the operators of this folder share: reading, word patterns, salted joins, folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but space, tab, line ends and form feeds.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    """The words as an array; empty for a null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def salted_lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, salts: int = 64
) -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row per key.

    The rows of a key of ``left`` are dealt into ``salts`` groups by ``spread`` and
    ``right`` is repeated for each, so a key with a third of all rows costs no task
    more than a third of a salt. Null keys meet null keys; rows without a partner stay.
    """
    added = [c for c in right.columns if c not in keys]
    many = left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    few = right.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *added,
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_with"),
    )
    on = reduce(
        lambda a, b: a & b, [many[k].eqNullSafe(few[f"_key_{k}"]) for k in keys], many["_salt"] == few["_with"]
    )
    return many.join(few, on, "left").select(*[many[c] for c in left.columns], *[few[c] for c in added])


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) that the given values decide."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
