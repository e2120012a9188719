"""Chains of rows that name their successor, ranked in logarithmic rounds.

A page of a listing names the cursor of the next one. Following them one by one takes a
job per page of the longest listing; here every row's pointer is doubled each round, so
a chain of n rows takes about log2(n) rounds, whatever order the rows landed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def rank_chain(nodes: DataFrame, keys: list[str], at: str, to: str, head) -> DataFrame:
    """``keys, at, rank``: how many steps each row is from the head of its key.

    ``nodes`` has one row per (keys, at); ``to`` names the next row or is null. ``head`` is a
    condition for the first row of a key. Rows that no walk from a head meets are left
    out; a row met again on a loop keeps its first rank. Rows are numbered first, so that the
    rounds move pairs of numbers; their joins are by a number that is unique on one side, so a
    key with a third of all rows is spread like any other. They are never broadcast: each
    round would send tables of the size of the rows through the driver.
    """
    rows = cut(nodes.select(*keys, F.col(at).alias("_at"), F.col(to).alias("_to"), head.alias("_head"), F.monotonically_increasing_id().alias("_no")))
    landed = rows.select(*keys, F.col("_at").alias("_to"), F.col("_no").alias("_next"))
    jumps = cut(rows.where("_to IS NOT NULL").select(*keys, "_to", "_no").join(landed.hint("merge"), [*keys, "_to"]).select("_no", "_next"))
    reached = cut(rows.where("_head").select("_no", F.lit(0).cast("bigint").alias("rank")))
    step, known = 1, reached.count()
    while True:
        # ranks below ``step`` are known, a jump goes ``step`` rows on
        onward = reached.join(jumps.hint("merge"), "_no").select(F.col("_next").alias("_no"), (F.col("rank") + step).alias("rank"))
        reached = cut(reached.unionByName(onward).groupBy("_no").agg(F.min("rank").alias("rank")))
        before, known = known, reached.count()
        if known == before:
            ranked = rows.select(*keys, F.col("_at").alias(at), "_no").join(reached.hint("merge"), "_no")
            return ranked.select(*keys, at, "rank")
        further = jumps.select(F.col("_no").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut(jumps.join(further.hint("merge"), "_next").select("_no", F.col("_far").alias("_next")))
        step *= 2
