"""Sharding by a k-d tree over document metadata, cut at weighted medians.

A document is a point: source, language, size and id, each a coordinate in [0, 1] (names
by hash, so that one source stays together). Every node is cut across its widest
dimension at the median of bytes, until leaves reach the target. All nodes of a level
are cut together, by aggregates alone: quantile sketches propose bounds, one sum per
interval finds the one that holds the median, and the search goes on inside it until it
has few keys. Nothing is sorted, and the driver holds a few numbers per node.

Equal texts are one point and stay in one shard. A text whose copies exceed a small part
of a shard, in bytes or in rows, counts by the row instead, so shards stay equal.

Defined results: a null text counts as empty (size 1); null metadata has a coordinate of
its own; repeated rows are rows of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import unit_interval

# A text with more than 1 / PIECES of a shard's bytes or rows is dealt by the row.
PIECES = 64
# Intervals a search step cuts a node into, and keys that end the search.
INTERVALS, FEW = 64, 1500
# Rows that are numbered in one group.
NUMBERED = 1024
COORDINATE_BITS, TIE_BITS = 23, 39


def _points(rows: DataFrame, bounds) -> DataFrame:
    """Keys ``k0 .. k3``: a coordinate above, a hash that breaks ties below."""

    def scaled(value: Column, low, high) -> Column:
        span = float((high or 0) - (low or 0)) or 1.0
        return F.coalesce((value - F.lit(float(low or 0))) / F.lit(span), F.lit(0.0))

    coordinates = [
        unit_interval(F.lit("source"), F.col("source")),
        unit_interval(F.lit("lang"), F.col("lang")),
        scaled(F.log(F.col("size").cast("double")), 0.0, bounds["log_size"]),
        scaled(F.col("doc_id").cast("double"), bounds["low_id"], bounds["high_id"]),
    ]
    tie = F.col("tie").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    top = F.lit(float((1 << COORDINATE_BITS) - 1))
    return rows.withColumns(
        {
            f"k{i}": F.shiftleft((F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * top).cast("bigint"), TIE_BITS).bitwiseOR(tie)
            for i, c in enumerate(coordinates)
        }
    )


def _by_node(values: dict[int, object], node: Column, default: Column) -> Column:
    """The literal of each node."""
    return reduce(lambda rest, item: F.when(node == item[0], F.lit(item[1])).otherwise(rest), values.items(), default)


def weighted_medians(points: DataFrame) -> dict[int, int]:
    """For each ``node`` of ``points`` (node, key, bytes) the key that most nearly halves
    its bytes; keys up to it are the first half."""
    searched: dict[int, tuple[int, int, float, float]] = {}  # node -> above, up to, bytes before, half
    for row in points.groupBy("node").agg(F.sum("bytes").alias("bytes")).collect():
        searched[row["node"]] = (-1, (1 << 62), 0.0, row["bytes"] / 2)
    found: dict[int, int] = {}
    while searched:
        low = _by_node({n: s[0] for n, s in searched.items()}, F.col("node"), F.lit(None).cast("bigint"))
        high = _by_node({n: s[1] for n, s in searched.items()}, F.col("node"), F.lit(None).cast("bigint"))
        inside = points.where((F.col("key") > low) & (F.col("key") <= high))
        at = [i / INTERVALS for i in range(1, INTERVALS)]
        sketches = inside.groupBy("node").agg(
            F.percentile_approx("key", at, 1000).alias("at"), F.approx_count_distinct("key").alias("keys")
        ).collect()
        wide = {r["node"]: sorted({b for x in r["at"] for b in (x - 1, x)}) for r in sketches if r["keys"] > FEW}
        few = [r["node"] for r in sketches if r["keys"] <= FEW]
        if few:
            # approx_count_distinct is within some percent: about FEW keys a node
            keys = inside.where(F.col("node").isin(few)).groupBy("node", "key").agg(F.sum("bytes").alias("bytes")).collect()
            for node in few:
                _, _, before, half = searched.pop(node)
                best, total = (abs(before - half), searched_low(keys, node)), before
                for row in sorted((r for r in keys if r["node"] == node), key=lambda r: r["key"]):
                    total += row["bytes"]
                    best = min(best, (abs(total - half), row["key"]))
                found[node] = best[1]
        if wide:
            bounds = _by_node(
                {n: b for n, b in wide.items()}, F.col("node"), F.array().cast("array<bigint>")
            )
            interval = F.size(F.filter(bounds, lambda b: b < F.col("key")))
            sums = inside.where(F.col("node").isin(list(wide))).groupBy("node", interval.alias("i")).agg(
                F.sum("bytes").alias("bytes")
            ).collect()
            for node, cuts in wide.items():
                lower, upper, before, half = searched[node]
                edges = [lower, *cuts, upper]
                for row in sorted((r for r in sums if r["node"] == node), key=lambda r: r["i"]):
                    if before + row["bytes"] >= half:
                        searched[node] = (edges[row["i"]], edges[row["i"] + 1], before, half)
                        break
                    before += row["bytes"]
                if searched[node][1] - searched[node][0] <= 1:  # one key holds the median
                    found[node] = searched.pop(node)[1]
    return found


def searched_low(keys: list, node: int) -> int:
    """The bound just below the smallest key of a node."""
    return min(r["key"] for r in keys if r["node"] == node) - 1


def kd_tree(points: DataFrame, depth: int) -> DataFrame:
    """``points`` (k0 .. k3, bytes, further columns) with their leaf as ``node``, from 0."""
    here = points.withColumn("node", F.lit(0))
    node = F.col("node")
    for _ in range(depth):
        extents = here.groupBy("node").agg(
            *[(F.shiftright(F.max(f"k{i}"), TIE_BITS) - F.shiftright(F.min(f"k{i}"), TIE_BITS)).alias(f"e{i}") for i in range(4)]
        ).collect()
        widest = {r["node"]: max(range(4), key=lambda i: (r[f"e{i}"], -i)) for r in extents}
        key = reduce(lambda rest, item: F.when(node == item[0], F.col(f"k{item[1]}")).otherwise(rest), widest.items(), F.col("k0"))
        cuts = weighted_medians(here.select("node", key.alias("key"), "bytes"))
        above = (key > _by_node(cuts, node, F.lit(0).cast("bigint"))).cast("int")
        here = cut(here.withColumn("node", (node * 2 + above).cast("int")))
    return here


def shard(documents: DataFrame, leaves: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``documents``
    (``doc_id, text, source, lang``): ``leaves`` shards (a power of two), or as many as
    bring a shard down to ``target_bytes``."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        documents.select(
            "doc_id", "source", "lang",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("of"),
        )
    )
    total = rows.agg(
        F.sum("size").alias("bytes"),
        F.count(F.lit(1)).alias("rows"),
        F.log(F.max("size").cast("double")).alias("log_size"),
        F.min("doc_id").cast("double").alias("low_id"),
        F.max("doc_id").cast("double").alias("high_id"),
    ).first()
    many = leaves or max(1, (total["bytes"] or 1) / (target_bytes or 1))
    depth = max(0, ceil(log2(many)))
    piece_bytes, piece_rows = (max(1.0, (total[c] or 0) / (2**depth * PIECES)) for c in ("bytes", "rows"))

    groups = cut(
        rows.groupBy("of", "size", "text_crc32").agg(
            F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in ("doc_id", "source", "lang")]
        )
    )
    weighty = (F.col("copies") > 1) & ((F.col("copies") * F.col("size") > piece_bytes) | (F.col("copies") > piece_rows))
    # at most 2 * 2**depth * PIECES texts can be so large a part of all
    split = F.broadcast(groups.where(weighty).select("of", "size", "text_crc32"))
    text_key = ["of", "size", "text_crc32"]
    single = rows.join(split, text_key, "left_semi").select(*rows.columns, F.xxhash64("doc_id", "source", "lang").alias("tie"))
    grouped = groups.where(~weighty).withColumn("tie", F.col("of"))
    fields = [*rows.columns, "tie", "bytes"]
    units = single.withColumns({"bytes": F.col("size"), "alone": F.lit(True)}).select(*fields, "alone").unionByName(
        grouped.withColumns({"bytes": F.col("copies") * F.col("size"), "alone": F.lit(False)}).select(*fields, "alone")
    )
    placed = kd_tree(cut(_points(units, total)), depth).withColumnRenamed("node", "shard")
    result = ["doc_id", "size", "text_crc32", "of", "shard"]
    together = rows.join(split, text_key, "left_anti").join(placed.where(~F.col("alone")).select(*text_key, "shard"), text_key)
    dealt = placed.where("alone").select(*result).unionByName(together.select(*result))

    groups_of_numbers = max(1, ceil((total["rows"] or 0) / 2**depth / NUMBERED))
    part = F.pmod(F.xxhash64("of", "doc_id"), F.lit(groups_of_numbers)).cast("int")
    dealt = cut(dealt.withColumn("part", part))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("of", "doc_id"))
    numbered = dealt.withColumn("nth", nth).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("bigint").alias("slot")
    )
