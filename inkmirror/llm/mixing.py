"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is wanted ``target / source_size`` times. Whole copies are
certain; the fraction left is rounded by the pivotal method: two documents meet, and
mass is moved at random from one to the other until one fraction is 0 or 1. What is
moved is counted in words, so the words taken of a source stay what they were, up to
the one fraction that is left in the end. Blocks of a source are folded side by side,
the residues of the blocks are folded again, level by level, until one is left.

Equal rows have equal sizes, so pairing them only moves whole copies: of ``m`` rows that
want the fraction ``p`` each, the whole part of ``m * p`` take one more copy, and what is left
enters the fold as one unit. A row that is repeated very often is a count until it is written.

Defined results: a null or empty text has size 0 and is taken 0 words; null sources
form one source that sorts last; repeated rows are documents of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import with_order_number, with_total_before
from ..session import cut
from .common import salted_lookup, unit_interval, word_count

# Units a block folds in one go; a block's expected size, as blocks are dealt by hash.
BLOCK = 48
# Times a document may be taken at most, and with it a source.
MOST = 3.0
# Equal rows that one task writes in one go.
CHUNK = 100_000
# A fraction nearer to a whole number than this is taken as whole.
WHOLE = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, target`` of ``source, size, many``
    (equal rows counted together); ``n_docs`` counts distinct rows.

    Sources in code point order, null last, take ``weights`` in turn and share all
    words by them. A target stops at ``most`` times the source; what is cut off is
    shared among the others by weight until no target is above.
    """
    totals = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("many")).cast("bigint").alias("source_size"),
        F.count_if((F.col("size") > 0)).alias("n_docs"),
    )
    numbered = with_order_number(totals, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighted = numbered.withColumn("weight", weight)
    full = most * F.col("source_size").cast("double")
    everything = weighted.agg(F.sum("source_size")).first()[0] or 0
    # Sources stop in the order of ``full / weight``. If those before one are stopped, the level
    # is what they leave, by the weights from there on; the first source that does not
    # reach its own limit at that level has the right one.
    ordered = with_total_before(
        weighted.withColumn("limit", full / F.col("weight")), ["limit", "_rank"], {"stopped": full, "weight_before": F.col("weight")}
    )
    all_weights = weighted.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(float(everything)) - F.col("stopped")) / (F.lit(float(all_weights)) - F.col("weight_before"))
    found = ordered.withColumn("level", level).where(F.col("level") < F.col("limit")).agg(F.min_by("level", F.struct("limit", "_rank"))).first()[0]
    share = full if found is None else F.least(full, F.col("weight") * found)
    return weighted.withColumn("target", share).select("source", "source_size", "n_docs", "target")


def _fold(units: Column, seed: int) -> Column:
    """Pivotal rounding over an array of units: ``(at, p, done)``, where ``done`` has
    the index and the copy (0 or 1) of all units but the one at ``at``."""

    def step(state: Column, j: Column) -> Column:
        mine, other = F.get(units, state["at"]), F.get(units, j)
        p, q, ratio = state["p"], other["p"], other["size"] / mine["size"]
        up, down = F.least(1 - p, q * ratio), F.least(p, (1 - q) * ratio)
        u = unit_interval(F.lit(seed), mine["key"], other["key"], j)
        rises = (up + down > 0) & (u * (up + down) < down)
        gave = F.when(rises, up).otherwise(-down)
        settled = F.when(rises, up >= 1 - p).otherwise(down >= p)  # mine is whole now

        def after(at: Column, left: Column, out: Column, copy: Column) -> Column:
            return F.struct(
                at.cast("int").alias("at"),
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"),
                F.concat(
                    state["done"], F.array(F.struct(out.cast("int").alias("i"), copy.cast("int").alias("copy")))
                ).alias("done"),
            )

        return F.when(settled, after(j, q - gave / ratio, state["at"], F.when(rises, 1).otherwise(0))).otherwise(
            after(state["at"], p + gave, j, F.when(rises, 0).otherwise(1))
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.get(units, F.lit(0))["p"].alias("p"),
        F.array().cast("array<struct<i:int,copy:int>>").alias("done"),
    )
    rest = F.when(F.size(units) > 1, F.sequence(F.lit(1), F.size(units) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, step)


def round_copies(units: DataFrame, seed: int = 7) -> DataFrame:
    """``row, copy`` for units ``source, n_docs, size, p, key, row`` with 0 < p < 1."""
    blocks = F.ceil(F.col("n_docs") / BLOCK)
    current = units.select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), "key"), blocks).alias("block"),
        blocks.alias("blocks"),
        F.struct(F.col("size").cast("double").alias("size"), "key", "p", "row").alias("unit"),
    )
    rounded = None
    level = 0
    while True:
        grouped = current.groupBy("source", "block", "blocks").agg(F.sort_array(F.collect_list("unit"), False).alias("units"))
        folded = cut(grouped.withColumn("fold", _fold(F.col("units"), seed + level)))
        decided = folded.select("units", F.explode("fold.done").alias("d")).select(
            F.get("units", F.col("d.i"))["row"].alias("row"), F.col("d.copy").alias("copy")
        )
        rounded = decided if rounded is None else rounded.unionByName(decided)
        left = F.get("units", F.col("fold.at"))
        residue = F.struct(left["size"].alias("size"), left["key"].alias("key"), F.col("fold.p").alias("p"), left["row"].alias("row"))
        largest = folded.agg(F.max("blocks")).first()[0] or 1
        current = folded.select(
            "source",
            F.floor(F.col("block") / BLOCK).alias("block"),
            F.ceil(F.col("blocks") / BLOCK).alias("blocks"),
            residue.alias("unit"),
        )
        level += 1
        if largest <= 1:
            break
    # one fraction is left of each source: the nearer whole number, so a short source is off by half a text at most
    last = current.select(F.col("unit.row").alias("row"), (F.col("unit.p") >= 0.5).cast("int").alias("copy"))
    return rounded.unionByName(last)


def counted_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, key, many``: each distinct row (id, source, text) with its number."""
    sized = documents.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
    )
    return sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("many"))


def shares(documents: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """Each distinct row with ``sure`` copies for each of its ``many`` rows and one more for
    ``raised`` of them."""
    counted = cut(counted_rows(documents))
    targets = cut(source_targets(counted, weights, most))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(share)
    share = F.when(F.abs(share - near) < WHOLE, near).otherwise(share)
    wanted = salted_lookup(counted, targets, ["source"], F.col("key")).withColumn("share", share)
    # a text without words has no size to share: each row is there once
    filled = F.col("size") > 0
    wanted = wanted.withColumn("sure", F.when(filled, F.floor("share")).otherwise(F.lit(1)).cast("int"))
    part = F.when(filled, F.col("share") - F.floor("share")).otherwise(0.0) * F.col("many")
    part = F.when(F.abs(part - F.round(part)) < WHOLE, F.round(part)).otherwise(part)
    wanted = wanted.withColumn("raised", F.floor(part).cast("bigint")).withColumn("p", part - F.floor(part))
    result = ["doc_id", "key", "size", "source_size", "target", "many", "sure"]
    units = wanted.where("p > 0").withColumn("row", F.struct(*result, "raised"))
    rounded = round_copies(units, seed).select(
        *[F.col(f"row.{c}").alias(c) for c in result], (F.col("row.raised") + F.col("copy")).alias("raised")
    )
    return wanted.where("p = 0").select(*result, "raised").unionByName(rounded)


def written_out(counted: DataFrame, many: Column) -> DataFrame:
    """Each row ``many`` times, with its number from 0 in ``nth``; above ``CHUNK`` by several tasks."""
    total = counted.withColumn("_many", many.cast("bigint")).where("_many > 0")
    few = total.where(F.col("_many") <= CHUNK).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_many") - 1)))
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_many") - 1, F.lit(CHUNK).cast("bigint"))).alias("_begin")
    chunks = total.where(F.col("_many") > CHUNK).select("*", begins).repartition("_begin", "_many")
    ends = F.least(F.col("_begin") + CHUNK, F.col("_many")) - 1
    lots = chunks.withColumn("nth", F.explode(F.sequence(F.col("_begin"), ends))).drop("_begin")
    return few.unionByName(lots).drop("_many")


def mix(documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, seed: int = 7) -> DataFrame:
    """``doc_id, key, size, source_size, target, copies`` for each row of ``documents``
    (``doc_id, text, source``). ``key`` is a hash of the row; equal rows share it."""
    every = written_out(cut(shares(documents, weights, most, seed)), F.col("many"))
    copies = F.col("sure") + (F.col("nth") < F.col("raised")).cast("int")
    return every.select("doc_id", "key", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_documents(
    documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, seed: int = 7
) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it.

    A text without words has no size to share; it stays once. Rows equal in id, source
    and text share their copies evenly. All columns stay, whatever their names.
    """
    plan = cut(shares(documents, weights, most, seed)).select(
        F.col("doc_id").alias("_doc"), "key", "many", (F.col("many") * F.col("sure") + F.col("raised")).alias("copies")
    )
    packed = documents.select(
        F.struct("*").alias("row"), F.xxhash64("doc_id", "source", "text").alias("of"), F.col("doc_id").alias("id")
    )
    same = (F.col("of") == F.col("key")) & F.col("id").eqNullSafe(F.col("_doc"))
    single = packed.join(plan.where("many = 1 AND copies > 0"), same)
    # repeated rows are counted before they move; the few kinds of row that share a key share its
    # copies by running shares of their numbers
    kinds = packed.join(plan.where("many > 1 AND copies > 0"), same, "left_semi").groupBy("row", "of", "id").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("id", "of").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = kinds.withColumn("held_before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    until = lambda held: F.expr(f"(copies * ({held})) div many")
    repeated = ranked.join(plan, same).withColumn("copies", until("held_before + held") - until("held_before"))
    kept = written_out(single.select("row", "copies").unionByName(repeated.select("row", "copies")), F.col("copies"))
    return kept.select("row.*")
