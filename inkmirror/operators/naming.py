"""Conflict-free document paths.

In run order a document takes ``base``, else ``base-<first 8 of its id>``, else
``base-<id>``; a third name that is taken as well is a clash. All candidates
share one priority, the run order, so the outcome equals proposals in rounds:
everyone proposes the next name, each path keeps its earliest proposer, and the
others move on. Rounds replace the sequential loop, so a folder of any size is
spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import id_prefix, join_path
from ..session import cut
from .joins import lookup

CANDIDATES = 3


def candidate_name(level: Column, base: Column, doc_id: Column) -> Column:
    return (
        F.when(level == 0, base)
        .when(level == 1, F.concat(base, F.lit("-"), id_prefix(doc_id)))
        .otherwise(F.concat(base, F.lit("-"), doc_id))
    )


def document_path(parent: Column, name: Column) -> Column:
    return join_path(parent, F.concat(name, F.lit(".md")))


def claim_paths(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Resolve ``rows`` (seq, doc_id, parent, base; seq unique) to ``name, path, clash``.

    ``taken`` holds paths of documents that exist already. A round finds the
    earliest proposer of each path with a map-side combined minimum and joins it
    back on ``seq``, which no two rows share, so neither step has a hot key. From
    the second round on only the moved rows and the holders they meet take part.
    """
    rows = rows.select("seq", "doc_id", "parent", "base")
    offers = rows.withColumn("level", F.lit(0))
    won: list[DataFrame] = []
    evicted: list[DataFrame] = []
    clashes: list[DataFrame] = []

    def named(of: DataFrame) -> DataFrame:
        """Name and path are worked out where they are needed and neither moved nor written."""
        named = of.withColumn("name", candidate_name(F.col("level"), F.col("base"), F.col("doc_id")))
        return named.withColumn("path", document_path(F.col("parent"), F.col("name")))

    def standing(of: DataFrame | None = None) -> DataFrame:
        """Holders, of all paths or of those in ``of``, which are few: only these are looked up."""
        held = reduce(DataFrame.unionByName, won)
        if of is not None:
            held = named(held).join(of, "path", "left_semi").drop("name", "path")
        return held.join(reduce(DataFrame.unionByName, evicted), ["seq", "level"], "left_anti") if evicted else held

    while True:
        contenders = offers.withColumn("held", F.lit(False))
        if won:
            contenders = contenders.unionByName(standing(named(offers).select("path").distinct()).withColumn("held", F.lit(True)))
        earliest = named(contenders).groupBy("path").agg(F.min("seq").alias("seq"))
        if taken is not None:
            earliest = earliest.join(taken.select("path"), "path", "left_anti")
        # a row proposes or holds one path in a round, so its number tells which it keeps
        keeps = earliest.select("seq", F.lit(True).alias("keeps"))
        judged = cut(contenders.join(keeps, "seq", "left").withColumn("keeps", F.coalesce("keeps", F.lit(False))))
        won.append(judged.where("keeps AND NOT held").drop("keeps", "held"))
        evicted.append(judged.where("NOT keeps AND held").select("seq", "level"))
        losers = judged.where("NOT keeps")
        clashes.append(losers.where(F.col("level") == CANDIDATES - 1).drop("keeps", "held"))
        movers = losers.where(F.col("level") < CANDIDATES - 1)
        if movers.isEmpty():
            break
        offers = movers.select("seq", "doc_id", "parent", "base", (F.col("level") + 1).alias("level"))

    resolved = standing().withColumn("clash", F.lit(False))
    failed = reduce(DataFrame.unionByName, clashes).withColumn("clash", F.lit(True))
    return named(resolved.unionByName(failed)).select("seq", "doc_id", "name", "path", "clash")


def name_seen_by(rows: DataFrame, claims: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Name that rows which claim nothing would be given at their place in the run.

    An original is stored under the name its document would get now; ``index_path``
    is the path the index holds for the document, which never counts as taken.
    """
    owners = claims.where(~F.col("clash")).select("path", F.col("seq").alias("owner_seq"))
    if taken is not None:
        owners = owners.unionByName(taken.select("path", F.lit(-1).cast("bigint").alias("owner_seq")))
        owners = owners.groupBy("path").agg(F.min("owner_seq").alias("owner_seq"))
    result = rows
    for level in (0, 1):
        path = document_path(F.col("parent"), candidate_name(F.lit(level), F.col("base"), F.col("doc_id")))
        named = owners.select(F.col("path").alias(f"_path{level}"), F.col("owner_seq").alias(f"_owner{level}"))
        result = result.withColumn(f"_path{level}", path).join(named, f"_path{level}", "left")

    def free(level: int) -> Column:
        owner = F.col(f"_owner{level}")
        mine = F.coalesce(F.col("index_path") == F.col(f"_path{level}"), F.lit(False))
        return owner.isNull() | (owner >= F.col("seq")) | mine

    level = F.when(free(0), 0).when(free(1), 1).otherwise(2)
    name = candidate_name(level, F.col("base"), F.col("doc_id"))
    return result.withColumn("name", name).drop("_path0", "_path1", "_owner0", "_owner1")


def path_owners(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidate paths (doc_id, path) with the index owner and whether it is the same document."""
    owners = index.select("path", F.col("doc_id").alias("owner_id"))
    return candidates.join(owners, "path", "left").withColumn(
        "owned", F.coalesce(F.col("owner_id") == F.col("doc_id"), F.lit(False))
    )


def with_files(rows: DataFrame, documents: DataFrame, path: str = "path") -> DataFrame:
    """Rows (``doc_id, path``) with ``there``: whether the document of that path still exists.
    ``documents`` is unique per path."""
    existing = documents.select(F.col("path").alias(path), F.lit(True).alias("there"))
    return lookup(rows, existing, path, "doc_id").withColumn("there", F.coalesce("there", F.lit(False)))


def write_targets(actions: DataFrame, documents: DataFrame) -> DataFrame:
    """``in_place`` for updates whose indexed document still exists.

    ``actions`` carries ``doc_id`` and ``index_path``; all other writes need a path of their
    own. Where the index was asked for its files (:func:`with_files`) before the decision,
    ``actions`` has ``there`` and is not moved.
    """
    known = actions if "there" in actions.columns else with_files(actions, documents, "index_path")
    in_place = (F.col("action") == "update") & F.coalesce("there", F.lit(False))
    return known.withColumn("in_place", in_place).drop("there")
