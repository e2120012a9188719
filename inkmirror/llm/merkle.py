"""Merkle manifest of a dataset, and octopus multiproofs of its rows.

Each row is a leaf: the SHA-256 of its encoded fields. The leaves of a group (a source)
stand in order and every 16 in a row become the hash of their concatenated hex digests,
level by level, until one node, the group's root, is left; the group roots in order form
one more tree, whose root names the dataset.

Proofs are made for whole leaf partitions, runs of 4096 leaves in global order. A
partition knows its leaves, so it can derive every inner node whose children it knows.
What it cannot derive are siblings outside: the union of their coordinates over all its
leaves, each once, is the octopus multiproof. It is fetched by one join, the shared inner
nodes are hashed once, and the proofs of single leaves are expanded from them in place.

Levels shrink by 16 each and all groups of a hash hold 16 rows at most, so a source with
a third of all rows is spread like any other. Nodes asked by many partitions are those
near the root; up to ``SENT_NODES`` of them (counted) are sent to all executors, the rest
are joined by coordinate, asked by few partitions each.

Defined results: a null field is ``-``, an empty one ``0:``; null sources and null ids
sort first; rows of one id are ordered by their leaf, equal rows are leaves of their own;
a group of one row is its own root; an empty table has no root and no rows; further
columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.scans import with_order_number
from ..session import cut
from .common import salted_lookup

BRANCH = 16
PARTITION = 4096  # leaves that one task proves together
SENT_NODES = 100_000  # nodes (about 100 bytes each) that may be sent to all executors
TOP = -1  # number of the tree over the groups
_HEX = 64  # characters of a digest


def encoded(value: Column) -> Column:
    """Length and value of a field as text; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: the given rows with ``tree, at`` (place in it), ``width`` (its leaves) and
    ``seq`` (place in all). ``nodes``: ``tree, level, at, width, hash``, the top tree under
    number -1. ``groups``: ``group, tree, rows, subroot``."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    many: int
    root: str | None


def levels(base: DataFrame) -> list[DataFrame]:
    """``tree, level, at, width, hash`` of each level above (and with) the one given."""
    out = [base.withColumn("level", F.lit(0)).select("tree", "level", "at", "width", "hash")]
    widest = base.agg(F.max("width")).first()[0] or 0
    while widest > 1:
        runs = out[-1].where("width > 1").groupBy("tree", "level", "width", F.expr(f"at div {BRANCH}").alias("run"))
        joined = runs.agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("members"))
        above = joined.select(
            "tree",
            (F.col("level") + 1).alias("level"),
            F.col("run").alias("at"),
            F.expr(f"(width + {BRANCH - 1}) div {BRANCH}").alias("width"),
            F.sha2(F.array_join("members.hash", "").cast("binary"), 256).alias("hash"),
        )
        out.append(cut(above))
        widest = -(-widest // BRANCH)
    return out


def build(rows: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of ``rows``, which have a column ``leaf``; within a ``group`` the leaves
    ascend by ``order``, then by themselves."""
    first = lambda c: F.col(c).asc_nulls_first()
    numbered = with_order_number(rows, [first(group), *[first(c) for c in order], F.col("leaf")])
    counted = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("start"))
    groups = cut(with_order_number(counted, [first(group)], "tree"))
    placed = salted_lookup(numbered, groups, [group], F.col("seq"), 16)
    leaves = cut(placed.select(*rows.columns, "seq", "tree", (F.col("seq") - F.col("start")).alias("at"), F.col("rows").alias("width")))
    trees = levels(leaves.select("tree", "at", "width", F.col("leaf").alias("hash")))
    subroots = cut(_together(trees).where("width = 1").select("tree", "hash"))
    many = groups.count()
    top = levels(
        subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(many).cast("bigint").alias("width"), "hash")
    )
    last = top[-1].first()
    described = groups.join(subroots, "tree").select(F.col(group).alias("group"), "tree", "rows", F.col("hash").alias("subroot"))
    return Manifest(leaves, _together(trees + top), described, many, last["hash"] if last else None)


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def floors(tree: np.ndarray, at: np.ndarray, width: np.ndarray, many: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``tree, level, width, places`` of the known leaves and of what they stand under, from
    the leaves of each tree up to the root of the top tree."""

    def climb(number: int, known: np.ndarray, wide: int):
        level = 0
        yield number, level, wide, known
        while wide > 1:
            known, wide, level = np.unique(known // BRANCH), -(-wide // BRANCH), level + 1
            yield number, level, wide, known

    order = np.lexsort((at, tree))
    tree, at, width = tree[order], at[order], width[order]
    trees, starts = np.unique(tree, return_index=True)
    for number, known, wide in zip(trees.tolist(), np.split(at, starts[1:]), width[starts].tolist()):
        yield from climb(number, np.unique(known), wide)
    yield from climb(TOP, trees, many)


def missing(tree: np.ndarray, at: np.ndarray, width: np.ndarray, many: int) -> list[tuple[int, int, int]]:
    """Coordinates (tree, level, at) that proofs of these leaves need and cannot derive."""
    out = []
    for number, level, wide, known in floors(tree, at, width, many):
        if wide > 1:
            members = (np.unique(known // BRANCH)[:, None] * BRANCH + np.arange(BRANCH)).ravel()
            outside = np.setdiff1d(members[members < wide], known, assume_unique=True)
            out += [(number, level, place) for place in outside.tolist()]
    return out


class Octopus:
    """The shared inner nodes of one leaf partition, derived from its leaves and what it fetched."""

    def __init__(self, tree, at, width, leaf, fetched: list[tuple[int, int, int, str]], many: int):
        hashes: dict[tuple[int, int], dict[int, str]] = {}
        for number, level, place, value in fetched:
            hashes.setdefault((number, level), {})[place] = value
        for number, place, value in zip(tree.tolist(), at.tolist(), leaf):
            hashes.setdefault((number, 0), {})[place] = value
        # children of a run in one text, by (tree, level, run), and the width of each floor
        self.runs: dict[tuple[int, int, int], str] = {}
        self.wide: dict[tuple[int, int], int] = {}
        self.above: dict[tuple[int, int, int], tuple[list, str]] = {}
        self.subroot: dict[int, str] = {}
        for number, level, wide, known in floors(tree, at, width, many):
            own = hashes[(number, level)]
            self.wide[(number, level)] = wide
            if wide == 1:
                if number != TOP:
                    self.subroot[number] = own[0]
                    hashes.setdefault((TOP, 0), {})[number] = own[0]
                continue
            upper = hashes.setdefault((number, level + 1), {})
            for run in np.unique(known // BRANCH).tolist():
                joined = "".join([own[i] for i in range(run * BRANCH, min(run * BRANCH + BRANCH, wide))])
                self.runs[(number, level, run)] = joined
                upper[run] = sha256(joined.encode()).hexdigest()

    def path(self, tree: int, level: int, at: int) -> tuple[list[tuple[str, int]], str]:
        """From a node to the root: each run with the node's place in it, and all siblings."""
        if self.wide[(tree, level)] == 1:
            return ([], "") if tree == TOP else self._held(TOP, 0, tree)
        run, offset = at // BRANCH, at % BRANCH * _HEX
        joined = self.runs[(tree, level, run)]
        steps, siblings = self._held(tree, level + 1, run)
        return [(joined, offset), *steps], joined[:offset] + joined[offset + _HEX :] + siblings

    def _held(self, tree: int, level: int, at: int):
        key = (tree, level, at)
        if key not in self.above:
            self.above[key] = self.path(tree, level, at)
        return self.above[key]


def fold(leaf: str, steps: list[tuple[str, int]]) -> str:
    """The root that a leaf gives with the siblings of a path."""
    for joined, offset in steps:
        leaf = sha256((joined[:offset] + leaf + joined[offset + _HEX :]).encode()).hexdigest()
    return leaf


def _sent(nodes: DataFrame) -> Column:
    """Whether a node stands on one of the floors near the root that hold few nodes in all."""
    counts = nodes.groupBy((F.col("tree") == TOP).alias("top"), "level").count().collect()
    total, chosen = 0, F.lit(False)
    for top, level, count in sorted(counts, key=lambda r: (r["top"], r["level"]), reverse=True):
        total += count
        if total > SENT_NODES:
            break
        chosen = chosen | (((F.col("tree") == TOP) == F.lit(top)) & (F.col("level") == level))
    return chosen


def prove(manifest: Manifest, asked: DataFrame, claimed: str, siblings: bool = False) -> DataFrame:
    """``asked`` (rows of ``manifest.leaves``, all or some) with ``subroot``, ``proof_sha256``
    (of all siblings up to the root) and ``folded_root``, which the hash in column ``claimed``
    gives in place of the leaf. ``siblings`` adds them as ``proof``, from the leaf to the root."""
    many = manifest.many
    parted = asked.withColumn("_part", F.expr(f"seq div {PARTITION}"))

    def ask(table: pa.Table) -> pa.Table:
        found = missing(*[table[c].to_numpy() for c in ("tree", "at", "width")], many)
        columns = [[table["_part"][0].as_py()] * len(found), *([f[i] for f in found] for i in range(3))]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["_part", "tree", "level", "at"])

    wanted = parted.select("_part", "tree", "at", "width").groupBy("_part").applyInArrow(
        ask, "_part bigint, tree bigint, level int, at bigint"
    )
    wanted = cut(wanted)
    nodes = manifest.nodes.select("tree", "level", "at", "hash")
    near = _sent(nodes)
    key = ["tree", "level", "at"]
    fetched = wanted.where(near).join(F.broadcast(nodes.where(near)), key).unionByName(
        wanted.where(~near).join(nodes.where(~near), key)
    )
    added = {"subroot": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()}
    fields = [*asked.schema.fields, *[StructField(name, StringType()) for name in added]]
    schema = StructType([*fields, StructField("proof", ArrayType(StringType()))] if siblings else fields)
    kept = asked.columns

    def expand(key, mine: pa.Table, other: pa.Table) -> pa.Table:
        tree, at, width = (mine[c].to_numpy() for c in ("tree", "at", "width"))
        rows = list(zip(*[other[c].to_pylist() for c in ("tree", "level", "at", "hash")]))
        octopus = Octopus(tree, at, width, mine["leaf"].to_pylist(), rows, many)
        out = {name: [] for name in added}
        proofs = []
        for number, place, claim in zip(tree.tolist(), at.tolist(), mine[claimed].to_pylist()):
            steps, beside = octopus.path(number, 0, place)
            out["subroot"].append(octopus.subroot[number])
            out["proof_sha256"].append(sha256(beside.encode()).hexdigest())
            out["folded_root"].append(fold(claim, steps))
            if siblings:
                proofs.append([beside[i : i + _HEX] for i in range(0, len(beside), _HEX)])
        table = mine.select(kept)
        for name, kind in added.items():
            table = table.append_column(name, pa.array(out[name], kind))
        return table.append_column("proof", pa.array(proofs, pa.list_(pa.string()))) if siblings else table

    return parted.groupBy("_part").cogroup(fetched.groupBy("_part")).applyInArrow(expand, schema)
