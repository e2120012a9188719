"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18. The binary Golay code
puts every 23-bit word within 3 bits of exactly one codeword. A segment's keys are the
indices of the codewords that it or a one-bit neighbour decodes to, 1 to 6 of them: two
segments that differ in at most 2 bits meet in a neighbour of both and share a key.

Pigeonhole: of at most 4 differing bits, no two segments can have 3 each, so two of the
three segments share a key. The join key is such a pair (24 bits). For very many
fingerprints ``wide`` keys are stricter: either all three segments have at most 2 errors
(three indices, 36 bits), or one has 3 or more and the others at most 1 together (one
segment as it is and one index, 30 to 35 bits). Both find every pair; all pairs met are
verified by counting differing bits.

Several fingerprints of a text, each under its own seed, make a longer one: every one
of them gives keys, and a pair is verified by the differing bits of all together.

Links are sought between distinct fingerprints only, and a bucket gives a spanning
forest of its links, so copies never become pairs.

``keep_one`` is the same search as a filter: one row of each component stays.

Defined results: null and blank texts have fingerprint 0 and link like any other; texts
of fewer words than a shingle are one shingle; repeated rows are equal fingerprints;
null ids are never a component's name unless it has no other; an empty table gives an
empty result; further columns are ignored (``keep_one`` returns them all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.key_filter import marked
from ..session import cut
from .components import components

SHINGLE = 4
DISTANCE = 4  # the pigeonhole above holds for 4
SEEDS = (42,)
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # shift, width
# Fingerprints with more than a part in so many of all rows do not meet their rows by shuffle.
FREQUENT = 2000
# Above so many distinct fingerprints the wide keys keep buckets short.
WIDE_FROM = 1 << 30

# Members of a bucket from which on pairs are not all compared.
CROWD = 512

# Fixed value: generator of the binary (23, 12) Golay code.
GOLAY = 0b110001110101
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(
    text: bytes | None, shingle: int = SHINGLE, seeds: tuple[int, ...] = SEEDS, even: bool = False
) -> list[int]:
    """The 64-bit SimHash of a whole text under each seed. ``even`` lets the smallest
    hash decide the bits that just half of the shingles set; else they are 0, and texts
    of few shingles come near the fingerprint of none."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return [0] * len(seeds)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(found) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    out = []
    for seed in seeds:
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        twice = 2 * bits.sum(axis=0, dtype=np.int64)
        majority = twice > len(starts)
        if even:
            majority |= (twice == len(starts)) & bits[hashes.argmin()].astype(bool)
        out.append(int(np.packbits(majority, bitorder="little").view(np.uint64)[0]))
    return out


def columns_of(seeds: tuple[int, ...]) -> list[str]:
    """Names of the fingerprints: fp, fp1, ..."""
    return ["fp", *[f"fp{i}" for i in range(1, len(seeds))]]


def fingerprints(
    documents: DataFrame,
    keys: dict[str, Column],
    shingle: int = SHINGLE,
    seeds: tuple[int, ...] = SEEDS,
    even: bool = False,
) -> DataFrame:
    """The columns ``keys`` (name -> expression) and the fingerprints (bigint) of each row of ``documents``."""
    source = documents.select(*[c.alias(name) for name, c in keys.items()], F.col("text").cast("binary").alias("_text"))
    prints = columns_of(seeds)
    schema = source.drop("_text").withColumns({name: F.lit(0).cast("bigint") for name in prints}).schema
    names = list(keys)  # columns themselves cannot travel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seeds, even) for t in batch.column("_text")]
            values = np.array(found, np.uint64).reshape(-1, len(seeds)).view(np.int64)
            columns = [batch.column(name) for name in names] + [pa.array(values[:, i]) for i in range(len(seeds))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *prints])

    return source.mapInArrow(run, schema)


@cache
def _decoder() -> np.ndarray:
    """Index of the nearest codeword for each 23-bit word."""
    unit = []
    for bit in range(23):
        word = 1 << bit
        for high in range(22, 10, -1):
            if word >> high & 1:
                word ^= GOLAY << (high - 11)
        unit.append(word)
    patterns = [sum(1 << b for b in chosen) for n in range(4) for chosen in combinations(range(23), n)]
    error = np.zeros(2048, np.uint32)
    for pattern in patterns:
        syndrome = 0
        for bit in range(23):
            syndrome ^= unit[bit] * (pattern >> bit & 1)
        error[syndrome] = pattern
    syndromes = np.zeros(1, np.uint16)
    for bit in range(23):
        syndromes = np.concatenate([syndromes, syndromes ^ np.uint16(unit[bit])])
    return ((np.arange(1 << 23, dtype=np.uint32) ^ error[syndromes]) >> 11).astype(np.uint16)


def segment_keys(values: np.ndarray, width: int) -> np.ndarray:
    """Up to 6 codeword indices of each value, filled up with -1."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    near = np.sort(_decoder()[values[:, None] ^ flips].astype(np.int64), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = 1 << 20
    near = np.sort(near, axis=1)[:, :6]
    return np.where(near < 1 << 20, near, -1)


def bucket_keys(prints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: (row, key) with each pair once."""
    parts = [(prints >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1) for shift, width in SEGMENTS]
    near = [segment_keys(part, width) for part, (_, width) in zip(parts, SEGMENTS)]
    rows, keys = [], []

    def emit(kind: int, columns: list[np.ndarray], bits: list[int]) -> None:
        key = np.full((len(prints), 1), kind, np.int64)
        valid = np.ones((len(prints), 1), bool)
        for column, width in zip(columns, bits):
            key = (key[:, :, None] << width | np.maximum(column, 0)[:, None, :]).reshape(len(prints), -1)
            valid = (valid[:, :, None] & (column >= 0)[:, None, :]).reshape(len(prints), -1)
        row, _ = np.nonzero(valid)
        rows.append(row)
        keys.append(key[valid])

    if not wide:
        for kind, (i, j) in enumerate(combinations(range(3), 2)):
            emit(kind, [near[i], near[j]], [12, 12])
    else:
        emit(1, near, [12, 12, 12])
        for kind, (i, j) in enumerate([(i, j) for i in range(3) for j in range(3) if i != j], 2):
            emit(kind, [parts[i][:, None], near[j]], [23, 12])
    return np.concatenate(rows), np.concatenate(keys)


def crowd_links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one large bucket.

    A search from the middle of what is left: whoever is reached is no longer compared, so a
    cluster of near copies costs little more than its rows. Distances to the middle are
    worked out once; two rows whose distances to it differ by more than ``distance`` cannot
    be close, which keeps clusters apart without comparing them.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(prints))
    while len(left):
        bits = np.unpackbits(np.ascontiguousarray(prints[left]).view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left), bitorder="little").view(np.uint64)
        hub = int(np.bitwise_count(prints[left] ^ middle).sum(axis=1, dtype=np.int64).argmin())
        apart = np.bitwise_count(prints[left] ^ prints[left[hub]]).sum(axis=1, dtype=np.int64)
        # by distance to the hub, so those that may be close to a row stand together
        order = np.argsort(apart, kind="stable")
        order = order[order != hub]
        reached = [(0, np.array([left[hub]]))]
        left, apart = left[order], apart[order]
        while reached and len(left):
            far, rows = reached.pop(0)
            if len(rows) > 64:
                reached.insert(0, (far, rows[64:]))
                rows = rows[:64]
            low, high = np.searchsorted(apart, [far - distance, far + distance + 1])
            near = prints[left[low:high]]
            close = np.bitwise_count(prints[rows][:, None, :] ^ near[None, :, :]).sum(axis=2, dtype=np.int64) <= distance
            met = np.flatnonzero(close.any(axis=0))
            if len(met):
                links += zip(rows[close[:, met].argmax(axis=0)].tolist(), left[low + met].tolist())
                for value in np.unique(apart[low + met]).tolist():
                    reached.append((value, left[low + met][apart[low + met] == value]))
                left, apart = np.delete(left, low + met), np.delete(apart, low + met)
    return links


def bucket_links(key: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """Spanning forest of the links in each bucket; rows (one column a fingerprint) are sorted by key."""
    _, starts, sizes = np.unique(key, return_index=True, return_counts=True)
    found = [np.empty((0, 2), np.int64)]
    for start, size in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist()):
        inside = crowd_links(prints[start : start + size], distance)
        found.append(np.array(inside, np.int64).reshape(-1, 2) + start)
    few = np.flatnonzero(np.repeat(sizes <= CROWD, sizes))
    found.append(few[_pair_links(key[few], prints[few], distance)])
    return np.concatenate(found)


def _pair_links(key: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """The same for small buckets, all at once: each row with the next, the second next, and so on."""
    label = np.arange(len(key))
    links = []
    at, lag = np.arange(len(key)), 0
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        differ = np.bitwise_count(prints[at] ^ prints[at + lag]).sum(axis=1, dtype=np.int64)
        close = at[differ <= distance]
        close = close[label[close] != label[close + lag]]
        for i in close.tolist():
            a, b = i, i + lag
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                links.append((i, i + lag))
        if len(close):
            while not np.array_equal(label, label[label]):
                label = label[label]
    return np.array(links, np.int64).reshape(-1, 2)


def links(distinct: DataFrame, prints: list[str], distance: int = DISTANCE, wide: bool = False) -> DataFrame:
    """Edges ``a, b`` between ``node`` (bigint) of distinct fingerprints that connect all met within ``distance``."""
    many = len(prints)
    fields = ", ".join(f"{name} bigint" for name in ("node", *prints))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        """Node and fingerprints as unsigned numbers."""
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("node", *prints)]
        return np.stack(columns, axis=1).view(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = matrix(batch)
            for start in range(0, len(every), 4096):
                part = every[start : start + 4096]
                for i in range(many):
                    rows, keys = bucket_keys(np.ascontiguousarray(part[:, 1 + i]), wide)
                    chosen = part[rows].view(np.int64)
                    columns = [pa.array(keys * many + i)] + [pa.array(chosen[:, c]) for c in range(1 + many)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "node", *prints])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = np.empty(0, np.int64), np.empty((0, 1 + many), np.uint64)

        def found(until: int) -> pa.RecordBatch:
            pairs = bucket_links(key[:until], held[:until, 1:], distance)
            ends = [pa.array(held[pairs[:, side], 0].view(np.int64)) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            held = np.concatenate([held, matrix(batch)])
            if len(key) >= 1 << 16 and key[0] != key[-1]:
                until = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                yield found(until)
                key, held = key[until:], held[until:]
        if len(key):
            yield found(len(key))

    dealt = distinct.select("node", *prints).mapInArrow(deal, f"key bigint, {fields}")
    met = dealt.repartition("key").sortWithinPartitions("key", *prints).mapInArrow(meet, "a bigint, b bigint")
    return met.distinct()


def near_duplicates(
    documents: DataFrame,
    shingle: int = SHINGLE,
    seeds: tuple[int, ...] = SEEDS,
    distance: int = DISTANCE,
    even: bool = False,
    wide: bool | None = None,
) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, keeper`` for each row of ``documents``
    (``doc_id, text``). ``keeper`` marks the smallest (doc_id, text_hash) of a component."""
    prints = columns_of(seeds)
    printed = cut(
        fingerprints(documents, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")}, shingle, seeds, even)
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    counted = printed.groupBy(*prints).agg(first.alias("first"), F.count(F.lit(1)).alias("rows"))
    # numbered once: the table is written with its numbers
    distinct = cut(counted.withColumn("node", F.monotonically_increasing_id()))
    if wide is None:
        wide = distinct.count() > WIDE_FROM
    edges = cut(links(distinct, prints, distance, wide))
    grouped = cut(components(edges, "a", "b"))
    of_root = distinct.join(grouped, "node").groupBy("root").agg(F.min("first").alias("least"))
    of_print = grouped.join(of_root, "root").select("node", "least")
    named = distinct.join(of_print, "node", "left").select(*prints, "rows", F.coalesce("least", "first").alias("least"))
    named = cut(named)
    # fewer than FREQUENT fingerprints can hold so large a share of the rows; they are sent to all
    share = (named.agg(F.sum("rows")).first()[0] or 0) / FREQUENT
    frequent = F.broadcast(named.where(F.col("rows") > share).drop("rows"))
    rare = named.where(F.col("rows") <= share).drop("rows")
    others = printed.join(frequent.select(*prints), prints, "left_anti").join(rare, prints)
    together = printed.join(frequent, prints).unionByName(others)
    keeper = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash"))
    return together.select(
        "doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), keeper.alias("keeper")
    )


def keep_one(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``documents`` that stay: the smallest of each component, once.

    Rows are found again by id and text hash. A bitmap of those that go, or are repeated,
    lets nearly all others pass at once; what it marks is joined, at every size by shuffle, and
    repeated rows are combined before they move.
    """
    found = near_duplicates(documents, shingle, distance=distance)
    counted = found.groupBy("doc_id", "text_hash").agg(F.max("keeper").alias("keeper"), F.count(F.lit(1)).alias("rows"))
    others = counted.where("NOT keeper OR rows > 1")
    others = cut(others.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("of"), "keeper", F.xxhash64("doc_id", "text_hash").alias("both")))
    packed = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    packed = marked(packed.withColumn("both", F.xxhash64("row_id", "row_hash")), others.select("both"), "both", others.count(), "listed").drop("both")
    listed, keys = packed.where("listed"), others.hint("merge")
    same = listed["row_id"].eqNullSafe(keys["id"]) & (listed["row_hash"] == keys["of"])
    single = packed.where("NOT listed").select("row").unionByName(listed.join(keys, same, "left_anti").select("row"))
    repeated = listed.join(keys.where("keeper"), same, "left_semi").groupBy("row_id", "row_hash")
    once = repeated.agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.unionByName(once).select("row.*")
