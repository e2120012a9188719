"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

The index is cut by documents: a shard holds the posting lists of some megabytes of text
and the lengths of its documents, so a word that stands in every document is as many lists
as there are shards and no task holds more than a shard. A search asks each shard for the
best documents of every query and merges them; counts of documents and words are taken
over the whole index first, so scores do not depend on how it is cut.

In a shard, the short posting lists of a query are summed into accumulators, term by
term. From then on they are one list with one bounded value a document, which takes part
in document-at-a-time scoring together with the long lists. That goes through the shard
in blocks of documents. A block is skipped if its bound, the sum of the block maxima of
all lists, is below the k-th best score so far; the k-th largest accumulator is such a
score from the start. Inside a block the lists are added from the highest bound on, and
once the rest cannot lift a new document over the k-th best score, they are only
looked up for the documents that still can reach it.

Queries come in blocks of a bounded number of (query, term) pairs, so what is sent to the
executors does not grow with them.

Defined results: a null text or one without a term is in no count and never found; a
query without a term finds nothing; terms of weight 0 add nothing; repeated rows (of
documents or queries) are ranked each by itself; equal scores rank by ascending id, null
ids last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import with_order_number
from ..session import cut
from .common import lower_ascii

# Fixed value: a term is a run of letters and digits of ASCII and of anything beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
# Text and documents of a shard: it ends with the document that reaches one of them.
SHARD_BYTES, SHARD_DOCUMENTS = 16 << 20, 1 << 15
# A list is short if it holds at most one of so many documents of its shard.
SHORT = 16
BLOCK = 512  # documents whose bound is known
PAIRS = 50_000  # (query, term) pairs sent to the executors at once, about 60 bytes each

# bytes of a lower-cased text; all that is outside of terms becomes a space
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
INDEX = "shard bigint, term string, many int, total bigint, docs array<int>, tfs array<int>, ids array<bigint>, lengths array<bigint>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def shard_rows(number: int, ids: list[int | None], texts: list[bytes | None]) -> pa.RecordBatch:
    """The index rows of one shard: a posting list per term, and one row (term null) with
    the ids and lengths of its documents."""
    lengths, seen, frequency, sizes = [], [], [], []
    for text in texts:
        found = terms_of(text)
        counts = Counter(found)
        lengths.append(len(found))
        sizes.append(len(counts))
        seen.extend(counts)
        frequency.extend(counts.values())
    coded = pa.array(seen, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.cast(pa.string())
    order = np.argsort(codes, kind="stable")
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[order]
    tfs = np.array(frequency, np.int32)[order]
    many = np.bincount(codes, minlength=len(names))
    # a list of the documents' row stands behind those of the terms
    ends = np.append(np.cumsum(many), many.sum())
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    totals = np.add.reduceat(tfs, ends[:-1] - many).astype(np.int64) if len(names) else np.empty(0, np.int64)
    nothing = pa.array([None] * len(names), pa.list_(pa.int64()))
    held = sum(1 for n in lengths if n)
    columns = [
        pa.array(np.full(len(names) + 1, number)),
        pa.concat_arrays([names, pa.array([None], pa.string())]),
        pa.array(np.append(many, held).astype(np.int32)),
        pa.array(np.append(totals, sum(lengths)).astype(np.int64)),
        pa.ListArray.from_arrays(offsets, pa.array(docs)),
        pa.ListArray.from_arrays(offsets, pa.array(tfs)),
        pa.concat_arrays([nothing, pa.array([ids], pa.list_(pa.int64()))]),
        pa.concat_arrays([nothing, pa.array([lengths], pa.list_(pa.int64()))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "many", "total", "docs", "tfs", "ids", "lengths"])


def build_index(documents: DataFrame) -> DataFrame:
    """The index of ``documents`` (``doc_id, text``) over all terms of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCUMENTS:
                    yield shard_rows(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield shard_rows(number, ids, texts)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, INDEX)


@dataclass
class Lists:
    """The posting lists of a shard for some terms: documents, value of each (without the
    term's weight), and the maximum of each block."""

    docs: dict[str, np.ndarray]
    values: dict[str, np.ndarray]
    maxima: dict[str, np.ndarray]
    many: int

    @classmethod
    def of(cls, table: pa.Table, documents: int, words: int) -> Lists:
        names = table["term"].to_pylist()
        head = names.index(None)
        lengths = np.array(table["lengths"][head].as_py(), np.int64)
        norm = 20 * (50 + (50 * lengths * documents) // max(words, 1))
        out = cls({}, {}, {}, len(lengths))
        blocks = -(-len(lengths) // BLOCK)
        for name, docs, tfs in zip(names, table["docs"], table["tfs"]):
            if name is None:
                continue
            docs = docs.values.to_numpy(zero_copy_only=False)
            tf = tfs.values.to_numpy(zero_copy_only=False).astype(np.int64)
            value = (1_000_000_000 * tf) // (1000 * tf + norm[docs])
            out.docs[name], out.values[name] = docs, value
            out.maxima[name] = block_maxima(docs, value, blocks)
        return out


def block_maxima(docs: np.ndarray, values: np.ndarray, blocks: int) -> np.ndarray:
    out = np.zeros(blocks, np.int64)
    if len(docs):
        at = docs // BLOCK
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[starts]] = np.maximum.reduceat(values, starts)
    return out


def best_of_shard(lists: Lists, query: list[tuple[str, int]], best: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard, ascending) and scores of all that can be among the
    ``best``: every one above the last of them, and those equal to it."""
    held = sorted(((t, w) for t, w in query if w > 0 and t in lists.docs), key=lambda tw: len(lists.docs[tw[0]]))
    few = [tw for tw in held if len(lists.docs[tw[0]]) * short <= lists.many]
    blocks = -(-lists.many // BLOCK)
    # term at a time: the short lists become one
    summed = np.zeros(lists.many, np.int64)
    for term, weight in few:
        summed[lists.docs[term]] += weight * lists.values[term]
    short_docs = np.flatnonzero(summed)
    short_scores = summed[short_docs]
    entries = [(short_docs, short_scores, block_maxima(short_docs, short_scores, blocks), 1)] if len(short_docs) else []
    entries += [(lists.docs[t], lists.values[t], lists.maxima[t], w) for t, w in held[len(few) :]]
    if not entries:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    limit = int(np.partition(short_scores, -best)[-best]) if len(short_scores) >= best else 1
    # document at a time, block by block
    maxima = np.stack([m * w for _, _, m, w in entries])
    bound = maxima.sum(axis=0)
    cuts = [np.searchsorted(e[0], np.arange(blocks + 1) * BLOCK) for e in entries]
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for block in range(blocks):
        if bound[block] < limit:
            continue
        score, base, rest = np.zeros(BLOCK, np.int64), block * BLOCK, int(bound[block])
        reach = None  # once only known documents can reach the limit: those
        for i in np.argsort(-maxima[:, block], kind="stable").tolist():
            part = slice(cuts[i][block], cuts[i][block + 1])
            if reach is None and rest < limit:
                reach = np.flatnonzero(score + rest >= limit)
            if part.start < part.stop:
                listed, values, _, weight = entries[i]
                if reach is None:
                    score[listed[part] - base] += weight * values[part]
                else:
                    reach = reach[score[reach] + rest >= limit]
                    at = np.searchsorted(listed[part], reach + base)
                    at[at == part.stop - part.start] = 0
                    hit = listed[part][at] == reach + base
                    score[reach[hit]] += weight * values[part][at[hit]]
            rest -= int(maxima[i, block])
        found = np.flatnonzero(score >= limit) if reach is None else reach[score[reach] >= limit]
        docs = np.concatenate([docs, found + base])
        scores = np.concatenate([scores, score[found]])
        if len(scores) > best:
            limit = max(limit, int(np.partition(scores, -best)[-best]))
            docs, scores = docs[scores >= limit], scores[scores >= limit]
    return docs, scores


def _searcher(queries: dict[int, list[tuple[str, int]]], documents: int, words: int, best: int):
    """What a shard does: its best documents for each of ``queries``."""

    def run(table: pa.Table) -> pa.Table:
        lists = Lists.of(table, documents, words)
        ids = next(i for i in table["ids"].to_pylist() if i is not None)
        out: tuple[list, list, list] = [], [], []
        for item, query in queries.items():
            docs, scores = best_of_shard(lists, query, best)
            rows = sorted(
                ((-s, ids[d] is None, ids[d] or 0, ids[d]) for d, s in zip(docs.tolist(), scores.tolist())),
                key=lambda r: r[:3],
            )[:best]
            out[0].extend([item] * len(rows))
            out[1].extend(r[3] for r in rows)
            out[2].extend(-r[0] for r in rows)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, best: int = BEST, pairs: int = PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each row of ``queries``
    (``item_id, text``). ``index`` is read several times: a written table."""
    totals = index.where(F.col("term").isNull()).agg(F.sum("many"), F.sum("total")).first()
    documents, words = totals[0] or 0, totals[1] or 0
    asked = with_order_number(queries.select("item_id", "text"), [F.col("item_id"), F.xxhash64("text")], "item")
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    listed = asked.select("item", "item_id", F.explode(terms).alias("term"))
    counted = index.where(F.col("term").isNotNull()).select("term", "many")
    counted = counted.join(listed.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("many").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = listed.join(counted, "term").select("item", "item_id", "term", weight.alias("weight"))
    # a block of queries begins after each so many pairs
    numbered = with_order_number(weighted, ["item", "term"], "pair")
    begins = numbered.groupBy("item").agg((F.min("pair").cast("bigint")).alias("begin"))
    blocked = cut(numbered.join(begins, "item").withColumn("block", F.expr(f"begin div {pairs}")).drop("begin", "pair"))
    last = blocked.agg(F.max("block")).first()[0]
    schema = "item bigint, doc_id bigint, score bigint"
    found = None
    for block in range(0 if last is None else last + 1):
        mine = blocked.where(F.col("block") == block)
        by_item: dict[int, list[tuple[str, int]]] = {}
        for r in mine.select("item", "term", "weight").collect():  # ``pairs`` and one query more at most
            by_item.setdefault(r["item"], []).append((r["term"], r["weight"]))
        wanted = F.broadcast(mine.select("term").distinct())
        some = index.where(F.col("term").isNull()).unionByName(index.join(wanted, "term", "left_semi"))

        part = some.groupBy("shard").applyInArrow(_searcher(by_item, documents, words, best), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = blocked.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
