"""Ranked search: whole rankings against a plain scorer, shards against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkmirror.llm import search
from inkmirror.session import cut


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranking(documents, queries, best=50):
    """``{(item_id, rank): (doc_id, score)}`` by scoring every document."""
    counts = [(i, Counter(terms(t))) for i, t in documents]
    counts = [(i, c) for i, c in counts if c]
    many, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in queries:
        scored = []
        for doc_id, c in counts:
            size = sum(c.values())
            m = 50 + 50 * size * many // words
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:best], 1):
            out[(item, rank)] = (doc_id, -score)
    return out


def found(frame):
    rows = frame.collect()
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, many):
    """Few words stand nearly everywhere, many in a document or two; some texts are equal."""
    draw = random.Random(seed)
    rows = []
    for i in range(many):
        text = " ".join(f"w{int(draw.paretovariate(0.6)) % 500}" for _ in range(draw.randint(1, 60)))
        rows.append((i, draw.choice(rows)[1] if i % 7 == 3 else text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bytes, pairs", [(1 << 20, 50_000), (3000, 9)])
def test_against_scoring_everything(spark, monkeypatch, shard_bytes, pairs):
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    documents, draw = corpus(1, 900), random.Random(2)
    queries = [(i, " ".join(f"W{draw.randrange(60)}" for _ in range(draw.randint(1, 20)))) for i in range(12)]
    index = cut(search.build_index(spark.createDataFrame(documents, "doc_id bigint, text string").repartition(3)))
    got = search.search(index, spark.createDataFrame(queries, "item_id bigint, text string"), pairs=pairs)
    assert found(got) == ranking(documents, queries)


@pytest.mark.parametrize("block", [8, 64])
@pytest.mark.parametrize("short", [1, 16, 10_000])
def test_a_shard_against_plain_sums(monkeypatch, block, short):
    """Every mix of accumulators and long lists, ties included, skipping or not."""
    monkeypatch.setattr(search, "BLOCK", block)
    for seed in range(6):
        texts = [t.encode() for _, t in corpus(seed, 700)]
        lists = search.Lists.of(pa.Table.from_batches([search.shard_rows(0, list(range(len(texts))), texts)]), 700, 20_000)
        draw = random.Random(seed)
        for best in (1, 10, 50):
            query = [(f"w{i}", draw.randint(0, 4000)) for i in draw.sample(range(80), 12)]
            plain = np.zeros(len(texts), np.int64)
            for term, weight in query:
                if term in lists.docs:
                    plain[lists.docs[term]] += weight * lists.values[term]
            docs, scores = search.best_of_shard(lists, query, best, short)
            last = sorted(plain.tolist(), reverse=True)[best - 1]
            assert docs.tolist() == np.flatnonzero(plain >= max(last, 1)).tolist()
            assert scores.tolist() == plain[docs].tolist()


def test_blocks_are_skipped(monkeypatch):
    """Blocks whose bound is too low are not scored."""
    monkeypatch.setattr(search, "BLOCK", 10)
    texts = [b"rare common"] + [b"common " * 3 + b"filler " * 50] * 500
    lists = search.Lists.of(pa.Table.from_batches([search.shard_rows(0, list(range(501)), texts)]), 501, 26_000)
    scored = []
    plain = np.flatnonzero
    monkeypatch.setattr(search.np, "flatnonzero", lambda a: scored.append(len(a)) or plain(a))
    docs, _ = search.best_of_shard(lists, [("rare", 9000), ("common", 1)], 1)
    assert docs.tolist() == [0] and scored.count(10) == 1


def test_edge_rows(spark, edge_documents, no_documents):
    index = cut(search.build_index(edge_documents))
    queries = [(1, "The HOUSE and the hund"), (2, None), (3, ""), (4, "1234"), (5, "straße x"), (6, "the house"), (None, "tisch")]
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    documents = [(r["doc_id"], r["text"]) for r in edge_documents.collect()]
    want = ranking(documents, queries)
    assert found(search.search(index, asked)) == want and {k[0] for k in want} == {1, 4, 5, 6, None}
    assert search.search(index, asked.limit(0)).count() == 0
    assert search.search(cut(search.build_index(no_documents)), asked).count() == 0
    twice = search.search(index, asked.where("item_id = 4").union(asked.where("item_id = 4")))
    assert sorted(r["rank"] for r in twice.collect()) == [1, 1]
