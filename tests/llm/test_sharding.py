"""k-d sharding: equal bytes, whole groups, gapless places; medians against sorting."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkmirror.llm import sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, many, copies=0, seed=4):
    draw = random.Random(seed)
    rows = []
    for i in range(many):
        source = "hot" if draw.random() < 0.4 else f"s{draw.randint(0, 9)}"
        text = "x" * 30 if i < copies else f"{i} " + "y" * draw.randint(0, 400)
        rows.append((i * 3, text, draw.choice(["en", "de", None]), source, 0))
    return spark.createDataFrame(rows, SCHEMA)


def gapless(rows):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    return all(sorted(v) == list(range(len(v))) for v in by_shard.values())


@pytest.mark.parametrize("copies", [0, 900])
def test_equal_bytes_and_whole_groups(spark, copies):
    docs = documents(spark, 3000, copies)
    rows = sharding.shard(docs, leaves=8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == 3000 and gapless(rows)
    load = Counter()
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(8))
    assert max(load.values()) < 1.02 * min(load.values())
    shards = defaultdict(set)
    for r in rows:
        if not copies or r["doc_id"] >= 3 * copies:
            shards[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_few_copies_stay_together(spark):
    docs = documents(spark, 2000)
    twice = docs.unionByName(docs.where("doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    rows = sharding.shard(twice, leaves=4).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert all(shard[i] == shard[i + 10_000_000] for i in shard if i + 10_000_000 in shard)


def test_medians_against_sorting(spark):
    draw = random.Random(1)
    rows = [(n, draw.choice([draw.randint(0, 1 << 50), 77]), draw.randint(1, 50)) for n in range(3) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "node int, key bigint, bytes bigint")
    got = sharding.weighted_medians(frame)
    for node in range(3):
        own = Counter()
        for n, key, size in rows:
            if n == node:
                own[key] += size
        half, total, best = sum(own.values()) / 2, 0, []
        for key in sorted(own):
            total += own[key]
            best.append((abs(total - half), key))
        below = sum(v for k, v in own.items() if k <= got[node])
        assert abs(below - half) == min(best)[0]


def test_target_bytes_sets_the_depth(spark):
    docs = documents(spark, 500)
    total = sum(len(r["text"].encode()) + 1 for r in docs.collect())
    rows = sharding.shard(docs, leaves=None, target_bytes=total // 3).collect()
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}


def test_edge_rows(spark, edge_documents, no_documents):
    rows = sharding.shard(edge_documents, leaves=8).collect()
    assert len(rows) == edge_documents.count() and gapless(rows)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (4, 5)} == {(1, 0)}
    assert sharding.shard(no_documents, leaves=8).count() == 0
