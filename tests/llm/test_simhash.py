"""SimHash: fingerprints and components against brute force; keys that meet."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkmirror.llm import simhash
from inkmirror.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, distance=4):
    """Smallest index reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def family(seed, many=260):
    """Fingerprints in chains and clusters of few differing bits."""
    draw = random.Random(seed)
    out = []
    while len(out) < many:
        value = draw.getrandbits(64)
        for _ in range(draw.randint(1, 25)):
            out.append(value)
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                value ^= 1 << bit
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_pairs_within_distance_share_a_key(wide):
    draw = random.Random(3)
    one = [draw.getrandbits(64) for _ in range(3000)]
    two = [v ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for v in one]
    keys = [simhash.bucket_keys(np.array(v, np.uint64), wide) for v in (one, two)]
    both = set(zip(*[k.tolist() for k in keys[0]])) & set(zip(*[k.tolist() for k in keys[1]]))
    assert {row for row, _ in both} == set(range(3000))


@pytest.mark.parametrize("wide", [False, True])
def test_components_against_all_pairs(spark, wide):
    prints = sorted(set(family(5)))
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "node bigint, fp bigint").repartition(4)
    found = components(simhash.links(frame, ["fp"], wide=wide), "a", "b").collect()
    root = {prints[r["node"]]: r["root"] for r in found}
    want = roots(prints)
    groups = {}
    for p, r in zip(prints, want):
        groups.setdefault(r, []).append(p)
    for members in groups.values():
        got = {root.get(p, ("alone", p)) for p in members}
        assert len(got) == 1
    assert len({root.get(p, ("alone", p)) for p in prints}) == len(groups)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_large_bucket_against_all_pairs(seed):
    """Dense clusters, chains and strays in one bucket: the same groups as by comparing every pair."""
    draw = random.Random(seed)
    prints = sorted({*family(seed, 500), *(3 << 40 ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(400))})
    links = simhash.crowd_links(np.array(prints, np.uint64).reshape(-1, 1), 4)
    assert len(links) == len(prints) - len(set(roots(prints)))  # a forest
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in links)
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(prints))] == roots(prints)


def test_near_copies_of_one_text_are_linear():
    """100,000 distinct near copies in one bucket, and a second cluster beside them."""
    draw, sets = np.random.default_rng(5), []
    for center in (0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 0xFFFFFFFF):
        flips = draw.integers(0, 64, (80_000, 4))
        sets.append(np.unique(np.uint64(center) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1)))
    prints = np.concatenate(sets)
    assert len(prints) > 150_000
    began = time.time()
    links = simhash.bucket_links(np.zeros(len(prints), np.int64), prints.reshape(-1, 1), 4)
    assert time.time() - began < 20 and len(links) == len(prints) - 2


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(edges, "a", "b").select("root").distinct().count() == 1


def test_fingerprints_and_edge_rows(spark, edge_documents, no_documents):
    rows = simhash.near_duplicates(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    texts = {}
    for r in edge_documents.collect():
        texts.setdefault(r["doc_id"], set()).add(fingerprint(r["text"]))
    for r in rows:
        assert r["fp"] & (1 << 64) - 1 in texts[r["doc_id"]]
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[3] == by_id[1] == 1
    assert by_id[4] == by_id[5] == by_id[6] == 4  # texts without words link with each other
    assert simhash.near_duplicates(no_documents).count() == 0


def test_keep_one(spark, edge_documents, no_documents):
    kept = simhash.keep_one(edge_documents)
    assert kept.columns == edge_documents.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 2, 4, 7, 8, 9, None]
    assert simhash.keep_one(no_documents).count() == 0


def test_keep_one_against_all_pairs(spark):
    """Copies, texts with a word changed and texts far apart: one row of each component."""
    draw, rows = random.Random(8), []
    words = [f"w{i}" for i in range(4000)]
    for i in range(60):
        text = draw.choices(words, k=draw.randint(150, 900))
        rows.append((i, " ".join(text)))
        rows.append((2000 + i, " ".join(text)))
        text[draw.randrange(len(text))] = "changed"
        rows.append((1000 + i, " ".join(text)))
    rows += rows[:5] * 40  # repeated rows
    draw.shuffle(rows)
    ordered = sorted(set(rows))
    of = roots([fingerprint(t) for _, t in ordered])
    kept = [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()]
    assert sorted(kept) == sorted(ordered[r][0] for r in set(of))
    assert 60 <= len(kept) < 100
