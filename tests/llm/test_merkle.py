"""Merkle manifest: against a sequential tree, partial proofs, edge rows."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmirror.llm import merkle


def text_hash(*parts):
    return sha256("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts).encode()).hexdigest()


def model(rows):
    """``{(source, place): (leaf, subroot, proof digests)}`` and the root, node by node."""

    def climb(nodes):
        """Root and the siblings of each node."""
        beside = [[] for _ in nodes]
        owners = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, owned = [], []
            for start in range(0, len(nodes), 16):
                run = nodes[start : start + 16]
                for k in range(len(run)):
                    for i in owners[start + k]:
                        beside[i] += run[:k] + run[k + 1 :]
                up.append(sha256("".join(run).encode()).hexdigest())
                owned.append([i for o in owners[start : start + 16] for i in o])
            nodes, owners = up, owned
        return nodes[0], beside

    sources = {}
    for source, doc_id, leaf in rows:
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: climb([leaf for *_, leaf in sorted(sources[s])]) for s in order}
    root, high = climb([low[s][0] for s in order])
    out = {}
    for s, above in zip(order, high):
        for place, (_, _, leaf) in enumerate(sorted(sources[s])):
            out[(s, place)] = (leaf, low[s][0], low[s][1][place] + above)
    return out, root


def manifest_of(spark, rows):
    frame = spark.createDataFrame([(s, i, text_hash(i, s)) for s, i in rows], "source string, doc_id bigint, leaf string")
    return merkle.build(frame, "source", ["doc_id"])


@pytest.mark.parametrize("partition", [7, 64, 4096])
def test_proofs_against_a_sequential_tree(spark, monkeypatch, partition):
    monkeypatch.setattr(merkle, "PARTITION", partition)
    monkeypatch.setattr(merkle, "SENT_NODES", 3 if partition == 7 else 100_000)
    draw = random.Random(partition)
    sizes = {"hot": 700, "é": 17, "b": 1, "a": 16, None: 33, "": 2, **{f"s{i}": 1 for i in range(20)}}
    rows = [(s, i) for s, n in sizes.items() for i in draw.sample(range(10_000), n)]
    draw.shuffle(rows)
    manifest = manifest_of(spark, rows)
    want, root = model([(s, i, text_hash(i, s)) for s, i in rows])
    got = merkle.prove(manifest, manifest.leaves, "leaf", siblings=True).collect()
    assert manifest.root == root and len(got) == len(rows)
    for r in got:
        leaf, subroot, proof = want[(r["source"], r["at"])]
        assert (r["leaf"], r["subroot"], r["proof"]) == (leaf, subroot, proof)
        assert r["proof_sha256"] == sha256("".join(proof).encode()).hexdigest() and r["folded_root"] == root


def test_some_leaves_and_false_claims(spark):
    rows = [("x", i) for i in range(600)] + [("y", i) for i in range(5)]
    manifest = manifest_of(spark, rows)
    asked = manifest.leaves.where("doc_id % 97 = 0").withColumn(
        "claimed", F.when(F.col("doc_id") == 97, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("leaf"))
    )
    got = merkle.prove(manifest, asked, "claimed").collect()
    assert len(got) == 8
    assert [r["doc_id"] for r in got if r["folded_root"] != manifest.root] == [97]


def test_the_union_is_minimal():
    """No coordinate twice, none that stands above or is an asked leaf, and all that proofs need."""
    draw = random.Random(2)
    at = np.array(sorted(draw.sample(range(5000), 300)))
    asked = merkle.missing(np.zeros(300, int), at, np.full(300, 5000), 1)
    assert len(asked) == len(set(asked))
    above, width, need = {int(a) for a in at}, 5000, set()
    for level in range(4):
        beside = {m for a in above for m in range(a // 16 * 16, min(a // 16 * 16 + 16, width))}
        need |= {(0, level, m) for m in beside - above}
        above, width = {a // 16 for a in above}, -(-width // 16)
    assert set(asked) == need


def test_edge_rows(spark, edge_documents, no_documents):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    manifest = merkle.build(edge_documents.withColumn("leaf", merkle.leaf_of(fields)), "source", ["doc_id"])
    got = merkle.prove(manifest, manifest.leaves, "leaf").collect()
    rows = [(r["source"], r["doc_id"], text_hash(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")])) for r in edge_documents.collect()]
    want, root = model(rows)
    assert {(r["source"], r["at"]): (r["leaf"], r["subroot"]) for r in got} == {k: v[:2] for k, v in want.items()}
    assert {r["folded_root"] for r in got} == {root} == {manifest.root}
    assert {r["key"] for r in got} == {"x"}
    none = merkle.build(no_documents.withColumn("leaf", merkle.leaf_of(fields)), "source", ["doc_id"])
    assert none.root is None and merkle.prove(none, none.leaves, "leaf").count() == 0
