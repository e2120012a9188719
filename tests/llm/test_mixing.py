"""Mixing: targets by hand, words near targets, copies bounded, edge rows."""

import random
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkmirror.llm import mixing


def targets_by_hand(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by closing the sources above their limit one by one."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, closed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in closed]
        level = (total - sum(closed.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if level * weight[s] > most * sizes[s] + 1e-9]
        if not above:
            return closed | {s: level * weight[s] for s in rest}
        closed |= {s: most * sizes[s] for s in above}


def documents(spark, counts, seed=1):
    draw = random.Random(seed)
    rows = []
    for source, many in counts.items():
        for _ in range(many):
            rows.append((len(rows), "w " * draw.randint(1, 60), "en", source, 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_targets_and_words(spark):
    docs = documents(spark, {"a": 900, "b": 300, "é": 15, None: 200})
    rows = mixing.mix(docs).collect()
    source_of = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        source = source_of[r["doc_id"]]
        sizes[source] += r["size"]
        taken[source] += r["size"] * r["copies"]
        target[source] = r["target"]
        assert 0 <= r["copies"] <= 3
    expected = targets_by_hand(dict(sizes))
    for source, value in expected.items():
        assert abs(target[source] - value) < 1e-6 * value
        assert abs(taken[source] - value) <= 30.5, source  # half of the longest text
    assert {r["doc_id"]: r["source_size"] for r in rows} == {d: sizes[s] for d, s in source_of.items()}


def test_copies_are_floor_or_ceiling_and_reruns_agree(spark):
    docs = documents(spark, {"a": 400, "b": 100, "c": 250}, seed=2)
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    shares = defaultdict(set)
    for doc_id, _, size, source_size, target, copies in first:
        shares[target / source_size].add(copies)
    for share, copies in shares.items():
        assert copies <= {int(share), int(share) + 1}


def test_edge_rows(spark, edge_documents, no_documents):
    rows = mixing.mix(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mixed_documents(no_documents).count() == 0


def test_mixed_documents_repeat_rows(spark, edge_documents):
    plan = Counter()
    for r in mixing.mix(edge_documents).collect():
        plan[r["doc_id"]] += r["copies"]
    got = mixing.mixed_documents(edge_documents)
    assert got.columns == edge_documents.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_many_sources_stop_in_turn(spark):
    """Targets of sources that reach their limits at many different levels, against closing them one by one."""
    draw = random.Random(3)
    for many in (1, 2, 40):
        sizes = {f"s{i:02}": draw.choice([1, 5, 40, 400, 3000]) for i in range(many)}
        frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size bigint, many bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        want = targets_by_hand(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in sizes) and got.keys() == want.keys()


def test_very_many_equal_rows(spark):
    """100,000 rows of one text in a source: written by chunks, words near the target, in the time of their number."""
    hot = spark.range(100_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(5).cast("bigint").alias("n_chars"))
    docs = hot.unionByName(documents(spark, {"a": 300, "b": 8000}, seed=4).withColumn("doc_id", F.col("doc_id") + 10))
    began = time.time()
    rows = mixing.mix(docs).cache()
    assert rows.count() == 108_300
    of_source = rows.groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(of_source) == 2 and all(abs(r["taken"] - r["target"]) <= 30.5 for r in of_source)
    copies = {r["copies"]: r["count"] for r in rows.where("doc_id = 1").groupBy("copies").count().collect()}
    assert sum(copies.values()) == 100_000 and max(copies) - min(copies) <= 1
    assert time.time() - began < 60
    taken = mixing.mixed_documents(docs)
    assert taken.where("doc_id = 1").count() == sum(c * n for c, n in copies.items())


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    frame = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("d", 4), ("e", 11)], "k string, n bigint")
    got = sorted((r["k"], r["nth"]) for r in mixing.written_out(frame, F.col("n")).collect())
    assert got == [(k, i) for k, n in (("b", 1), ("c", 3), ("d", 4), ("e", 11)) for i in range(n)]


def test_equal_keys_with_other_columns_share_copies(spark):
    """Rows equal in id, source and text, of which some differ in another column."""
    rows = [(1, "x y z", lang, "a", 5) for lang in ("en", "de") for _ in range(20)] + [(i, "x " * (i % 40), "en", "b", 0) for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert got == +plan
    by_lang = Counter(r["lang"] for r in mixing.mixed_documents(docs).where("doc_id = 1").collect())
    assert abs(by_lang["en"] - by_lang["de"]) <= 1
