"""The pipeline on the smallest tables, stage by stage against brute force."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from inkmirror.llm import language, mixing
from test_decontaminate import windows
from test_simhash import fingerprint, roots

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.cut(stage(spark, out[-1], SF_DIR)))
    return out


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_language_stage(stages):
    """Text by text: what stays has a main language."""
    chain = language.fit(stages[0], F.lit(True))
    rows = stages[0].collect()
    judged = [chain.label([(r["text"] or "").encode()]) for r in rows]
    want = {r["doc_id"] for r, (names, scores) in zip(rows, judged) if names[0] != "und" and scores[0] >= 0.4}
    assert ids(stages[1]) == want and 0.95 * len(rows) < len(want)
    assert not any(any(map(str.isalpha, r["text"] or "")) is False for r in stages[1].collect())


def test_dedup_stage(stages):
    """Exactly the smallest id of each component of all pairs stays."""
    rows = sorted((r["doc_id"], fingerprint(r["text"])) for r in stages[1].collect())
    of = roots([f for _, f in rows])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(rows[r][0] for r in set(of))


def test_decontamination_stage(spark, stages):
    items = [windows(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() if r["text"]]
    whole = set()
    for r in stages[2].collect():
        mine = set(windows(r["text"]))
        if any(len(mine & set(item)) >= 0.9 * len(set(item)) for item in items):
            whole.add(r["doc_id"])
    gone = ids(stages[2]) - ids(stages[3])
    assert whole <= gone and len(gone) <= len(whole) + 3


def test_mix_and_shards(stages):
    plan = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()})
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert got == +plan
    last = stages[5].collect()
    assert Counter(r["doc_id"] for r in last) == got
    assert {r["shard"] for r in last} == set(range(8))


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 14)] + ["pipeline"])
def test_registered(name):
    assert sum(q.startswith(name) for q in driver.queries()) == 1
