"""Physical plans: what must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from inkmirror.operators import bodies, chains, decide, images, key_filter, naming, requests, scans
from inkmirror.plans.fixtures import relation
from inkmirror.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# queries that need the HTML kernel or URL arithmetic
PYTHON = {"note_bodies", "note_images", "article_route", "html_to_markdown", "notes_sync", "run_report", "run_results", "run_index", "run_documents", "run_attachments", "run_originals", "run_twice", "run_from_pages", "run_failed_listing", "run_blocked_folder", "run_new_texts"}
# these start runs or streams while they are built
EAGER = {"run_report", "run_results", "run_index", "run_documents", "run_attachments", "run_originals", "run_twice", "run_from_pages", "run_failed_listing", "run_blocked_folder", "run_new_texts", "stream_requests", "stream_seeded_state", "file_sink", "vault_after_crash", "stream_used_store", "stream_quota_resume", "stream_state", "stream_fold", "index_clear", "notes_sync"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_shape(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python
    if name not in PYTHON:
        assert "EvalPython" not in plan
    # the one window over a single partition sums the row counts of sort partitions
    single = re.findall(r"Window \[(\w+)\([^\n]*\n\s*\+- Sort[^\n]*\n\s*\+- Exchange SinglePartition", plan)
    assert len(single) == len(re.findall(r"Window \[sum\(_rows[^\n]*\n\s*\+- Sort[^\n]*\n\s*\+- Exchange SinglePartition", plan))


def test_scans_read_only_what_they_need(spark):
    report = plan_of(decide.run_counts(decide.decide(decide.with_media(relation(spark, SF_DIR, "fx_items"), relation(spark, SF_DIR, "fx_media")), relation(spark, SF_DIR, "fx_index"), "media_id", "t").withColumn("result", decide.run_result(F.col("has_media"), F.col("action"), F.col("route") != "none"))))
    assert "o_totalprice" not in report and "c_acctbal" not in report
    heads = images.resolve_refs(images.image_refs(relation(spark, SF_DIR, "fx_images")), relation(spark, SF_DIR, "fx_image_blobs").withColumn("body", F.lit("bytes")))
    assert "bytes" not in plan_of(heads)


def test_filters_run_before_the_converter(spark, tmp_path):
    pages = relation(spark, SF_DIR, "pages").withColumn("title", F.lit("t")).withColumnRenamed("html", "text")
    plan = plan_of(bodies.extract_articles(pages.where("page_id > 5")))
    assert plan.rindex("Filter") > plan.rindex("ArrowEvalPython")  # below it in the tree
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,5)]" in plan
    assert plan.count("article_pass(") == 1 and plan.count("Exchange") == 0


def test_windows_never_take_a_whole_frequent_key(spark):
    rows = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    plan = plan_of(scans.running_before(rows, ["k"], "seq", {"n": ("sum", F.lit(1))}, 5))
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    # rows are grouped by key and range; only the summary has one group per key
    assert any("_part" in w.split("ASC")[0] for w in windows)


def test_the_fold_deals_a_frequent_document_by_range(spark):
    """With an index joined by shuffle, the window still stands on (document, range)."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(decide.fold_actions(relation(spark, SF_DIR, "fx_items_dup"), relation(spark, SF_DIR, "fx_index"), 50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_range = (
        r"Window \[[^\n]*windowspecdefinition\(doc_id#\d+, _part#\d+L?, seq[^\n]*\n[\s:]*\+- Sort[^\n]*\n"
        r"[\s:]*\+- Exchange hashpartitioning\(doc_id#\d+, _part#\d+L?, \d+\), REPARTITION"
    )
    assert re.search(by_range, plan)
    assert plan.count("FileScan parquet [o_orderkey") == 1  # the index is read once


def test_aggregates_combine_before_the_shuffle(spark):
    log = relation(spark, SF_DIR, "fx_requests")
    plan = plan_of(requests.resolve(requests.classify(log)))
    assert "partial_min" in plan and plan.count("Exchange") == 1


def test_keys_are_filtered_below_the_exchange(spark):
    """Few written keys of a wide table: the bitmap stands in its scan, under the shuffle."""
    wide = relation(spark, SF_DIR, "documents").select(F.col("doc_id").cast("string").alias("k"), "text")
    keys = wide.where("k LIKE '%7'").select("k")
    many, whole = keys.count(), wide.count()
    filtered = key_filter.only_wanted(wide, keys, "k", many)
    assert many <= filtered.count() <= many + whole / 8
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keys.join(filtered, "k")
        plan = plan_of(joined)
        assert joined.count() == many
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = plan[plan.rindex("SortMergeJoin") :]
    assert re.search(r"Exchange hashpartitioning\(k#\d+, \d+\)[^\n]*\n[\s:|+-]*Project \[k#\d+, text#\d+\]\n(?:[\s:|+-]*Filter[^\n]*\n)?[\s:|+-]*BroadcastHashJoin \[_page", below)


def test_bitmap_bounds(spark, monkeypatch):
    """No key, null keys, a bound that is too low, and more keys than the bitmap may hold."""
    wide = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("_hash2"))
    none = wide.limit(0).select("k")
    assert key_filter.only_wanted(wide, none, "k", 0).count() == 0
    some = wide.where("k IS NULL OR k < 500").select("k")
    for at_most in (1, 500, 10**6):
        kept = key_filter.only_wanted(wide, some, "k", at_most)
        assert kept.columns == wide.columns and kept.where("k < 500").count() == 499 and kept.where("k IS NULL").count() == 0
    monkeypatch.setattr(key_filter, "MAX_PAGES", 0)
    assert key_filter.only_wanted(wide, some, "k", 500).count() == 999


def test_texts_do_not_move_to_settings_or_files(spark):
    """Notes keep their texts where they lie; an index that knows its files moves no decided row."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        notes = plan_of(relation(spark, SF_DIR, "fx_notes"))
        actions = spark.createDataFrame([("d", "p", "update")], "doc_id STRING, index_path STRING, action STRING")
        files = spark.createDataFrame([("p",)], "path STRING")
        known = naming.with_files(spark.createDataFrame([("d", "p"), ("e", "q")], "doc_id STRING, path STRING"), files)
        targets = naming.write_targets(actions.withColumn("there", F.lit(True)), files)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in notes and notes.count("BroadcastHashJoin") == 1
    assert {r["doc_id"]: r["there"] for r in known.collect()} == {"d": True, "e": False}
    assert "Exchange" not in plan_of(targets) and targets.first()["in_place"]


def test_chain_rounds_are_not_broadcast(spark):
    """Rounds of a chain stay off the driver, and move numbers instead of cursors."""
    rows = [("k", f"c{i}", f"c{i + 1}" if i < 9 else None) for i in range(10)] + [("l", "a", "b"), ("l", "b", "a")]
    nodes = spark.createDataFrame(rows, "k STRING, at STRING, to STRING")
    ranked = chains.rank_chain(nodes, ["k"], "at", "to", F.col("at").isin("c0", "a"))
    assert "Broadcast" not in plan_of(ranked)
    assert {(r["k"], r["at"]): r["rank"] for r in ranked.collect()} == {**{("k", f"c{i}"): i for i in range(10)}, ("l", "a"): 0, ("l", "b"): 1}


def test_documents_that_occur_once_are_not_moved(spark):
    """Nothing stands before them in a run, and a feed that met its index meets it once."""
    rows = [(f"d{i}", i, 5, True, i % 2 == 0, 3, f"p{i}") for i in range(6)]
    schema = "doc_id STRING, seq BIGINT, t BIGINT, ok BOOLEAN, known BOOLEAN, known_t BIGINT, index_path STRING"
    once = scans.with_again(spark.createDataFrame(rows, schema), "doc_id")
    index = spark.createDataFrame([("d0", "p0", "3")], "doc_id STRING, path STRING, update_time STRING")
    folded = decide.fold_actions(once, index)
    assert "Exchange" not in plan_of(folded)
    assert [r["action"] for r in folded.orderBy("seq").collect()] == ["update", "create"] * 3


def test_documents_of_a_folder_are_moved_once(spark):
    """Up to a window group no folder is sorted over all tasks."""
    rows = spark.range(20).select((F.col("id") % 3).alias("k"), F.col("id").alias("place"), F.lit("x").alias("id"))
    none = rows.select("k").where(F.lit(False))
    totals = scans.with_total_before_in(rows, "k", ["place", "id"], {"before": F.lit(1)}, none)
    plan = plan_of(totals)
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    some = scans.with_total_before_in(rows, "k", ["place", "id"], {"before": F.lit(1)}, spark.createDataFrame([(1,)], "k BIGINT"))
    for got in (totals, some):
        assert sorted((r["place"], r["before"]) for r in got.collect()) == [(i, i // 3) for i in range(20)]


def test_claims_are_kept_without_their_paths(spark):
    """Names and paths are worked out again, neither moved to the winners nor written."""
    rows = spark.createDataFrame([(i, f"d{i}", "p", "t") for i in range(3)], "seq BIGINT, doc_id STRING, parent STRING, base STRING")
    claims = naming.claim_paths(rows)
    assert "path:string" not in plan_of(claims) and claims.count() == 3
