"""The registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut
from . import (
    decontaminate, fingerprints, language, licenses, main_text, merkle, mixing, quality, search, sharding,
    simhash, toxicity, url_templates,
)
from .common import fold_of, lower_ascii, table
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op9_mix_sources(spark, sf_dir):
    """Words each document gives to a mix of sources with target weights."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op5_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_byte_quality(spark, sf_dir):
    """Quality of each document, learnt from two thirds of the labels."""
    documents, held = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 3) == 1
    net = quality.fit(documents, table(spark, sf_dir, "labels"), ~held)
    scored = quality.score(documents, net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_toxic_windows(spark, sf_dir):
    """Toxicity of each document, learnt from two thirds of the labels."""
    documents, held = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 3) == 1
    net = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(documents, net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_language_chain(spark, sf_dir):
    """Language of each document, learnt from three quarters of the labelled texts."""
    documents, held = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 4) == 2
    chain = language.fit(documents, ~held)
    return language.identify(documents, chain).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op7_weighted_fingerprints(spark, sf_dir):
    """Fingerprints of each document, of its edited text, and how alike they are."""
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


@query
def op1_kd_shards(spark, sf_dir):
    """Shard and place of each document; shards are near equal in bytes."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"), leaves=8)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_template_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, also with other names, numbers or units."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_windows", "coverage")


@query
def op4_url_templates(spark, sf_dir):
    """Verdict on each page's address, by rule or by path template."""
    return url_templates.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_main_text(spark, sf_dir):
    """Main text of each page."""
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(pages))


@query
def op12_merkle_manifest(spark, sf_dir):
    """Proofs of all documents against one root; those in a fifth of the ids are tampered with."""
    documents = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_of([*fields, F.col("text")])
    tampered = F.when(fold_of(F.col("doc_id"), 5) == 0, merkle.leaf_of([*fields, lower_ascii(F.col("text"))]))
    rows = documents.select("doc_id", "source", leaf.alias("leaf"), F.coalesce(tampered, leaf).alias("claimed"))
    manifest = merkle.build(rows, "source", ["doc_id"])
    proved = merkle.prove(manifest, manifest.leaves, "claimed")
    root = F.lit(manifest.root).cast("string")
    return proved.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


@query
def op11_ranked_search(spark, sf_dir):
    """The 50 best documents for each benchmark item."""
    index = cut(search.build_index(table(spark, sf_dir, "documents")))
    return search.search(index, table(spark, sf_dir, "benchmark"), best=50)


@query
def op13_license_scan(spark, sf_dir):
    """License phrases, statements and notices in each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))
