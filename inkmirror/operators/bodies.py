"""Document bodies: notes, web articles and stored originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html_pass import BODY_MIN_LENGTH, SUMMARY_META, article_pass, markdown_pass
from ..functions.markdown import (
    article_body,
    clean_markdown,
    decode_entities,
    degraded_body,
    file_stub_body,
    strip_style_tags,
)
from ..functions.names import file_ext, join_path
from ..functions.rules import download_outcome, looks_like_html, url_kind
from ..functions.text_basics import trim_all
from ..functions.urls import page_meta, promote_lazy_images
from .images import absolute_image_urls

BAD_ENTITY = "character reference out of range"


def _converted(passed: Column, html: Column) -> Column:
    """Entities of the converter's output; the cleaned source where it failed."""
    fallback = trim_all(decode_entities(strip_style_tags(html)))
    return F.coalesce(trim_all(decode_entities(passed["markdown"])), fallback)


def convert_bodies(docs: DataFrame, raw: str, body: str = "body") -> DataFrame:
    """Markdown of a raw note body, and ``body_error`` where there is none.

    Blank text gives '', HTML is converted, other text is cleaned; cleaned text
    that still looks like HTML is converted after all. Only texts that need the
    converter travel to Python, the others pass as NULL.
    """
    blank = trim_all(F.coalesce(raw, F.lit(""))) == ""
    cleaned = docs.withColumn("_blank", blank).withColumn(
        "_cleaned", F.when(~F.col("_blank") & ~looks_like_html(raw), clean_markdown(raw))
    )
    source = (
        F.when(F.col("_blank"), F.lit(None).cast("string"))
        .when(looks_like_html(raw), F.col(raw))
        .when(looks_like_html("_cleaned"), F.col("_cleaned"))
    )
    passed = cleaned.withColumn("_html", source).withColumn("_passed", markdown_pass("_html"))
    result = (
        F.when(F.col("_blank"), F.lit(""))
        .when(F.col("_html").isNotNull(), _converted(F.col("_passed"), F.col("_html")))
        .otherwise(F.col("_cleaned"))
    )
    done = passed.withColumn(body, result).drop("_blank", "_cleaned", "_html", "_passed")
    return done.withColumn("body_error", F.when(F.col(body).isNull(), F.lit(BAD_ENTITY)))


def extract_articles(pages: DataFrame, html: str = "text", title: str = "title", url: str = "url") -> DataFrame:
    """Article body of each page with the quality columns ``selector,
    block_length, clean_length, degraded, body``.

    A map-only job: equal pages are converted again rather than shuffled by
    content, because moving whole pages costs more than parsing them.
    """
    passed = pages.withColumn("_article", article_pass(promote_lazy_images(html)))
    parts = passed.select(
        *pages.columns,
        *[F.col(f"_article.{name}").alias(name) for name in ("selector", "block_length", "clean_length")],
        page_meta(html, SUMMARY_META).alias("_summary"),
        F.col("_article.error").alias("_error"),
        trim_all(decode_entities("_article.markdown")).alias("_markdown"),
    )
    linked = absolute_image_urls(parts, "_markdown", url)
    # no Markdown: too short, the parser failed, or an entity was out of range
    degraded = F.col("_markdown").isNull()
    too_short = F.col("_error").isNull() & (F.col("clean_length") < BODY_MIN_LENGTH)
    summary = F.when(too_short, F.col("_summary"))
    body = F.when(degraded, degraded_body(F.col(title), F.col(url), summary)).otherwise(
        article_body(F.col(title), F.col(url), F.col("_markdown"))
    )
    return (
        linked.withColumn("degraded", degraded)
        .withColumn("body", body)
        .drop("_article", "_summary", "_error", "_markdown")
    )


def newest_fetch(fetched: DataFrame, order: str) -> DataFrame:
    """One fetch per URL, the newest. Winners are found on narrow columns and
    joined back by the fetch number, so page bytes meet one join and no aggregate."""
    winners = fetched.groupBy("url").agg(F.max(order).alias(order)).select(order)
    return fetched.join(winners, order, "left_semi")


def with_fetch_outcome(fetched: DataFrame) -> DataFrame:
    """Download outcome and kind (article or file) of each fetched response."""
    return fetched.withColumn("fetch_outcome", download_outcome("status")).withColumn(
        "kind", url_kind("content_type", "text")
    )


def stored_originals(items: DataFrame) -> DataFrame:
    """File name, path and stub body of items kept as their original bytes.

    ``items`` has ``parent, name, title, url, content_type``.
    """
    ext = file_ext("content_type", "url")
    named = items.withColumn("ext", ext).withColumn("file_name", F.concat("name", F.lit("."), F.col("ext")))
    return named.withColumn("file_path", join_path(F.col("parent"), F.col("file_name"))).withColumn(
        "body", file_stub_body(F.col("title"), F.col("ext"), F.col("file_name"))
    )


def last_writes(writes: DataFrame, order: str = "seq") -> DataFrame:
    """Per path the write that came last: a combined maximum over narrow columns,
    then one join on the unique write number, so bytes never pass an aggregate."""
    winners = writes.groupBy("file_path").agg(F.max(order).alias(order)).select(order)
    return writes.join(winners, order, "left_semi")


def overwrite_files(existing: DataFrame, writes: DataFrame, order: str = "seq") -> DataFrame:
    """Stored files after a run: written paths are replaced, all others stay."""
    last = last_writes(writes, order).select(F.col("file_path").alias("path"), "body")
    return existing.select("path", "body").join(last.select("path"), "path", "left_anti").unionByName(last)


def download_files(items: DataFrame, fetched: DataFrame) -> DataFrame:
    """Items with a successful download, ready to be stored. ``fetched`` is unique per URL."""
    good = with_fetch_outcome(fetched).where(F.col("fetch_outcome") == "success")
    heads = good.drop("kind", "fetch_outcome", "status", "text", "html")
    return stored_originals(items.join(heads, "url"))
