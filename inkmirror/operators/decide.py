"""Change decision against the index, the in-run fold and the run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import change_action, content_route
from ..functions.text_basics import leading_int
from ..functions.times import to_seconds
from .scans import GROUP_ROWS, running_before

NO_CUT = (1 << 63) - 1


def index_seconds(update_time: Column | str) -> Column:
    """Stored update time of an index row as a number, 0 where it has none."""
    return F.coalesce(leading_int(update_time), F.lit(0)).cast("bigint")


def with_media(items: DataFrame, media: DataFrame) -> DataFrame:
    """Items with their media information; ``has_media`` is false without an answer."""
    answers = media.select(
        "media_id",
        F.col("media_type").alias("info_media_type"),
        "notebook_id",
        "url",
        to_seconds("update_time").alias("t"),
        F.lit(True).alias("has_media"),
    )
    return (
        items.join(answers, "media_id", "left")
        .withColumn("has_media", F.coalesce("has_media", F.lit(False)))
        .withColumn("t", F.coalesce("t", F.lit(0).cast("bigint")))
        .withColumn("route", content_route("info_media_type", "notebook_id", "url"))
    )


def with_index(items: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Add ``known`` and ``known_t`` from the index (unique per document), and ``there`` if it tells."""
    state = index.select(
        F.col("doc_id").alias(key),
        index_seconds("update_time").alias("known_t"),
        F.col("path").alias("index_path"),
        F.lit(True).alias("known"),
        *[c for c in ("there",) if c in index.columns],
    )
    return (
        items.join(state, key, "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumn("known_t", F.coalesce("known_t", F.lit(0).cast("bigint")))
    )


def decide(items: DataFrame, index: DataFrame, key: str, seconds: str) -> DataFrame:
    """Action of each item against the index as it stood before the run."""
    joined = with_index(items, index, key)
    return joined.withColumn("action", change_action(F.col("known"), F.col("known_t"), F.col(seconds)))


def fold_actions(
    feed: DataFrame, index: DataFrame | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Actions where a document occurs several times in one run.

    ``feed`` has ``doc_id, seq, t, ok``: each occurrence is decided against the
    index as the earlier successful occurrences left it. Those enter as two
    running maxima, because a skipped row never carries a later time.

    ``feed`` may have ``again`` (:func:`with_again`): rows where it is false have nothing
    before them and are not moved. A feed that met its index already (:func:`with_index`)
    is not joined to it a second time.
    """
    marked = "again" in feed.columns
    prior = running_before(
        feed.where("again") if marked else feed,
        ["doc_id"],
        "seq",
        {
            "prior_ok": ("max", F.when(F.col("ok"), F.lit(1))),
            "prior_t": ("max", F.when(F.col("ok"), F.col("t"))),
        },
        group_rows,
    )
    if marked:
        prior = prior.unionByName(feed.where("NOT again"), allowMissingColumns=True)
    # an index that may repeat documents is joined last, so the maxima are taken over the feed alone
    if "known" in feed.columns:
        pass
    elif index is not None:
        prior = with_index(prior, index, "doc_id")
    else:
        prior = prior.withColumns({"known": F.lit(False), "known_t": F.lit(0).cast("bigint")})
    seen = F.col("known") | F.col("prior_ok").isNotNull()
    newest = F.greatest(F.col("known_t"), F.coalesce("prior_t", F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return prior.withColumn("action", change_action(seen, newest, F.col("t")))


def run_result(has_media: Column, action: Column, ready: Column) -> Column:
    """Result of one item; a missing answer fails even an unchanged item."""
    return (
        F.when(~has_media, "failed")
        .when(action == "skip", "skipped")
        .when(~ready, "failed")
        .when(action == "create", "created")
        .otherwise("updated")
    )


def before_quota(df: DataFrame, order: str, hit: Column) -> DataFrame:
    """Rows before the first quota answer; the row that met it drops out too.

    The border is one scalar from a combined aggregate, not a window.
    """
    first = df.where(hit).agg(F.min(order).alias("border")).select(F.coalesce("border", F.lit(NO_CUT))).scalar()
    return df.where(F.col(order) < first)


def run_counts(results: DataFrame) -> DataFrame:
    """One row with the four counters."""
    result = F.col("result")
    return results.agg(
        F.count_if(result == "created").alias("created"),
        F.count_if(result == "updated").alias("updated"),
        F.count_if(result == "skipped").alias("skipped"),
        F.count_if(result == "failed").alias("failed"),
    )


def error_lines(results: DataFrame) -> DataFrame:
    """``title: message`` of each failed item, numbered by ``seq``.

    The lines stay rows; one list of all errors would not fit one task.
    """
    line = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.col("error"))
    return results.where(F.col("result") == "failed").select("seq", line.alias("error_line"))
