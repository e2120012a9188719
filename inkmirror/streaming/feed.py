"""The sync over an unbounded feed.

Two forms: a native streaming aggregate that keeps the newest entry of each
document, and a micro-batch job that also labels every event with its action.
Late events need no watermark: an event that is not newer than the state changes
nothing, and the state holds one row per document.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import clamp_schedule, schedule_ms
from ..operators.decide import NO_CUT, fold_actions, index_seconds, with_index
from ..operators.scans import GROUP_ROWS
from ..operators.state import INDEX_COLUMNS, last_per_document
from ..session import cut
from ..sources.index_store import ENTRY, IndexStore


# Micro-batches whose changes wait before they are folded into the snapshot.
RUNS_BEFORE_COMPACTION = 64


class QuotaReached(RuntimeError):
    """Ends the stream after the part before the quota answer is committed; a restart
    begins with the event that met it."""


def batch_key(spark: SparkSession, checkpoint: str, number: int) -> str:
    """Name of a micro-batch that no other stream has: the id its checkpoint keeps."""
    stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    return f"{stream}-{number}"


def schedule_trigger(value: float, unit: str) -> dict:
    """Trigger of the scheduled sync; intervals below the minimum are raised to it."""
    return {"processingTime": f"{schedule_ms(clamp_schedule(value, unit)[0], unit)} milliseconds"}


def newest_entries(feed: DataFrame) -> DataFrame:
    """Index entry each document ends up with, as a batch or streaming aggregate.

    The last write of the sequential rule is the first occurrence of the highest
    time among the successful ones, which partial aggregates can combine, so a
    document with very many events is no burden on one task.
    """
    entry = F.struct(*[c for c in INDEX_COLUMNS if c != "doc_id"])
    rank = F.struct(F.greatest(F.col("t"), F.lit(0)).alias("t"), (-F.col("seq")).alias("earlier"))
    newest = feed.where("ok").groupBy("doc_id").agg(F.max_by(entry, rank).alias("entry"))
    return newest.select("doc_id", "entry.*")


def keep_newest(feed: DataFrame, store: IndexStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Streaming state: every batch appends the documents whose newest entry changed."""

    def save(changed: DataFrame, number: int) -> None:
        key = batch_key(store.spark, checkpoint, number)
        if store.progress(key) is not None:
            return
        entries = cut(changed)
        # the store may know a later event of the document than this stream has seen
        known = with_index(entries, store.load(entries.select("doc_id")), "doc_id")
        newer = ~F.col("known") | (index_seconds("update_time") > F.col("known_t"))
        store.append_batch(known.where(newer), key, NO_CUT)
        store.compact(RUNS_BEFORE_COMPACTION)

    return (
        newest_entries(feed)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def sync_feed(
    feed: DataFrame,
    store: IndexStore,
    actions_folder: str,
    checkpoint: str,
    trigger: dict | None = None,
    on_quota: Callable[[], None] | None = None,
    group_rows: int = GROUP_ROWS,
    answers: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Label each event with its action and bring the index up to date.

    ``feed`` has the index columns and ``seq, t, ok``, maybe ``quota``. Each part of a
    micro-batch is a run of the index of its own, under the next free number; the
    folder of its actions is named after the part, so a repeated part writes the same
    folder again. A quota answer ends the stream; the part before it is committed with
    the border, also if it is empty. The event that met it waits in a table of its own
    (``<actions_folder>-waiting``), and a restart takes it from there as its first event, once.
    ``answers`` (seq, ok, quota) gives what a new request for it brought; another quota answer
    ends the stream there again, without one it counts as answered.
    One checkpoint location allows one active query, which keeps runs from overlapping.
    """
    waiting = f"{actions_folder}-waiting"

    def retried(key: str, border: int, like: DataFrame) -> DataFrame:
        held = store.spark.read.schema(like.schema).parquet(f"{waiting}/batch={key}-at-{border}")
        if answers is None:
            return held.withColumn("quota", F.lit(False))
        # one event waits, so one row of the answers is looked up
        new = answers().where(F.col("seq") == border).select("seq", F.col("ok").alias("_ok"), F.col("quota").alias("_quota"))
        both = held.join(F.broadcast(new.limit(1)), "seq", "left")
        settled = {"ok": F.coalesce("_ok", "ok"), "quota": F.coalesce("_quota", F.lit(False))}
        return both.withColumns(settled).select(like.columns)

    def run(batch: DataFrame, number: int) -> None:
        key = batch_key(store.spark, checkpoint, number)
        done = store.progress(key)
        if done == NO_CUT:
            return
        rows = cut(batch if done is None else batch.where(F.col("seq") > done).unionByName(retried(key, done, batch)))
        border = None
        if "quota" in rows.columns:
            border = rows.where("quota").agg(F.min("seq")).first()[0]
        before = rows if border is None else rows.where(F.col("seq") < border)
        folded = fold_actions(before, store.load(before.select("doc_id").distinct()), group_rows)
        labelled = cut(folded.select(*rows.columns, "action"))
        part = key if done is None else f"{key}-after-{done}"
        labelled.write.mode("overwrite").parquet(f"{actions_folder}/batch={part}")
        written = labelled.where("action <> 'skip' AND ok")
        if border is not None:
            held = rows.where(F.col("seq") == border).limit(1)
            held.write.mode("overwrite").parquet(f"{waiting}/batch={key}-at-{border}")
        store.append_batch(last_per_document(written), key, NO_CUT if border is None else border)
        store.compact(RUNS_BEFORE_COMPACTION)
        if border is not None:
            if on_quota:
                on_quota()
            raise QuotaReached(f"quota answer in micro-batch {number}")

    return (
        feed.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def as_index_changes(feed: DataFrame, folder: str, synced_at: str) -> DataFrame:
    """Feed rows (doc_id, seq, t, ok) with the index entry each would write."""
    values = {
        "path": F.concat(F.lit(f"{folder}/"), F.col("doc_id"), F.lit(".md")),
        "kb_id": F.lit(""),
        "title": F.col("doc_id"),
        "media_type": F.lit(0),
        "update_time": F.when(F.col("t") > 0, F.col("t").cast("string")).otherwise(""),
        "synced_at": F.lit(synced_at),
    }
    assert list(values) == ENTRY.fieldNames()
    return feed.withColumns(values)
