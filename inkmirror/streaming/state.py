"""The newest entry of each document as streaming state that begins with the index.

The index is read once, in the first micro-batch; from then on a micro-batch meets
only the state of its own documents, however many runs the index has. The state is a
native aggregate: an index row enters it like an event, so seeding costs one shuffle
of the index and no call per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decide import NO_CUT, index_seconds
from ..operators.state import INDEX_COLUMNS
from ..sources import storage
from ..sources.index_store import INDEX, IndexStore
from .feed import batch_key

_ENTRY = [c for c in INDEX_COLUMNS if c != "doc_id"]
# An entry of the index stands before any event of the same time.
_INDEXED = -1


def _ranked(rows: DataFrame, t: str, seq) -> DataFrame:
    """``doc_id``, the rank of a row, its entry with the micro-batch it came in."""
    rank = F.struct(F.greatest(F.col(t), F.lit(0)).cast("bigint").alias("t"), (-seq).cast("bigint").alias("earlier"))
    # in a stream this is the time of the micro-batch, also when that is repeated
    entry = F.struct(*_ENTRY, F.current_timestamp().alias("came"), (seq == _INDEXED).alias("indexed"))
    return rows.select("doc_id", rank.alias("rank"), entry.alias("entry"))


def newest_from(feed: DataFrame, index: DataFrame) -> DataFrame:
    """Entries of a streamed feed (index columns and ``seq, t, ok``, numbers from 0) that are newer
    than what the index or an earlier event says, as a stream of changes.

    ``index`` is a stream as well; its rows have to come as a whole with the first events. Partial
    maxima are combined before the state, so a document with very many events sends few rows
    to it. A document whose newest entry is none of the micro-batch's events is no change.
    """
    known = _ranked(index.withColumn("t", index_seconds("update_time")), "t", F.lit(_INDEXED))
    events = _ranked(feed.where("ok"), "t", F.col("seq"))
    newest = known.unionByName(events).groupBy("doc_id").agg(
        F.max_by("entry", "rank").alias("entry"), F.max("entry.came").alias("last")
    )
    changed = ~F.col("entry.indexed") & (F.col("entry.came") == F.col("last"))
    return newest.where(changed).select("doc_id", *[F.col(f"entry.{c}").alias(c) for c in _ENTRY])


def _seed(store: IndexStore, checkpoint: str) -> DataFrame:
    """The index as a stream, as it stood when the checkpoint was new. A file stream without a
    bound takes all files at once, and none of them again after a restart."""
    folder = f"{checkpoint.rstrip('/')}-seed"
    if "_SUCCESS" not in storage.names(store.spark, folder):
        store.load().write.mode("overwrite").parquet(folder)
    return store.spark.readStream.schema(INDEX).parquet(folder)


def keep_newest_from(feed: DataFrame, store: IndexStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Streaming state over the index as it stands when the query is first started: every
    batch appends the documents whose newest entry changed. The index is this stream's alone
    from then on; ``feed.keep_newest`` looks it up in every batch and shares it."""

    def save(changed: DataFrame, number: int) -> None:
        store.append_batch(changed.select(*INDEX_COLUMNS), batch_key(store.spark, checkpoint, number), NO_CUT)
        store.compact(64)

    return (
        newest_from(feed, _seed(store, checkpoint))
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
