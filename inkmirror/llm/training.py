"""Bounded training samples and numpy training shared by the learned operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stretch(text: Column, characters: int, *seed: Column) -> Column:
    """At most ``characters`` of a text in a row, from a place that ``seed`` decides."""
    places = F.greatest(F.length(text) - characters + 1, F.lit(1))
    return F.substring(text, F.pmod(F.xxhash64(F.lit(19), *seed), places).cast("int") + 1, F.lit(characters))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, characters: int
) -> list[tuple[bytes, int]]:
    """At most ``per_class`` rows of each class, as (text, class), the same on every run.

    ``learn`` says on ``doc_id`` which rows may be learnt from. The rows with the
    smallest hashes are taken, of an id with several texts the one with the smallest
    hash, of a text beyond ``characters`` a stretch.
    What reaches the driver is bounded by 2 * per_class * characters.
    """
    usable = labels.where(F.col(label).isin(0, 1) & learn).select("doc_id", F.col(label).alias("_label"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    # ids first, so that only chosen texts move
    chosen = usable.join(texts.select("doc_id"), "doc_id", "left_semi").distinct()
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    parts = [chosen.where(F.col("_label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    # at most 2 * per_class ids
    learnt = stretch(F.col("text"), characters, F.col("doc_id"), F.col("text")).cast("binary").alias("t")
    # one text of an id, however many rows it has
    each = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = each.select("doc_id", learnt, "_label")
    found = {(r["doc_id"], r["t"]): r["_label"] for r in rows.collect()}
    return [(bytes(text), label) for (_, text), label in sorted(found.items())]


class Adam:
    """Adam over a dict of float32 arrays, with weight decay for the names in ``decay``."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: dict[str, float] | None = None):
        self.weights, self.rate, self.step, self.decay = weights, rate, 0, decay or {}
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, gradient: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, g in gradient.items():
            if name in self.decay:
                self.weights[name] *= np.float32(1 - self.rate * self.decay[name])
            self.mean[name] += 0.1 * (g - self.mean[name])
            self.square[name] += 0.001 * (g * g - self.square[name])
            self.weights[name] -= (scale * self.mean[name] / (np.sqrt(self.square[name]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def in_slices(texts: pa.Array, most_bytes: int) -> Iterator[list[bytes]]:
    """The texts (null as empty) in order, in lists of about ``most_bytes``; a longer text is alone."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        value = text.as_py() or b""
        if held and total + len(value) > most_bytes:
            yield held
            held, total = [], 0
        held.append(value)
        total += len(value)
    if held:
        yield held


def score_texts(documents: DataFrame, keys: dict[str, Column], score, most_bytes: int) -> DataFrame:
    """``keys`` and ``score`` (double) per row; ``score`` maps a list of byte texts to floats."""
    source = documents.select(*[c.alias(name) for name, c in keys.items()], F.col("text").cast("binary").alias("_text"))
    schema = source.drop("_text").withColumn("score", F.lit(0.0)).schema

    names = list(keys)  # columns themselves cannot travel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.asarray(score(part), np.float64) for part in in_slices(batch.column("_text"), most_bytes)]
            column = pa.array(np.concatenate(scores) if scores else np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [column], names=[*names, "score"])

    return source.mapInArrow(run, schema)
