"""Quality of whole texts by a byte-level convolutional network in numpy.

Filters of 8 bytes at every second byte run over the whole text. Their responses are
max-pooled in overlapping chunks of 256 bytes (every 128), chunks are combined by mean
and maximum, and a small dense layer gives one probability. For scoring, an embedding
and a filter fold into one table per pair of bytes, so that a filter response is a sum
of four rows.

Defined results: null and empty texts are scored as a text of padding; without labelled
rows of both classes every score is 0.5; repeated rows get equal scores; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import Adam, labelled_sample, score_texts, sigmoid

PAIRS = 4  # a filter sees 4 pairs of bytes
HALF = 64  # positions in half a chunk
EMBEDDING, FILTERS, HIDDEN = 6, 24, 16
# Bound of the training sample: texts of each class, and characters of a text.
PER_CLASS, CHARACTERS = 1200, 20_000
TRAIN_HALVES = 24  # a training step sees a stretch of so many half chunks
EPOCHS, BATCH = 10, 32


def byte_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of byte pairs, each padded by zeros to whole half chunks,
    and the number of half chunks of each."""
    halves = np.array([(len(t) + 2 * PAIRS) // (2 * HALF) + 1 for t in texts])
    joined = b"".join(t.ljust(2 * HALF * int(n), b"\0") for t, n in zip(texts, halves)) + b"\0" * 2 * PAIRS
    return np.frombuffer(joined, "<u2"), halves


def past_end(halves: np.ndarray) -> np.ndarray:
    """Positions from which a filter would reach into the next text."""
    return (np.cumsum(halves)[:, None] * HALF - np.arange(PAIRS - 1, 0, -1)).ravel()


def chunk_ends(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk, and the first chunk of each text."""
    starts = np.cumsum(halves) - halves
    chunks = np.maximum(halves - 1, 1)
    first = np.cumsum(chunks) - chunks
    at = np.arange(chunks.sum()) - np.repeat(first, chunks) + np.repeat(starts, chunks)
    return at, np.minimum(at + 1, np.repeat(starts + halves - 1, chunks)), first


class ByteNet:
    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "bytes": normal(256, EMBEDDING, scale=0.5),
            "filters": normal(2 * PAIRS, EMBEDDING, FILTERS, scale=0.2),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN, scale=0.2),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=0.2),
            "out_bias": np.zeros(1, np.float32),
        }
        self.tables = None

    def pair_tables(self) -> list[np.ndarray]:
        """Response of each pair of bytes at each of the four places in a filter."""
        per_byte = np.einsum("be,kef->kbf", self.w["bytes"], self.w["filters"])
        # the low byte of a little-endian pair comes first
        return [(per_byte[2 * k + 1][:, None, :] + per_byte[2 * k][None, :, :]).reshape(65536, FILTERS) for k in range(PAIRS)]

    def halves(self, pairs: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Strongest response of each filter in each half chunk."""
        n, outside = len(pairs) - PAIRS, past_end(counts)
        out = np.empty((n // HALF, FILTERS), np.float32)
        step = 256 * HALF
        for a in range(0, n, step):
            b = min(a + step, n)
            response = tables[0][pairs[a:b]]
            for k in range(1, PAIRS):
                response += tables[k][pairs[a + k : b + k]]
            response[outside[np.searchsorted(outside, a) : np.searchsorted(outside, b)] - a] = -np.inf
            out[a // HALF : b // HALF] = response.reshape(-1, HALF, FILTERS).max(axis=1)
        return out

    def pooled(self, half: np.ndarray, counts: np.ndarray):
        a, b, first = chunk_ends(counts)
        chunk = np.maximum(np.maximum(half[a], half[b]) + self.w["filter_bias"], 0)
        chunks = np.maximum(counts - 1, 1)
        mean = np.add.reduceat(chunk, first, axis=0) / chunks[:, None]
        return np.hstack([mean, np.maximum.reduceat(chunk, first, axis=0)]).astype(np.float32), chunk

    def logits(self, features: np.ndarray):
        hidden = np.maximum(features @ self.w["hidden"] + self.w["hidden_bias"], 0)
        return hidden @ self.w["out"] + self.w["out_bias"], hidden

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.tables is None:
            self.tables = self.pair_tables()
        pairs, counts = byte_pairs(texts)
        features, _ = self.pooled(self.halves(pairs, counts, self.tables), counts)
        return sigmoid(self.logits(features)[0])

    def __getstate__(self):
        return {"w": self.w, "tables": None}  # each worker builds its own tables

    def gradients(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        pairs, counts = byte_pairs(texts)
        data = pairs.view(np.uint8)
        embedded = w["bytes"][data]
        windows = np.lib.stride_tricks.sliding_window_view(embedded, 2 * PAIRS, axis=0)[: len(data) - 2 * PAIRS : 2]
        kernel = w["filters"].transpose(1, 0, 2).reshape(-1, FILTERS)
        response = windows.reshape(len(windows), -1) @ kernel
        response[past_end(counts)] = -np.inf
        response = response.reshape(-1, HALF, FILTERS)
        best = response.argmax(axis=1)
        half = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
        features, chunk = self.pooled(half, counts)
        logit, hidden = self.logits(features)
        d_logit = (sigmoid(logit) - target) * weight / len(texts)
        d_hidden = np.outer(d_logit, w["out"]) * (hidden > 0)
        d_features = d_hidden @ w["hidden"].T
        a, b, first = chunk_ends(counts)
        chunks = np.maximum(counts - 1, 1)
        of = np.repeat(np.arange(len(texts)), chunks)
        d_chunk = d_features[of, :FILTERS] / chunks[of, None]
        top = features[of, FILTERS:] == chunk
        d_chunk = (d_chunk + d_features[of, FILTERS:] * top) * (chunk > 0)
        d_half = np.zeros_like(half)
        upper = half[a] >= half[b]
        np.add.at(d_half, a, d_chunk * upper)
        np.add.at(d_half, b, d_chunk * ~upper)
        row, column = np.nonzero(d_half)
        at = 2 * (row * HALF + best[row, column])
        value = d_half[row, column]
        seen = data[at[:, None] + np.arange(2 * PAIRS)]
        d_filters = np.zeros_like(w["filters"])
        d_bytes = np.zeros_like(w["bytes"])
        for k in range(2 * PAIRS):
            spread = np.zeros((256, FILTERS), np.float32)
            np.add.at(spread, (seen[:, k], column), value)
            d_filters[k] = w["bytes"].T @ spread
            d_bytes += spread @ w["filters"][k].T
        return {
            "bytes": d_bytes, "filters": d_filters, "filter_bias": d_chunk.sum(0),
            "hidden": features.T @ d_hidden, "hidden_bias": d_hidden.sum(0),
            "out": hidden.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
        }


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 5) -> ByteNet:
    """Fit on (text, class) rows; a step sees a random stretch of each of its texts."""
    net, draw = ByteNet(), np.random.default_rng(seed)
    target = np.array([label for _, label in rows], np.float32)
    if not len(rows) or target.min() == target.max():
        net.w = {name: np.zeros_like(v) for name, v in net.w.items()}
        return net
    share = target.mean()
    weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam = Adam(net.w, 0.004)
    stretch = 2 * HALF * TRAIN_HALVES - 2 * PAIRS
    steps = max(epochs, -(-400 * BATCH // len(rows)))
    for _ in range(steps):
        order = draw.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            chosen = order[a : a + BATCH]
            begin = [int(draw.integers(max(1, len(rows[i][0]) - stretch + 1))) for i in chosen]
            texts = [rows[i][0][b : b + stretch] for i, b in zip(chosen, begin)]
            adam.update(net.gradients(texts, target[chosen], weight[chosen]))
    return net


def fit(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> ByteNet:
    return train(labelled_sample(documents, labels, label, learn, PER_CLASS, CHARACTERS))


def score(documents: DataFrame, net: ByteNet, keys: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id`` (or ``keys``) and the probability of class 1 of each whole text."""
    return score_texts(documents, keys or {"doc_id": F.col("doc_id")}, net.score, 4 << 20)
