"""Toxicity of whole texts by a bidirectional gated recurrent network in numpy.

A word enters by its hashed form and by its hashed character trigrams: each with a
learned vector and with how surely the training texts tie it to a class (a shrunk log
odds ratio over its standard error; while training, from the other folds of the texts). Windows of 32 words, every 24, cover the whole text. In
each window a gated recurrent layer runs in both directions, attention pools its states
and one logit comes out; a text scores as its most toxic window. A label does not say where
the insult stands, so training takes two windows of each text: the one that scores
highest and the one whose words tie most to toxic texts.

Defined results: null and blank texts are one window without words; without labelled
rows of both classes every score is 0.5; repeated rows get equal scores; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import Adam, labelled_sample, score_texts, sigmoid

WINDOW, STRIDE = 32, 24
WORDS, GRAMS = 8192, 4096  # hash buckets
WORD_SIZE, GRAM_SIZE, STATE = 8, 8, 12
FOLDS = 5
SHRINK = 8.0  # texts that a bucket's log odds start from
# Bound of the training sample: texts of each class, and characters of a text.
PER_CLASS, CHARACTERS = 1000, 6000
EPOCHS, BATCH, RATE = 4, 16, 0.01
WITHOUT_WORD = 0.2  # share of words that enter training by their characters alone

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = b".,;:!?\"'()[]{}<>*"


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number of words of each text, the words as indices, and the distinct words."""
    split = [t.translate(_LOWER).split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for s in split for w in s]
    codes, found = pd.factorize(flat)
    return counts, codes, list(found)


def word_parts(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its bucket; of all words the trigram buckets, and where each begins."""
    bare = [w.strip(_EDGE) or w for w in found]
    buckets = np.fromiter((zlib.crc32(w) % WORDS for w in bare), np.int64, len(bare))
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in bare), np.uint8).astype(np.int64)
    lengths = np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare))
    grams = (data[:-2] * 7919 + data[1:-1] * 263 + data[2:]) * 2654435761 >> 8 & (GRAMS - 1)
    ends = np.cumsum(lengths)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that would reach into the next word
    counts = np.maximum(lengths - 2, 1)
    return buckets, grams[inside[:-2]], np.cumsum(counts) - counts


def windows(counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of each window (-1: none) and the first window of each text."""
    many = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    first = np.cumsum(many) - many
    nth = np.arange(many.sum()) - np.repeat(first, many)
    at = nth[:, None] * STRIDE + np.arange(WINDOW)
    inside = at < np.repeat(counts, many)[:, None]
    at = np.where(inside, at + np.repeat(np.cumsum(counts) - counts, many)[:, None], 0)
    return np.where(inside, codes[at] if len(codes) else -1, -1), first


class Network:
    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        inputs = self.size = WORD_SIZE + GRAM_SIZE + 2
        # training texts of either class that have the bucket: all, and by fold
        self.seen = {"word": np.zeros((2, WORDS), np.float32), "gram": np.zeros((2, GRAMS), np.float32)}
        self.texts = np.ones(2)
        self.folds: tuple | None = None
        self.w = {"word": normal(WORDS, WORD_SIZE, scale=0.05), "gram": normal(GRAMS, GRAM_SIZE, scale=0.05)}
        for side in "fb":
            self.w["in_" + side] = normal(inputs, 3 * STATE, scale=0.3)
            self.w["bias_" + side] = np.zeros(3 * STATE, np.float32)
            self.w["state_" + side] = normal(STATE, 3 * STATE, scale=0.3)
        self.w |= {
            "attend": normal(2 * STATE, STATE, scale=0.3),
            "attend_out": normal(STATE, scale=0.3),
            "out": normal(2 * STATE, scale=0.3),
            "out_bias": np.zeros(1, np.float32),
        }

    def tie(self, kind: str, buckets: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        """How surely a bucket speaks for a toxic text, judged without the texts of
        ``fold``. Unseen buckets give 0."""
        seen, texts = self.seen[kind][:, buckets], self.texts[:, None]
        if fold is not None:
            seen = seen - self.folds[0][kind][fold, :, buckets].T
            texts = texts - self.folds[1][fold].T
        seen = seen + SHRINK * texts / texts.sum(axis=0)
        rate = seen / texts
        return np.log(rate[1] / rate[0]) / np.sqrt(1 / seen[0] + 1 / seen[1]) / 4

    def count(self, rows: list[tuple[bytes, int]], fold: np.ndarray) -> None:
        by_fold = {k: np.zeros((FOLDS, *v.shape), np.float32) for k, v in self.seen.items()}
        texts = np.zeros((FOLDS, 2))
        for (text, label), part in zip(rows, fold):
            texts[part, label] += 1
            found = distinct_words([text])[2]
            if found:
                buckets, grams, _ = word_parts(found)
                by_fold["word"][part, label, np.unique(buckets)] += 1
                by_fold["gram"][part, label, np.unique(grams)] += 1
        self.seen = {k: v.sum(axis=0) for k, v in by_fold.items()}
        self.texts = np.maximum(texts.sum(axis=0), 1)
        self.folds = by_fold, np.minimum(texts, self.texts - 1)

    def __getstate__(self):
        return self.__dict__ | {"folds": None}  # scoring needs the sums only

    def inputs(self, found: list[bytes], keep: np.ndarray | None = None, fold: np.ndarray | None = None):
        """Input vectors of the distinct words and one of zeros for no word."""
        if not found:
            return np.zeros((1, self.size), np.float32), None
        buckets, grams, starts = word_parts(found)
        many = np.diff(np.append(starts, len(grams)))
        if fold is None:
            gram_tie = self.tie("gram", np.arange(GRAMS))[grams]
        else:
            gram_tie = self.tie("gram", grams, np.repeat(fold, many))
        by_gram = np.hstack([self.w["gram"][grams], gram_tie[:, None].astype(np.float32)])
        mean = np.add.reduceat(by_gram, starts, axis=0) / many[:, None]
        word = np.hstack([self.w["word"][buckets], self.tie("word", buckets, fold)[:, None]])
        if keep is not None:
            word = word * keep[:, None]
        vectors = np.vstack([np.hstack([word, mean]), np.zeros((1, self.size))])
        return vectors.astype(np.float32), (buckets, grams, many)

    def run(self, side: str, projected: np.ndarray, window: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (time, window, state) of one direction; ``trace`` keeps what training needs."""
        states = np.zeros((WINDOW, len(window), STATE), np.float32)
        h = np.zeros((len(window), STATE), np.float32)
        recur = self.w["state_" + side]
        for t in range(WINDOW) if side == "f" else reversed(range(WINDOW)):
            word = window[:, t]
            there = (word >= 0)[:, None]
            x = projected[word]
            u = h @ recur
            gates = sigmoid(x[:, : 2 * STATE] + u[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            c = np.tanh(x[:, 2 * STATE :] + r * u[:, 2 * STATE :])
            new = np.where(there, c + z * (h - c), h)
            if trace is not None:
                trace.append((t, h, z, r, c, u[:, 2 * STATE :], there))
            states[t] = h = new
        return states

    def forward(self, projected: dict[str, np.ndarray], window: np.ndarray, traces: dict[str, list] | None = None):
        runs = [self.run(s, projected[s], window, None if traces is None else traces[s]) for s in "fb"]
        states = np.concatenate(runs, axis=2)
        seen = np.tanh(states @ self.w["attend"])
        weight = seen @ self.w["attend_out"]
        weight = np.where(window.T >= 0, weight, -30.0)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tw,tws->ws", weight, states)
        return pooled @ self.w["out"] + self.w["out_bias"], (states, seen, weight, pooled)

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {s: vectors @ self.w["in_" + s] + self.w["bias_" + s] for s in "fb"}

    def score(self, texts: list[bytes]) -> np.ndarray:
        counts, codes, found = distinct_words(texts)
        window, first = windows(counts, codes)
        projected = self.projected(self.inputs(found)[0])
        step = 4096
        logit = np.concatenate([self.forward(projected, window[a : a + step])[0] for a in range(0, len(window), step)])
        return sigmoid(np.maximum.reduceat(logit, first))

    def gradients(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray, fold: np.ndarray, draw) -> dict[str, np.ndarray]:
        w = self.w
        # words are distinct by text here, as their log odds are
        each = [distinct_words([t]) for t in texts]
        sizes = np.array([len(found) for _, _, found in each])
        counts = np.concatenate([c for c, _, _ in each])
        codes = np.concatenate([c + o for (_, c, _), o in zip(each, np.cumsum(sizes) - sizes)])
        found = [word for _, _, own in each for word in own]
        every, first = windows(counts, codes)
        keep = (draw.random(len(found)) >= WITHOUT_WORD).astype(np.float32)
        vectors, parts = self.inputs(found, keep, np.repeat(fold, sizes))
        projected = self.projected(vectors)
        logit, _ = self.forward(projected, every)
        ends = np.append(first[1:], len(every))
        tie = np.maximum(vectors[:, WORD_SIZE], 0)[every].sum(axis=1)  # no word is the last, a zero
        window = every[[a + int(by[a:b].argmax()) for by in (logit, tie) for a, b in zip(first, ends)]]
        target, weight = np.tile(target, 2), np.tile(weight, 2)
        traces: dict[str, list] = {"f": [], "b": []}
        logit, (states, seen, attention, pooled) = self.forward(projected, window, traces)
        d_logit = ((sigmoid(logit) - target) * weight / len(window)).astype(np.float32)
        d_pooled = np.outer(d_logit, w["out"])
        d_states = attention[:, :, None] * d_pooled
        d_weight = np.einsum("tws,ws->tw", states, d_pooled)
        d_weight = attention * (d_weight - (attention * d_weight).sum(axis=0))
        d_seen = d_weight[:, :, None] * w["attend_out"] * (1 - seen**2)
        d_states += d_seen @ w["attend"].T
        g = {
            "out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
            "attend": np.einsum("tws,twa->sa", states, d_seen), "attend_out": np.einsum("twa,tw->a", seen, d_weight),
        }
        d_vectors = np.zeros_like(vectors)
        for n, side in enumerate("fb"):
            d_projected = np.zeros_like(projected[side])
            d_recur = np.zeros_like(w["state_" + side])
            d_h = np.zeros((len(window), STATE), np.float32)
            for t, h, z, r, c, u, there in reversed(traces[side]):
                d_h = d_h + d_states[t, :, n * STATE : (n + 1) * STATE]
                moved = d_h * there
                d_c = moved * (1 - z) * (1 - c * c)
                d_z = moved * (h - c) * z * (1 - z)
                d_r = d_c * u * r * (1 - r)
                into = np.hstack([d_z, d_r, d_c])
                np.add.at(d_projected, window[:, t], into)
                d_u = np.hstack([d_z, d_r, d_c * r])
                d_recur += h.T @ d_u
                d_h = d_h * ~there + moved * z + d_u @ w["state_" + side].T
            d_projected[-1] = 0 if not found else d_projected[-1]
            g["in_" + side] = vectors.T @ d_projected
            g["bias_" + side] = d_projected.sum(0)
            g["state_" + side] = d_recur
            d_vectors += d_projected @ w["in_" + side].T
        g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        if found:
            buckets, grams, many = parts
            np.add.at(g["word"], buckets, d_vectors[:-1, :WORD_SIZE] * keep[:, None])
            d_gram = d_vectors[:-1, WORD_SIZE + 1 : -1] / many[:, None]
            np.add.at(g["gram"], grams, np.repeat(d_gram, many, axis=0))
        return g


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 5) -> Network:
    net, draw = Network(), np.random.default_rng(seed)
    target = np.array([label for _, label in rows], np.float32)
    if not len(rows) or target.min() == target.max():
        net.w = {name: np.zeros_like(v) for name, v in net.w.items()}
        return net
    # folds with an equal share of either class
    rank = np.argsort(np.argsort(target, kind="stable"), kind="stable")
    fold = rank % FOLDS
    net.count(rows, fold)
    share = target.mean()
    weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam = Adam(net.w, RATE, {"word": 5.0, "gram": 5.0})
    rounds = max(epochs, -(-200 * BATCH // len(rows)))
    for n in range(rounds):
        adam.rate = RATE * (1 - 0.9 * n / rounds)
        order = draw.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            chosen = order[a : a + BATCH]
            adam.update(net.gradients([rows[i][0] for i in chosen], target[chosen], weight[chosen], fold[chosen], draw))
    return net


def fit(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Network:
    return train(labelled_sample(documents, labels, label, learn, PER_CLASS, CHARACTERS))


def score(documents: DataFrame, net: Network, keys: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id`` (or ``keys``) and the score of each whole text."""
    return score_texts(documents, keys or {"doc_id": F.col("doc_id")}, net.score, 3 << 20)
