"""Language of the words of code-switched texts by a linear-chain conditional random field.

A word's score for a language is the sum of learned weights of its hashed character
n-grams (1 to 4), of its prefixes and suffixes (n-grams that touch a word border) and of
its entry in a lexicon of frequent words. Learned transitions join the words, and
forward-backward gives each word's probabilities over the whole text. A text gets the
language with the highest mean over its words with letters; the mean is its score.

Training joins stretches of labelled texts in different languages into switched
sequences, so that transitions are learnt too.

Defined results: a null text or one without a letter is ``und`` with score 0; words
without letters pass the chain on but have no vote; without labelled rows every text is
``und``; repeated rows get equal results; an empty table gives an empty result; further
columns are ignored (``keep_known`` returns them all).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .training import Adam, in_slices, stretch

UNKNOWN = "und"
BUCKETS = 1 << 15  # of each n-gram length and place
LONGEST = 4
LEXICON = 400  # frequent words of each language
# Bounds of the training sample: texts of a language (expected), texts in all, characters
# of a text. With many languages each has fewer texts, down to one.
PER_LANGUAGE, TEXTS, CHARACTERS = 200, 10_000, 8000
MAIN_SHARE = 0.4  # mean probability that makes a language a text's main one
SEQUENCES, WORDS, BATCH, EPOCHS = 3000, 48, 64, 3


def training_texts(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang): each language by the share of hashes it needs."""
    usable = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.where(F.col("lang") != UNKNOWN)
    counts = cut(usable.groupBy("lang").count())
    languages = counts.count()
    wanted = max(1, min(per_language, TEXTS // max(languages, 1)))
    # of each language the rows whose draw is below the share it needs; those with the
    # smallest draws if they are more than the bound
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    shares = counts.select("lang", (F.lit(float(wanted)) / F.col("count")).alias("share"))
    learnt = stretch(F.col("text"), CHARACTERS, F.col("doc_id"), F.col("text")).alias("text")
    drawn = usable.select("lang", draw.alias("draw"), learnt).join(shares, "lang").where("draw < share")
    sample = drawn.orderBy(F.col("draw") / F.col("share"), "text").limit(min(TEXTS, 2 * wanted * languages))
    return sorted((r["text"], r["lang"]) for r in sample.collect())


def ngrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each character of ``^word$`` (one column a
    length; the last bucket: none) and where each word begins."""
    joined = "".join(f"^{w}$" for w in found)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in found), np.int64, len(found))
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(code))  # characters up to the word's end
    buckets = np.full((len(code), LONGEST), LONGEST * BUCKETS, np.int64)
    value = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        size = max(len(code) - n + 1, 0)
        value = value[:size] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        hashed = (value ^ value >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)
        buckets[:size, n - 1] = np.where(left[:size] >= n, (n - 1) * BUCKETS + hashed.astype(np.int64), LONGEST * BUCKETS)
    return buckets, starts


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def bare(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}<>*#|")


class Chain:
    def __init__(self, languages: list[str], lexicon: list[str]):
        n = len(languages)
        self.languages = languages
        self.lexicon = {word: i for i, word in enumerate(lexicon)}
        self.w = {
            "gram": np.zeros((LONGEST * BUCKETS + 1, n), np.float32),
            "word": np.zeros((len(lexicon) + 1, n), np.float32),
            "bias": np.zeros(n, np.float32),
            "switch": (2.0 * np.eye(n)).astype(np.float32),
        }

    def features(self, found: list[str]):
        plain = [bare(w) for w in found]
        buckets, starts = ngrams(plain)
        entries = np.fromiter((self.lexicon.get(w, -1) for w in plain), np.int64, len(plain))
        letters = np.fromiter(map(has_letter, plain), bool, len(plain))
        return buckets, starts, entries, letters

    def emissions(self, features) -> np.ndarray:
        """Score of each word for each language; 0 without a letter."""
        buckets, starts, entries, letters = features
        at = self.w["gram"][buckets[:, 0]]
        for n in range(1, LONGEST):
            at += self.w["gram"][buckets[:, n]]
        score = np.add.reduceat(at, starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)))
        return ((score + self.w["word"][entries] + self.w["bias"]) * letters[:, None]).astype(np.float32)

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each language at each word; sequences stand one after another."""
        return self.expectations(emission, lengths)[0]

    def expectations(self, emission: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The marginals and, with ``pairs``, the expected number of each transition."""
        moved = np.zeros_like(self.w["switch"], dtype=np.float64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        starts = (np.cumsum(lengths[np.argsort(order)]) - lengths[np.argsort(order)])[order]
        seen = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
        switch = np.exp(self.w["switch"] - self.w["switch"].max())
        # sequences that are longer than t stand first
        active = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")
        forward = np.empty_like(seen)
        state = np.ones((len(lengths), seen.shape[1]), np.float32)
        for t, n in enumerate(active.tolist()):
            at = starts[:n] + t
            state = (state[:n] @ switch if t else state[:n]) * seen[at]
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        back = np.ones((len(lengths), seen.shape[1]), np.float32)
        out = np.empty_like(seen)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            both = forward[at] * back[:n]
            out[at] = both / both.sum(axis=1, keepdims=True)
            onward = seen[at] * back[:n]
            if pairs and t:
                # what leads here, the step, and what goes on from here
                pair = forward[at - 1][:, :, None] * switch * onward[:, None, :]
                moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            state = onward @ switch.T
            back[:n] = state / state.sum(axis=1, keepdims=True)
        return out, moved

    def gradient(self, features, codes: np.ndarray, lengths: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of minus the log-likelihood of the labels ``truth``, per word. ``features`` are those
        of distinct words, ``codes`` which of them stands where."""
        buckets, starts, entries, letters = features
        many = len(self.languages)
        marginal, moved = self.expectations(self.emissions(features)[codes], lengths, pairs=True)
        error = np.zeros((len(letters), many), np.float32)
        np.add.at(error, codes, (marginal - np.eye(many, dtype=np.float32)[truth]) * letters[codes][:, None])
        error /= len(codes)
        gram, word = np.zeros_like(self.w["gram"]), np.zeros_like(self.w["word"])
        spread = np.repeat(error, np.diff(np.append(starts, len(buckets))), axis=0)
        for n in range(LONGEST):
            np.add.at(gram, buckets[:, n], spread)
        gram[-1] = 0  # of places without an n-gram, and of words outside of the lexicon
        np.add.at(word, entries, error)
        word[-1] = 0
        inner = np.ones(len(codes), bool)
        inner[np.cumsum(lengths) - 1] = False
        at = np.flatnonzero(inner)
        real = np.zeros_like(moved)
        np.add.at(real, (truth[at], truth[at + 1]), 1)
        switch = ((moved - real) / len(codes)).astype(np.float32)
        return {"gram": gram, "word": word, "bias": error.sum(0), "switch": switch}

    def label(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        split = [t.decode("utf-8", "replace").split() for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        flat = np.empty(int(lengths.sum()), object)
        flat[:] = [w for s in split for w in s]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not len(flat) or not self.languages:
            return names, scores
        codes, found = pd.factorize(flat)
        features = self.features(list(found))
        probability = self.marginals(self.emissions(features)[codes], lengths) * features[3][codes][:, None]
        some = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[some]
        mass = np.add.reduceat(probability.astype(np.float64), starts, axis=0)
        votes = np.add.reduceat(features[3][codes].astype(np.int64), starts)
        for i, row, n in zip(some.tolist(), mass, votes.tolist()):
            if n:
                best = int(row.argmax())
                names[i], scores[i] = self.languages[best], min(1.0, row[best] / n)
        return names, scores


def train(rows: list[tuple[str, str]], seed: int = 5) -> Chain:
    languages = sorted({lang for _, lang in rows})
    by_language = {lang: [text.split() for text, own in rows if own == lang] for lang in languages}
    by_language = {lang: [t for t in texts if t] for lang, texts in by_language.items()}
    frequent: list[str] = []
    for texts in by_language.values():
        counts = Counter(bare(w) for words in texts for w in words)
        frequent += [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]]
    chain, draw = Chain(languages, sorted(set(frequent))), np.random.default_rng(seed)
    if sum(map(bool, by_language.values())) == 0:
        return Chain([], [])
    usable = [i for i, lang in enumerate(languages) if by_language[lang]]
    adam = Adam(chain.w, 0.02)
    for _ in range(EPOCHS * SEQUENCES // BATCH):
        words, truth, lengths = [], [], []
        for _ in range(BATCH):
            size = 0
            while size < WORDS:
                lang = usable[draw.integers(len(usable))]
                texts = by_language[languages[lang]]
                text = texts[draw.integers(len(texts))]
                many = int(draw.integers(4, 33))
                begin = int(draw.integers(max(1, len(text) - many + 1)))
                part = text[begin : begin + many]
                words += part
                truth += [lang] * len(part)
                size += len(part)
            lengths.append(size)
        codes, found = pd.factorize(np.array(words, object))
        adam.update(chain.gradient(chain.features(list(found)), codes, np.array(lengths), np.array(truth)))
    return chain


def identify(documents: DataFrame, chain: Chain, keys: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id`` (or ``keys``), ``lang_pred`` and ``score`` of each whole text."""
    keys = keys or {"doc_id": F.col("doc_id")}
    source = documents.select(*[c.alias(name) for name, c in keys.items()], F.col("text").cast("binary").alias("_text"))
    schema = source.drop("_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [], [np.empty(0)]
            for part in in_slices(batch.column("_text"), 6 << 20):
                found, score = chain.label(part)
                labels += found
                scores.append(score)
            columns = [batch.column(n) for n in names] + [pa.array(labels, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def fit(documents: DataFrame, learn: Column) -> Chain:
    return train(training_texts(documents, learn))


def keep_known(documents: DataFrame, chain: Chain, at_least: float = MAIN_SHARE, wanted: list[str] | None = None) -> DataFrame:
    """The rows of ``documents`` whose text has a main language, in any column order: the
    words' mean probability reaches ``at_least``, and it is one of ``wanted`` if given. Texts
    in no language and those that are switched so much that none has that share go."""
    labelled = identify(documents, chain, {"row": F.struct("*")})
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= at_least)
    if wanted is not None:
        known = known & F.col("lang_pred").isin(wanted)
    return labelled.where(known).select("row.*")
