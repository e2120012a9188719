"""Learned operators: held-out accuracy on made texts, gradients, chunks, edge rows."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmirror.llm import common, language, quality, toxicity, training
from tests_llm_texts import ENGLISH, GERMAN, prose


def toxic_rows(many, seed, noise=0.0):
    draw = random.Random(seed)
    insults = ["vilefool", "rotbrain", "scumhead"]
    rows = []
    for i in range(many):
        words = prose(ENGLISH, draw.randint(5, 150), seed * 1000 + i).split()
        label = i % 3 == 0
        if label:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randrange(len(words)), draw.choice(insults))
        rows.append((" ".join(words).encode(), int(label != (draw.random() < noise))))
    return rows


@pytest.mark.parametrize("noise", [0.0, 0.1])
def test_toxic_words_are_found(noise):
    net = toxicity.train(toxic_rows(450, 1, noise))
    held = toxic_rows(150, 2)
    found = net.score([t for t, _ in held]) >= 0.7
    truth = np.array([label for _, label in held], bool)
    assert found[truth].mean() > 0.9 and found[~truth].mean() < 0.1


def test_every_window_counts():
    net = toxicity.train(toxic_rows(450, 1))
    words = prose(ENGLISH, 2000, 3).split()
    for place in (0, 31, 32, 777, 1999):
        text = " ".join([*words[:place], "vilefool rotbrain scumhead", *words[place:]])
        assert net.score([text.encode()])[0] > net.score([" ".join(words).encode()])[0] + 0.3


def test_windows_cover_all_words():
    counts = np.array([0, 1, 32, 33, 56, 57, 500])
    window, first = toxicity.windows(counts, np.arange(counts.sum()))
    ends = np.append(first[1:], len(window))
    begin = np.cumsum(counts) - counts
    for a, b, start, many in zip(first, ends, begin, counts):
        assert set(window[a:b].ravel()) - {-1} == set(range(start, start + many))


def test_network_gradients():
    """Against finite differences, with every word kept and one text."""
    rows = toxic_rows(6, 4)
    net = toxicity.Network()
    target = np.array([label for _, label in rows], np.float32)
    fold = np.arange(6) % toxicity.FOLDS
    net.count(rows, fold)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts = [t[:150] for t, _ in rows[:1]]  # one window, so the windows chosen stay

    class All:
        def random(self, n):
            return np.ones(n)

    def loss():
        counts, codes, found = toxicity.distinct_words(texts)
        window, _ = toxicity.windows(counts, codes)
        vectors, _ = net.inputs(found, np.ones(len(found)), np.zeros(len(found), int))
        logit = net.forward(net.projected(vectors.astype(np.float64)), window)[0][0]
        return float(np.log1p(np.exp(logit)) - target[0] * logit)

    gradient = net.gradients(texts, target[:1], np.ones(1), fold[:1], All())
    for name in ("state_f", "state_b", "in_f", "attend", "attend_out", "out"):
        place = tuple(d // 2 for d in net.w[name].shape)
        before = net.w[name][place]
        values = []
        for step in (1e-3, -1e-3):
            net.w[name][place] = before + step
            values.append(loss())
        net.w[name][place] = before
        assert abs((values[0] - values[1]) / 2e-3 - gradient[name][place]) < 2e-3, name


def quality_rows(many, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(many):
        text = prose(ENGLISH, draw.randint(3, 200), seed * 1000 + i)
        if i % 3 == 0:
            text = " ".join(w + draw.choice(["###", "$$$"]) for w in text.split())
        rows.append((text.encode(), int(i % 3 != 0)))
    return rows


def test_quality_is_learnt():
    net = quality.train(quality_rows(400, 1))
    held = quality_rows(150, 2)
    scores = net.score([t for t, _ in held])
    assert ((scores >= 0.5) == np.array([label for _, label in held], bool)).mean() > 0.95


def test_scores_do_not_depend_on_the_batch():
    net = quality.train(quality_rows(60, 1), epochs=1)
    texts = [t for t, _ in quality_rows(30, 5)] + [b"", b"x" * 5000, b"\0"]
    together = net.score(texts)
    assert np.allclose(together, [net.score([t])[0] for t in texts], atol=1e-5)


def test_chunks_cover_the_whole_text():
    """A mark anywhere in a long text moves the score of a net that looks for it."""
    net = quality.train(quality_rows(400, 1))
    plain = prose(ENGLISH, 1500, 9)
    calm = quality.ByteNet.score(net, [plain.encode()])[0]
    middle = len(plain) // 2
    marked = plain[:middle] + "### $$$ " * 200 + plain[middle:]
    assert net.score([marked.encode()])[0] < calm


def mixed_sequences(languages=("en", "de")):
    return language.train([(prose(w, 80, s), lang) for lang, w in (("en", ENGLISH), ("de", GERMAN)) for s in range(40)])


def test_marginals_against_all_paths():
    draw = np.random.default_rng(1)
    chain = language.Chain(["a", "b", "c"], [])
    chain.w["switch"] = draw.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([4, 1, 0, 3])
    emission = draw.normal(size=(8, 3)).astype(np.float32)
    got = chain.marginals(emission, lengths)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            score = sum(emission[at + t, s] for t, s in enumerate(path))
            score += sum(chain.w["switch"][a, b] for a, b in zip(path, path[1:]))
            for t, s in enumerate(path):
                want[t, s] += np.exp(score)
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def test_gradient_against_finite_differences():
    """Of every kind of weight, with the likelihood taken over all paths."""
    draw = np.random.default_rng(4)
    chain = language.Chain(["a", "b", "c"], ["ab", "ba"])
    for name in chain.w:
        chain.w[name] = draw.normal(size=chain.w[name].shape)
    chain.w["gram"][-1] = chain.w["word"][-1] = 0
    words, lengths = ["ab", "c", "12", "ba", "ab", "x", "cab"], np.array([4, 1, 2])
    truth = np.array([0, 0, 1, 2, 1, 2, 2])
    found = sorted(set(words))
    codes = np.array([found.index(w) for w in words])

    def loss():
        emission = chain.emissions(chain.features(found))[codes].astype(np.float64)
        total, at = 0.0, 0
        for n in lengths.tolist():
            def of(path):
                score = sum(emission[at + t, s] for t, s in enumerate(path))
                return score + sum(chain.w["switch"][a, b] for a, b in zip(path, path[1:]))

            every = [of(path) for path in product(range(3), repeat=n)]
            total += np.log(np.sum(np.exp(every))) - of(truth[at : at + n].tolist())
            at += n
        return total / len(words)

    gradient = chain.gradient(chain.features(found), codes, lengths, truth)
    buckets = np.unique(chain.features(found)[0])
    places = [("gram", (b, s)) for b in buckets[:-1][::3] for s in range(3)]
    places += [(name, at) for name in ("word", "switch") for at in product(range(2 if name == "word" else 3), range(3))]
    places += [("bias", (s,)) for s in range(3)]
    for name, at in places:
        before, values = chain.w[name][at], []
        for step in (1e-2, -1e-2):
            chain.w[name][at] = before + step
            values.append(loss())
        chain.w[name][at] = before
        assert abs((values[0] - values[1]) / 2e-2 - gradient[name][at]) < 2e-3, (name, at)


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "TEXTS", 60)
    rows = [(i, f"text {i} of many", f"l{i % 30}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    taken = language.training_texts(docs, F.lit(True))
    assert len(taken) <= 60 and len({lang for _, lang in taken}) > 20
    assert taken == language.training_texts(docs.repartition(7), F.lit(True))


def test_one_text_of_an_id(spark):
    """An id with very many texts reaches the driver once."""
    docs = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert len(training.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 100)) == 1


def test_switched_texts_have_no_main_language(spark):
    """Texts in one language and with some foreign words stay; those that alternate evenly
    between three, and those in an unwanted one, go."""
    french = "le chien et la maison sont dans une petite rue avec beaucoup de grands arbres".split()
    by = {"en": ENGLISH, "de": GERMAN, "fr": french}
    chain = language.train([(prose(w, 80, s), lang) for lang, w in by.items() for s in range(40)])
    thirds = " ".join(prose(w, 12, s) for s in range(6) for w in by.values())
    mostly = prose(ENGLISH, 70, 1) + " " + prose(GERMAN, 20, 2)
    rows = [(1, prose(ENGLISH, 60, 7)), (2, mostly), (3, thirds), (4, prose(GERMAN, 60, 3)), (5, "123"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in language.keep_known(docs, chain).collect()} == {1, 2, 4}
    assert {r["doc_id"] for r in language.keep_known(docs, chain, wanted=["en"]).collect()} == {1, 2}


def test_languages_are_told_apart():
    chain = mixed_sequences()
    names, scores = chain.label([prose(ENGLISH, 30, 99).encode(), prose(GERMAN, 30, 98).encode(), b"12 !!", b"", "Straße".encode()])
    assert names[:4] == ["en", "de", "und", "und"] and names[4] == "de"
    assert scores[2] == scores[3] == 0 and min(scores[:2]) > 0.9


def test_words_of_a_switched_text():
    chain = mixed_sequences()
    words = prose(ENGLISH, 20, 5).split() + prose(GERMAN, 20, 6).split()
    features = chain.features(words)
    probability = chain.marginals(chain.emissions(features), np.array([40]))
    english = chain.languages.index("en")
    assert (probability[:18, english] > 0.5).all() and (probability[22:, english] < 0.5).all()


def test_edge_rows(spark, edge_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (5, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    everything = F.lit(True)
    nets = [(quality, quality.fit(edge_documents, labels, everything)), (toxicity, toxicity.fit(edge_documents, labels, everything))]
    for module, net in nets:
        rows = module.score(edge_documents, net).collect()
        assert len(rows) == edge_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(no_documents, net).count() == 0
        blank = module.fit(no_documents, labels, everything)
        assert {r["score"] for r in module.score(edge_documents, blank).collect()} == {0.5}
    chain = language.fit(edge_documents, everything)
    rows = {r["doc_id"]: r for r in language.identify(edge_documents, chain).collect()}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {4, 5, 6, 7} | ({None} if rows[None]["lang_pred"] == "und" else set())
    kept = language.keep_known(edge_documents, chain)
    assert kept.columns == edge_documents.columns and kept.count() == edge_documents.count() - 5
    assert language.identify(no_documents, chain).count() == 0
    none = language.fit(no_documents, everything)
    assert {r["lang_pred"] for r in language.identify(edge_documents, none).collect()} == {"und"}


def test_folds(spark):
    ids = [0, 7, 123456789, -5]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    got = [r[0] for r in frame.select(common.fold_of(F.col("doc_id"), 4)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in ids]


def test_long_texts_are_learnt_from(spark):
    """A language or a class whose texts are all long has a stretch of each in the sample."""
    rows = [(i, prose(GERMAN if i % 2 else ENGLISH, 8000 if i % 2 else 50, i), "de" if i % 2 else "en") for i in range(12)]
    docs = spark.createDataFrame([*rows, (99, None, "de")], "doc_id bigint, text string, lang string")
    assert all(len(t) > 20_000 for i, t, _ in rows if i % 2)
    taken = language.training_texts(docs, F.lit(True))
    assert Counter(lang for _, lang in taken) == {"de": 6, "en": 6}
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id bigint, toxic int")
    sample = training.labelled_sample(docs, labels, "toxic", F.lit(True), 5, 6000)
    assert Counter(c for _, c in sample) == {0: 5, 1: 5}
    whole = [r[1] for r in rows]
    for text, bound in [*((t, language.CHARACTERS) for t, _ in taken), *((t.decode(), 6000) for t, _ in sample)]:
        assert len(text) <= bound and any(text in w for w in whole)
    assert len({t[:50] for t, lang in taken if lang == "de"}) == 6
