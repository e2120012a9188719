"""License scan: against a plain model, on edited notices and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkmirror.llm import licenses


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def model(text):
    """What a scan of one text gives, by comparing all windows with all windows."""
    w = words(text)
    base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    verified = []
    for number, (label, template) in enumerate(licenses.TEMPLATES):
        t = words(template)
        votes = {}
        for i in range(len(w) - 2):
            for j in range(len(t) - 2):
                if w[i : i + 3] == t[j : j + 3]:
                    votes.setdefault(i - j, []).append((i, j))
        clusters = []
        for diagonal in sorted(votes):
            if not clusters or diagonal - clusters[-1][0] > 4:
                clusters.append([diagonal, []])
            clusters[-1][0] = diagonal
            clusters[-1][1] += votes[diagonal]
        for _, met in clusters:
            covered = len({j + k for _, j in met for k in range(3)})
            first, last = min(i for i, _ in met), max(i for i, _ in met) + 2
            if (covered >= 0.75 * len(t) or covered >= 40) and covered >= 0.75 * (last - first + 1):
                verified.append((first, last, number, label, covered, len(t)))
    islands, reach = [], -1
    for span in sorted(verified):
        if span[0] > reach:
            islands.append([])
        islands[-1].append(span)
        reach = max(reach, span[1])
    found = []
    for island in islands:
        best = max((s[4], -s[5]) for s in island)
        found += [s for s in island if (s[4], -s[5]) == best]
    places = [i for i, _ in base]
    labels = {label for _, label in base}
    score = max([0.5 if base else 0.0, *[s[4] / s[5] for s in found]])
    return (
        len(w), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {s[3] for s in found})), score,
    )


def scanned(frame):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return {r["doc_id"]: tuple(r[n] for n in names) for r in licenses.scan(frame).collect()}


def edited(text, draw, changes):
    w = text.split()
    for _ in range(changes):
        at = draw.randrange(len(w))
        w[at : at + draw.randint(0, 1)] = draw.sample(["really", "some"], draw.randint(0, 1))
    return " ".join(w)


def test_against_comparing_all_windows(spark):
    draw = random.Random(3)
    filler = "the software is provided under a license of any kind and may be used by this file free of charge".split()
    texts = []
    for i in range(150):
        parts = [" ".join(draw.choices(filler, k=draw.randint(0, 60)))]
        for _ in range(draw.randint(0, 3)):
            parts += [edited(draw.choice(licenses.TEMPLATES)[1], draw, draw.choice([0, 0, 1, 2, 6])), " ".join(draw.choices(filler, k=draw.randint(0, 9)))]
        texts.append(" ".join(parts))
    texts += [" ".join(["Released under the MIT License."] * 400), "x " * 5000 + licenses.TEMPLATES[3][1] + " y" * 5000]
    got = scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for i, text in enumerate(texts):
        want = model(text)
        assert got[i][:-1] == want[:-1], text
        assert got[i][-1] == pytest.approx(want[-1])


@pytest.mark.parametrize("label, text", licenses.TEMPLATES)
def test_each_template_is_itself(label, text):
    """No template is taken for another license, whole or with a word changed, and none is too short for the gap."""
    assert len(words(text)) > licenses.GAP
    bare = model("before it " + text + " behind it")
    assert set(bare[5].split(",")) - set(bare[4].split(",")) <= {label} and label in bare[5].split(",") and bare[6] == 1.0


def test_merged_diagonals(spark):
    """A notice with words put in and left out is one span."""
    w = licenses.TEMPLATES[1][1].split()
    text = " ".join(w[:40] + ["really"] + w[40:80] + w[82:])
    keyed = spark.createDataFrame([(1, text)], "doc_id bigint, text string").select("doc_id", licenses.normal(F.col("text")).alias("normal"))
    (span,) = licenses.spans(keyed, ["doc_id"]).collect()
    assert span["label"] == "mit" and span["first"] == 0 and span["last"] == len(words(text)) - 1 and span["covered"] == span["size"] - 2


def test_only_ascii_letters_are_lowered(spark):
    """The Kelvin sign and other capitals beyond ASCII are no ASCII letters."""
    texts = ["Licensed under CC BY-NC 4.0", "This wor\u212a is licensed under the GNU General Public License, version 3", "M\u0130T License", "MIT\u00a0License É"]
    got = scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for i, text in enumerate(texts):
        assert got[i][:-1] == model(text)[:-1] and got[i][-1] == pytest.approx(model(text)[-1])


def test_own_templates_and_phrases(spark):
    frame = spark.createDataFrame([(1, "We use the ACME open terms of 2020, as agreed. See acme terms.")], "doc_id bigint, text string")
    (row,) = licenses.scan(frame, [("acme", "the acme open terms of 2020")], {"acme terms": "short"}).collect()
    assert (row["labels"], row["base_labels"], row["n_base"], row["first_word"]) == ("acme,short", "short", 1, 11)


def test_edge_rows(spark, edge_documents, no_documents):
    rows = licenses.scan(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    want = sorted((repr(r["doc_id"]), *model(r["text"])[:6]) for r in edge_documents.collect())
    got = [(repr(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.scan(no_documents).count() == 0


def test_repeated_rows_and_a_frequent_line(spark):
    line = "Licensed under CC BY-NC 4.0."
    frame = spark.createDataFrame([(1, line)] * 50 + [(None, line)] * 50 + [(i, f"{i} {line}") for i in range(2, 500)], "doc_id bigint, text string")
    rows = licenses.scan(frame).collect()
    assert len(rows) == frame.count() and {(r["labels"], r["score"]) for r in rows} == {("cc-by-nc", 1.0)}


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = licenses.scan(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
