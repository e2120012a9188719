"""Decontamination: planted passages, changed values, brute force over all pairs."""

import random
import re

from inkmirror.llm import decontaminate

QUESTION = "A farmer named Anna has 12 apples and gives 5 kg of pears to Anna before walking 3.5 km to town."
CHANGED = "A farmer named Otto has 40 apples and gives 7 kg of pears to Otto before walking 2 km to town."
SCRAMBLED = "A farmer named Otto has 40 apples and gives 7 kg of pears to Egon before walking 2 km to town."


def found(spark, documents, items):
    docs = spark.createDataFrame(documents, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_planted_and_changed(spark):
    noise = "plain words that say nothing of the sort and go on for a while"
    documents = [
        (1, f"{noise}. {QUESTION} {noise}"),
        (2, f"{noise}: {CHANGED.lower().replace('otto', 'Otto')} {noise}"),
        (3, f"{noise} {SCRAMBLED} {noise}"),
        (4, noise),
        (5, QUESTION.upper().lower()),
        (6, None),
        (7, ""),
        (8, "A farmer named Otto"),
    ]
    got = found(spark, documents, [(10, QUESTION), (11, None), (12, "")])
    assert {(1, 10), (2, 10)} <= got
    assert not {d for d, _ in got} & {3, 4, 6, 7, 8}


def windows(text, n=5):
    words = re.findall(r"\S+", re.sub(r"[.,]", "", text.lower()))
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def test_against_all_pairs(spark):
    """Lower-case words without values: windows on one alignment, by brute force."""
    draw = random.Random(2)
    words = [f"{a}{b}" for a in "bdfgk" for b in ("a", "e", "o")]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(3, 30)))) for i in range(20)]
    documents = []
    for d in range(80):
        text = draw.choices(words, k=draw.randint(0, 40))
        if d % 2:
            part = items[draw.randrange(20)][1].split()
            begin = draw.randrange(len(part))
            at = draw.randrange(len(text) + 1)
            text[at:at] = part[begin : begin + draw.randint(1, 30)]
        documents.append((d, " ".join(text)))
    want = set()
    for d, text in documents:
        if not text:
            continue
        mine = windows(text)
        for i, item in items:
            theirs = windows(item)
            count = {}
            for p, w in enumerate(mine):
                for q, v in enumerate(theirs):
                    if w == v:
                        count[p - q] = count.get(p - q, 0) + 1
            if any(2 * c >= len(theirs) or c + 4 >= 13 for c in count.values()):
                want.add((d, i))
    assert found(spark, documents, items) == want


def test_sent_and_shuffled_windows_agree(spark, monkeypatch):
    documents = [(1, QUESTION), (2, "nothing"), (3, CHANGED)]
    first = found(spark, documents, [(1, QUESTION)])
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", 0)
    assert found(spark, documents, [(1, QUESTION)]) == first == {(1, 1), (3, 1)}


def test_edge_rows(spark, edge_documents, no_documents):
    bench = edge_documents.where("doc_id = 2").selectExpr("doc_id AS item_id", "text", "size")
    kept = decontaminate.keep_clean(edge_documents, bench)
    assert kept.columns == edge_documents.columns
    assert kept.count() == edge_documents.count() - 1
    assert decontaminate.keep_clean(edge_documents, bench.limit(0)).count() == edge_documents.count()
    assert decontaminate.contaminated(no_documents, bench).count() == 0


def test_a_slot_conflict_costs_its_windows_only(spark):
    """A value that occurs twice, one of the two changed; equal numbers for different ones."""
    second = "Otto".join(QUESTION.rsplit("Anna", 1))
    numbers = "After Monday the small shop sold {} red boats and then the old woman in blue shoes bought {} more for her son at home"
    documents = [(1, second), (2, numbers.format(3, 3)), (3, SCRAMBLED)]
    assert found(spark, documents, [(10, QUESTION), (11, numbers.format(3, 5))]) == {(1, 10), (2, 11)}


def test_copies_in_another_case(spark):
    """Names are known by their capitals, copies without regard to them."""
    documents = [(4, "plain words that say nothing"), (5, QUESTION.upper().lower()), (6, QUESTION.upper()), (7, QUESTION.title())]
    assert found(spark, documents, [(10, QUESTION)]) == {(5, 10), (6, 10), (7, 10)}


def test_inserted_words_and_names_of_other_length(spark):
    """Copies in pieces that stand some words apart."""
    words = [f"{a}{b}" for a in "bdfgklmnpr" for b in ("aba", "ebe", "ibi", "obo")]
    short, long = words[:24], words[2:38]
    trip = "the train from {} goes past the old mill and reaches the coast after {} hours"
    documents = [
        (1, " ".join([*short[:12], "more", *short[12:]])),
        (2, " ".join([*long[:12], "more", *long[12:24], "more", *long[24:]])),
        (3, " ".join([*short[:11], *short[13:]])),
        (4, "we heard that " + trip.format("New York", 7)),
        (5, " ".join([*short[:7], *["more"] * 40, *short[17:]])),
    ]
    items = [(10, " ".join(short)), (11, " ".join(long)), (12, trip.format("Paris", 3)), (13, "so " + trip.format("Rio de Janeiro", 2))]
    got = found(spark, documents, items)
    assert {(1, 10), (2, 11), (3, 10), (4, 12)} <= got
    assert 5 not in {d for d, _ in got}


def test_a_name_of_two_words_is_one(spark):
    item = "we left Paris by night and saw Rome at dawn"
    documents = [(1, "we left New York by night and saw San Marino at dawn"), (2, "we left New York by day and then New York at dusk")]
    assert found(spark, documents, [(10, item)]) == {(1, 10)}
    assert found(spark, [(3, item), (4, documents[0][1].lower())], [(11, documents[0][1])]) == {(3, 11), (4, 11)}
