"""Operators against sequential models on random small inputs."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

import model
from inkmirror.operators import decide, images, naming, requests, scans, state, tree
from inkmirror.sources import index_store, landing, listings


@pytest.mark.parametrize("group_rows", [3, 1_000_000])
def test_fold_equals_the_loop(spark, group_rows):
    """Also where one document owns a third of all rows and is cut into ranges."""
    rng = random.Random(7)
    docs = ["hot"] * 300 + [f"d{rng.randrange(200)}" for _ in range(600)]
    rng.shuffle(docs)
    rows = [(seq, doc, rng.choice([0, rng.randrange(1, 40)]), rng.random() < 0.6) for seq, doc in enumerate(docs)]
    index = {f"d{i}": rng.choice([0, 5, 20]) for i in range(0, 200, 3)}
    want, final = model.fold([(d, t, ok) for _, d, t, ok in rows], index)
    feed = spark.createDataFrame(rows, "seq BIGINT, doc_id STRING, t BIGINT, ok BOOLEAN")
    entries = [(d, f"p/{d}", "k", "t", 0, str(s or ""), "x") for d, s in index.items()]
    known = spark.createDataFrame(entries, index_store.INDEX)
    got = decide.fold_actions(feed, known, group_rows).orderBy("seq").collect()
    assert [r["action"] for r in got] == want
    written = [(r["doc_id"], r["seq"], r["t"]) for r in got if r["action"] != "skip" and r["ok"]]
    last = {d: t for d, _, t in sorted(written, key=lambda w: w[1])}
    assert {**index, **last} == final


@pytest.mark.parametrize("seed", range(2))
def test_fold_of_documents_that_may_come_again(spark, seed):
    """The same actions, whether or not those that occur once are told apart; missing ids are one document."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, *[f"d{i}" for i in range(40)]]), seq, rng.randrange(5), rng.random() < 0.7) for seq in range(60)]
    feed = spark.createDataFrame(rows, "doc_id STRING, seq BIGINT, t BIGINT, ok BOOLEAN")
    index = spark.createDataFrame([(f"d{i}", "p", str(i % 4)) for i in range(0, 40, 2)], "doc_id STRING, path STRING, update_time STRING")
    marked = scans.with_again(feed, "doc_id")
    often = {d for d in {r[0] for r in rows} if sum(r[0] == d for r in rows) > 1}
    assert often and all(r["again"] for r in marked.collect() if r["doc_id"] in often) and marked.where("NOT again").count()
    want = [r["action"] for r in decide.fold_actions(feed, index, 3).orderBy("seq").collect()]
    assert [r["action"] for r in decide.fold_actions(marked, index, 3).orderBy("seq").collect()] == want


def test_folders_beyond_a_window_group(spark):
    """Numbers and visits do not depend on how many rows a folder may hold; documents and
    folders of one place and id included."""
    rows = [("k", f"folder_{i}", "" if i < 2 else f"folder_{i % 2}", f"t{i}", 99, i % 3) for i in range(6)]
    rows += [("k", f"d{i}", f"folder_{i % 6}", "x", 6, i % 4) for i in range(40)] + [("k", "same", "folder_1", "x", 6, 2)] * 2
    items = spark.createDataFrame(rows, "kb_id STRING, media_id STRING, parent_folder_id STRING, title STRING, media_type INT, pos BIGINT")
    bases = spark.createDataFrame([("k", "K", 0)], "kb_id STRING, kb_name STRING, kb_pos INT")
    folders, _ = tree.expand_folders(items, bases, "root")
    placed = tree.place_items(items, folders)
    got = []
    for group_rows in (1, 5, 1000):
        numbered, starts = tree.walk(placed, folders, group_rows=group_rows)
        got.append((
            [(r["seq"], r["media_id"], r["parent_path"]) for r in numbered.orderBy("seq").collect()],
            sorted((r["node"], r["seq"], r["visit"]) for r in starts.collect()),
        ))
    assert got[0] == got[1] == got[2] and [r[0] for r in got[0][0]] == list(range(42))


def test_hot_key_is_split_over_groups(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    out = scans.running_before(rows, ["k"], "seq", {"n": ("sum", F.lit(1)), "m": ("max", F.col("seq"))}, 100)
    assert out.where("n <> seq OR m <> seq - 1").count() == 0
    assert out.where("n IS NULL").count() == 0 and out.count() == 1000


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_the_loop(spark, seed):
    """Cascades: one document's fallback name is another one's title."""
    rng = random.Random(seed)
    ids = [f"aaaabbbb{i}" if rng.random() < 0.5 else f"c{i}" for i in range(60)]
    bases = ["x", "x-aaaabbbb", "x-c1", "x-c2", "y", "x-aaaabbbb1", "x-aaaabbbb-aaaabbbb"]
    rows = [(i, doc, rng.choice(["p", "q"]), rng.choice(bases)) for i, doc in enumerate(ids)]
    rows.append((60, "c2", "q", "x"))  # all of its names are taken
    taken = ["p/y.md", "q/x.md", "q/x-c2.md", "p/x-c2-c2.md", "p/x-aaaabbbb-aaaabbbb5.md"]
    want = model.claims(rows, taken)
    frame = spark.createDataFrame(rows, "seq BIGINT, doc_id STRING, parent STRING, base STRING")
    paths = spark.createDataFrame([(p,) for p in taken], "path STRING")
    got = {r["seq"]: (r["name"], r["path"], r["clash"]) for r in naming.claim_paths(frame, paths).collect()}
    assert got == want
    assert want[60][2]


def test_many_documents_with_one_title(spark):
    rows = spark.range(500).select(
        F.col("id").alias("seq"), F.concat(F.lit("identical"), "id").alias("doc_id"), F.lit("p").alias("parent"), F.lit("x").alias("base")
    )
    out = naming.claim_paths(rows)
    names = {r["seq"]: r["name"] for r in out.collect()}
    assert names[0] == "x" and names[1] == "x-identica" and names[2] == "x-identical2" and len(set(names.values())) == 500


def test_name_seen_by_rows_that_claim_nothing(spark):
    claims = spark.createDataFrame([(2, "p/x.md", False), (4, "p/x-dddddddd.md", False)], "seq BIGINT, path STRING, clash BOOLEAN")
    rows = [(1, "dddddddd1", "p", "x", "o"), (3, "dddddddd1", "p", "x", "o"), (5, "dddddddd1", "p", "x", "o"), (6, "dddddddd1", "p", "x", "p/x.md"), (7, "e", "p", "y", "o")]
    frame = spark.createDataFrame(rows, "seq BIGINT, doc_id STRING, parent STRING, base STRING, index_path STRING")
    taken = spark.createDataFrame([("p/y.md",)], "path STRING")
    got = {r["seq"]: r["name"] for r in naming.name_seen_by(frame, claims, taken).collect()}
    assert got == {1: "x", 3: "x-dddddddd", 5: "x-dddddddd1", 6: "x", 7: "y-e"}


def test_quota_cut(spark):
    rows = spark.createDataFrame([(i, i in (5, 7)) for i in range(10)], "seq BIGINT, hit BOOLEAN")
    assert [r["seq"] for r in decide.before_quota(rows, "seq", F.col("hit")).orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    assert decide.before_quota(rows, "seq", F.lit(False)).count() == 10


def test_order_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = scans.with_order_number(rows, ["k"])
    assert out.where("seq <> k").count() == 0 and out.count() == 1000


def test_tree_with_loops_and_orphans(spark):
    rows = [
        ("k", "folder_a", "", "A/x", 99, 2), ("k", "folder_b", "folder_a", "..B..", 99, 1), ("k", "folder_a", "folder_b", "again", 99, 9),
        ("k", "d1", "", "root doc", 6, 1), ("k", "d2", "folder_a", "in a", 6, 5), ("k", "d3", "folder_b", "in b", 6, 1),
        ("k", "d4", "gone", "orphan", 6, 1), ("k", "folder_c", "", "", 11, 3), ("k", "d5", "folder_c", "in c", 6, 1),
        ("other", "d6", "", "not selected", 6, 1),
    ]
    items = spark.createDataFrame(rows, "kb_id STRING, media_id STRING, parent_folder_id STRING, title STRING, media_type INT, pos BIGINT")
    bases = spark.createDataFrame([("k", "Base/one", 0)], "kb_id STRING, kb_name STRING, kb_pos INT")
    folders, refused = tree.expand_folders(items, bases, "root")
    paths = {r["folder_id"]: r["path"] for r in folders.collect()}
    assert paths == {"": "root/Base/one", "folder_a": "root/Base/one/A_x", "folder_b": "root/Base/one/A_x/B", "folder_c": "root/Base/one/untitled"}
    assert [r["folder_id"] for r in refused.collect()] == ["folder_a"]
    placed = tree.place_items(items, folders)
    order = [(r["seq"], r["media_id"]) for r in tree.in_tree_order(placed, folders).orderBy("seq").collect()]
    assert order == list(enumerate(["d1", "d3", "d2", "d5"]))


def test_trees_as_deep_as_they_are(spark):
    """140 levels, and items whose parent is missing belong to the first level."""
    rows = [("k", f"folder_{i}", f"folder_{i - 1}" if i else None, f"f{i}", 99, 0) for i in range(140)]
    rows += [("k", "deep", "folder_139", "d", 6, 1), ("k", "loose", None, "l", 6, 2), ("k", "top", "", "t", 6, 3)]
    items = spark.createDataFrame(rows, "kb_id STRING, media_id STRING, parent_folder_id STRING, title STRING, media_type INT, pos BIGINT")
    bases = spark.createDataFrame([("k", "K", 0)], "kb_id STRING, kb_name STRING, kb_pos INT")
    folders, refused = tree.expand_folders(items, bases, "root")
    placed = {r["media_id"]: (r["parent_path"], r["depth"]) for r in tree.place_items(items, folders).collect()}
    deep = "root/K/" + "/".join(f"f{i}" for i in range(140))
    assert placed == {"deep": (deep, 141), "loose": ("root/K", 1), "top": ("root/K", 1)}
    assert refused.count() == 0


def walk(rows, bases):
    """Documents in the order of a walk, folder by folder; a folder inside itself is refused."""
    out, refused = [], []

    def level(kb, folder, path, above):
        for _, media_id, _, title, kind, _ in sorted((r for r in rows if r[0] == kb and (r[2] or "") == folder), key=lambda r: (r[5], r[1])):
            if kind != 99:
                out.append((media_id, path, len(above) + 1))
            elif media_id in above:
                refused.append((media_id, f"{path}/{title}"))
            else:
                level(kb, media_id, f"{path}/{title}", [*above, media_id])

    for kb, name, _ in sorted(bases, key=lambda b: (b[2], b[0])):
        level(kb, "", f"r/{name}", [])
    return out, refused


def test_random_trees_against_a_walk(spark):
    """Trees with folders listed twice, in themselves, under no base, empty and side by side with documents."""
    draw = random.Random(4)
    for _ in range(3):
        rows = []
        for kb in ("k1", "k2", "k3"):
            folders = [f"folder_{i}" for i in range(25)]
            for i, f in enumerate(folders):
                for _ in range(1 + (draw.random() < 0.15)):
                    parent = draw.choice(["", None, *folders[:i], *(folders if draw.random() < 0.1 else [])])
                    rows.append((kb, f, parent, f"t{draw.randrange(4)}", 99, draw.randrange(6)))
            rows += [(kb, f"d{i}", draw.choice(["", *folders]), "x", 6, draw.randrange(6)) for i in range(60)]
        rows = list({(r[0], r[1], r[2] or ""): r for r in rows}.values())
        draw.shuffle(rows)
        bases = [("k2", "B", 0), ("k1", "A", 1)]
        items = spark.createDataFrame(rows, "kb_id STRING, media_id STRING, parent_folder_id STRING, title STRING, media_type INT, pos BIGINT")
        folders, refused = tree.expand_folders(items, spark.createDataFrame(bases, "kb_id STRING, kb_name STRING, kb_pos INT"), "r")
        got = tree.in_tree_order(tree.place_items(items, folders), folders).orderBy("seq").collect()
        want, left_out = walk(rows, bases)
        assert [r["seq"] for r in got] == list(range(len(want)))
        assert [(r["media_id"], r["parent_path"], r["depth"]) for r in got] == want
        assert sorted((r["folder_id"], r["path"]) for r in refused.collect()) == sorted(left_out)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """3,000 folders in a row are resolved in about 12 rounds."""
    rows = spark.range(3000).select(
        F.lit("k").alias("kb_id"), F.concat(F.lit("folder_"), "id").alias("media_id"),
        F.when(F.col("id") > 0, F.concat(F.lit("folder_"), (F.col("id") - 1).cast("string"))).alias("parent_folder_id"),
        F.lit("f").alias("title"), F.lit(99).alias("media_type"), F.lit(0).cast("bigint").alias("pos"),
    )
    written = []
    plain = tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: written.append(1) or plain(df))
    bases = spark.createDataFrame([("k", "K", 0)], "kb_id STRING, kb_name STRING, kb_pos INT")
    folders, refused = tree.expand_folders(rows, bases, "root")
    assert folders.count() == 3001 and refused.count() == 0 and len(written) <= 2 + 12
    assert folders.where("size(steps) = 3000").first()["path"] == "root/K/" + "/".join(["f"] * 3000)


def test_totals_before(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = scans.with_total_before(rows, ["k"], {"t": F.col("k") + 1, "n": F.lit(1)})
    assert out.where("t <> k * (k + 1) / 2 OR n <> k").count() == 0 and out.count() == 1000 and out.columns == ["k", "t", "n"]


def test_folder_plan(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/d",), ("f/x/y",)], "p STRING")
    existing = spark.createDataFrame([("a",), ("a",)], "path STRING")
    files = spark.createDataFrame([("f/x",)], "path STRING")
    got = {r["folder"]: r["state"] for r in tree.folder_plan(paths, "p", existing, files).collect()}
    assert got == {"a": "exists", "a/b": "create", "a/b/c": "create", "a/d": "create", "f": "create", "f/x": "blocked", "f/x/y": "create"}


def test_request_resolution(spark):
    rows = [
        (1, 1, "retryable"), (1, 2, "success"), (1, 3, "fatal"), (2, 1, "fatal"), (3, 1, "retryable"), (3, 2, "retryable"),
        (3, 3, "retryable"), (3, 4, "retryable"), (3, 5, "success"), (4, 1, "retryable"), (4, 2, "quota"),
    ]
    log = spark.createDataFrame(rows, "request_id BIGINT, attempt INT, outcome STRING")
    got = {r[0]: tuple(r[1:]) for r in requests.resolve(log).collect()}
    assert got == {1: ("success", 2, 1000), 2: ("fatal", 1, 0), 3: ("failed", 4, 7000), 4: ("quota", 2, 1000)}


def test_pacing(spark):
    rows = [(1, 0), (1, 499), (1, 500), (1, 1100), (1, 1599), (1, 1599), (2, 0), (2, 500), (3, 999), (3, 1000)]
    log = spark.createDataFrame(rows, "c INT, ms BIGINT").select("c", F.timestamp_millis("ms").alias("ts"))
    got = {r["client"]: (r["requests"], r["too_close"]) for r in requests.pacing(log, "c", "ts").collect()}
    assert got == {1: (6, 4), 2: (2, 0), 3: (2, 1)}


def test_listings_stop_where_they_must(spark):
    def page(items, end, cursor):
        data = {"knowledge_list": [{"media_id": i} for i in items], "is_end": end, "next_cursor": cursor}
        return __import__("json").dumps({"code": 0, "msg": "ok", "data": data})

    rows = [
        ("end", 0, page("ab", False, "1")), ("end", 1, page("c", True, "2")), ("end", 2, page("z", False, "3")),
        ("empty", 0, page("a", False, "1")), ("empty", 1, page("", False, "2")), ("empty", 2, page("z", False, "")),
        ("cursor", 0, page("a", False, "")), ("cursor", 1, page("z", False, "2")),
        ("open", 0, page("a", False, "1")), ("open", 1, page("b", False, "2")), ("broken", 0, "{"),
    ]
    landed = spark.createDataFrame(rows, "listing STRING, page_no INT, payload STRING")
    got = listings.assemble_levels(landed, ["listing"]).orderBy("listing", "page_no", "pos").collect()
    assert [(r["listing"], r["media_id"]) for r in got] == [("cursor", "a"), ("empty", "a"), ("end", "a"), ("end", "b"), ("end", "c"), ("open", "a"), ("open", "b")]


@pytest.mark.parametrize("group_rows", [2, 1_000_000])
def test_notes_offsets_count_dropped_entries(spark, group_rows):
    def page(ids, end):
        entries = [None if i is None else {"basic_info": {"basic_info": {"docid": i, "title": "t"}}} for i in ids]
        return __import__("json").dumps({"code": 0, "data": {"note_book_list": entries, "is_end": end}})

    rows = [("n", 0, page(["a", "", "b"], False)), ("n", 1, page([None, "c"], False)), ("n", 2, page(["d"], True)), ("n", 3, page(["z"], False))]
    landed = spark.createDataFrame(rows, "listing STRING, page_no INT, payload STRING")
    got = listings.assemble_notes(landed, ["listing"], group_rows).orderBy("page_no", "pos").collect()
    assert [(r["docid"], r["page_offset"]) for r in got] == [("a", 0), ("b", 0), ("c", 3), ("d", 5)]


def test_media_answers(spark):
    payload = '{"code":0,"data":{"media_type":6,"url_info":{"url":"u","headers":{"h":"1"}},"notebook_ext_info":null,"update_time":"5"}}'
    rows = [("a", payload), ("b", '{"code":0,"data":{"media_type":11,"url_info":null,"notebook_ext_info":{"notebook_id":"n"}}}'), ("c", "{"), ("d", None)]
    landed = spark.createDataFrame(rows, "media_id STRING, payload STRING")
    got = {r["media_id"]: (r["media_type"], r["notebook_id"], r["url"], r["update_time"]) for r in landing.media_info(landed).collect()}
    assert got == {"a": (6, None, "u", "5"), "b": (11, "n", None, None)}


def test_binary_landing_folder(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\x01")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = landing.binary_files(spark, str(tmp_path), "*.bin").collect()
    assert [(r["length"], bytes(r["body"])) for r in got] == [(2, b"\x00\x01")]


# ---- state ------------------------------------------------------------------------------


def entry(doc, path="p", t="1"):
    return (doc, path, "k", "t", 0, t, "s")


def test_upsert_remove_lookup_clear(spark):
    index = spark.createDataFrame([entry("a"), entry("b"), entry("c")], index_store.INDEX)
    numbered = [entry("b", "new", "2"), entry("b", "newer", "3"), entry("d")]
    changes = spark.createDataFrame(numbered, index_store.INDEX).withColumn("seq", F.length("path"))
    merged = state.upsert(index, state.last_per_document(changes))
    assert {r["doc_id"]: r["path"] for r in merged.collect()} == {"a": "p", "b": "newer", "c": "p", "d": "p"}
    keys = spark.createDataFrame([("a",), ("x",), ("a",)], "doc_id STRING")
    assert sorted(r["doc_id"] for r in state.remove(index, keys).collect()) == ["b", "c"]
    assert [r["doc_id"] for r in state.lookup(index, keys).collect()] == ["a"]
    assert state.cleared(index).count() == 0 and state.cleared(index).schema == index.schema


def test_index_json(spark):
    index = spark.createDataFrame([entry("a", 'q"uote', ""), entry("b")], index_store.INDEX)
    lines = index_store.json_lines(index)
    rows, corrupt = index_store.parse_json(lines)
    assert sorted(rows.collect()) == sorted(index.collect()) and corrupt.first()[0] == 0
    whole = '{"a":{"path":"p","kb_id":"k","title":"t","media_type":0,"update_time":"1","synced_at":"s"},"b":{"path":"q"}}'
    rows, corrupt = index_store.parse_json(spark.createDataFrame([(whole,), ("{broken",), ("  ",), ("{}",), ("",)], "value STRING"))
    assert sorted(r["path"] for r in rows.collect()) == ["p", "q"] and corrupt.first()[0] == 1


def test_index_store(spark, tmp_path):
    store = index_store.IndexStore(spark, str(tmp_path / "index"))
    frame = lambda *rows: spark.createDataFrame(list(rows), index_store.INDEX)
    assert store.size() == 0 and store.last_run() == -1
    assert store.append(frame(entry("a"), entry("b")), 0)
    assert not store.append(frame(entry("a", "again")), 0)
    assert not store.append(frame(), 1)
    assert store.append(frame(entry("a", "new")), 2)
    assert {r["doc_id"]: r["path"] for r in store.load().collect()} == {"a": "new", "b": "p"}
    store.compact(more_than=5)
    assert len(store.state().changes) == 2 and store.state().base is None
    store.compact()
    assert store.state().changes == () and {r["doc_id"]: r["path"] for r in store.load().collect()} == {"a": "new", "b": "p"}
    store._write("changes", frame(entry("c")))  # a writer that breaks before its commit
    assert store.last_run() == 2 and store.size() == 2
    assert store.append(frame(entry("c")), 3) and store.size() == 3
    store.clear(4)
    assert store.size() == 0 and store.last_run() == 4
    assert store.append(frame(entry("z")), 5) and store.size() == 1


def test_two_writers_of_one_index(spark, tmp_path, monkeypatch):
    """Each prepares its commit on the same state; the one that comes second makes it anew."""
    root = str(tmp_path / "index")
    one, two = index_store.IndexStore(spark, root), index_store.IndexStore(spark, root)
    frame = lambda *rows: spark.createDataFrame(list(rows), index_store.INDEX)
    assert one.append(frame(entry("a")), 0)
    plain = index_store.storage.put_if_absent

    def meanwhile(what):
        """The next commit finds that ``what`` was committed before it."""
        waiting = [what]

        def put(*call):
            if waiting:
                assert waiting.pop()()
            return plain(*call)

        monkeypatch.setattr(index_store.storage, "put_if_absent", put)

    meanwhile(lambda: two.append_batch(frame(entry("b")), "other-0", 7))
    assert one.append(frame(entry("c")), 1)
    assert {r["doc_id"] for r in one.load().collect()} == {"a", "b", "c"} and one.state().number == 2
    # a run that another writer commits meanwhile is left alone
    meanwhile(lambda: two.append(frame(entry("x", "two")), 2))
    assert not one.append(frame(entry("x", "one")), 2)
    assert {r["path"] for r in one.load().where("doc_id = 'x'").collect()} == {"two"}
    # a fold keeps what is committed meanwhile
    meanwhile(lambda: two.append(frame(entry("y")), 3))
    one.compact()
    assert len(one.state().changes) == 1 and {r["doc_id"] for r in one.load().collect()} == {"a", "b", "c", "x", "y"}


def test_progress_and_expiry(spark, tmp_path):
    store = index_store.IndexStore(spark, str(tmp_path / "index"))
    frame = lambda *rows: spark.createDataFrame(list(rows), index_store.INDEX)
    for number in range(6):
        assert store.append_batch(frame(entry(f"d{number}")), f"s-{number}", 10)
    assert not store.append_batch(frame(entry("d9")), "s-5", 10) and store.append_batch(frame(entry("d9")), "s-5", 20)
    assert (store.progress("s-5"), store.progress("s-4"), store.progress("s-6"), store.progress("t-0")) == (20, decide.NO_CUT, None, None)
    assert store.append(frame(entry("r")), 0, "r0-x")
    store.compact()
    held = {r["doc_id"] for r in store.load().collect()}
    store.expire(keep=2)
    names = {p.name for p in (tmp_path / "index").iterdir()}
    assert {r["doc_id"] for r in store.load().collect()} == held and len(list((tmp_path / "index" / "commits").glob("0*"))) == 2
    store.append_batch(frame(entry("e")), "s-6", 1)
    store.append_batch(frame(entry("f")), "s-7", 1)
    store.expire(keep=1)
    left = {p.name for p in (tmp_path / "index").iterdir()}
    assert len(left) < len(names) + 2 and store.size() == len(held) + 2
    assert [tuple(r) for r in store.run_folders().collect()] == [("r0-x", 7)]  # named by its commit for good


def test_selection(spark):
    catalog = spark.createDataFrame([("a", "A", 0), ("b", "B", 1), ("c", "C", 2)], "kb_id STRING, kb_name STRING, kb_pos INT")
    chosen = catalog.where("kb_id = 'a'")
    marks = {r["kb_id"]: r["already_added"] for r in state.annotate_catalog(catalog, chosen).collect()}
    assert marks == {"a": True, "b": False, "c": False}
    added = state.add_selection(chosen, catalog, ["a", "b"])
    assert sorted(r["kb_id"] for r in added.collect()) == ["a", "b"]
    assert [r["kb_id"] for r in state.remove_selection(added, 0).collect()] == ["b"]


# ---- images -----------------------------------------------------------------------------


def test_data_uris(evaluate):
    rows = ["data:image/png;base64,aGk=", "data:image/png;base64,aGk", "data:image/png;base64, a G\tk = ", "data:image/png;base64,!!!!", "data:image/png;base64,aGkab", "data:;base64,aGk=", "data:image/svg+xml;base64,", "data:image/png,aGk=", "http://x", "data:image/png;base64,a=b=", "data:image/png;base64,aGk=="]
    got = evaluate(images.data_uri_bytes(F.col("u")), "u STRING", rows)
    assert [None if g is None else bytes(g) for g in got] == [b"hi", b"hi", b"hi", None, None, None, b"", None, None, None, None]
    assert evaluate(images.data_uri_ext(F.col("u")), "u STRING", ["data:image/svg+xml;base64,x", "data:text/x;base64,x"]) == ["svg", "png"]


def test_image_urls(evaluate):
    text = 'a ![x](u1 "t") ![](u2) <IMG class="k" src="u3"> ![y](u1) <img data-src="u4" alt="z"> <imgx src="n"> ![z](two words) <img src=\'q\'> ![w](u5)'
    assert evaluate(images.image_urls("s"), "s STRING", [text, "none"]) == [["u1", "u2", "u5", "u3", "u4"], []]


LONG = base64.b64encode(b"hello" * 100).decode()


def test_localize(spark, tmp_path):
    docs = [
        ("a_1", '![x](h/1.jpg) ![](h/1.jpg) ![n](h/2.png) <img src="h/3.gif"> ![d](data:image/png;base64,aGk=) ![$1](h/4.jpg)', "att"),
        ("l_9", f"![long](data:image/png;base64,{LONG})", "att"),
        ("a_2", "no image here", "att"),
        ("b_1", "![k](h/1.jpg)", "att"),
        ("c_3", "![bad](data:image/png;base64,!!)", "att"),
    ]
    blobs = [("h/1.jpg", "image/webp; q=1", 200), ("h/2.png", "", 404), ("h/3.gif", "", 200), ("h/4.jpg", None, None)]
    frame = spark.createDataFrame(docs, "doc_id STRING, content STRING, image_dir STRING")
    pictures = spark.createDataFrame(blobs, "url STRING, content_type STRING, status INT")
    out, files = images.localize(frame, pictures)
    got = {r["doc_id"]: (r["content"], r["downloaded"], r["failed"]) for r in out.collect()}
    assert got == {
        "a_1": ("![[1-1.webp|x]] ![[1-1.webp]] ![n](h/2.png) ![[1-4.gif]] ![[1-2.png|d]] ![[1-3.jpg|$1]]", 4, 1),
        "a_2": ("no image here", 0, 0),
        "b_1": ("![[1-1.webp|k]]", 1, 0),
        "c_3": ("![bad](data:image/png;base64,!!)", 0, 1),
        "l_9": ("![[9-1.png|long]]", 1, 0),
    }
    stored = {(r["doc_id"], r["image_no"]): r["path"] for r in files.collect()}
    assert stored == {("a_1", 1): "att/1-1.webp", ("a_1", 2): "att/1-2.png", ("a_1", 3): "att/1-3.jpg", ("a_1", 4): "att/1-4.gif", ("b_1", 1): "att/1-1.webp", ("l_9", 1): "att/9-1.png"}
    have = spark.createDataFrame([("att/1-4.gif",)], "path STRING")
    new = {r["path"]: (r["doc_id"], r["collided"]) for r in images.new_attachments(files, have, []).collect()}
    assert new == {"att/1-1.webp": ("a_1", 1), "att/1-2.png": ("a_1", 0), "att/1-3.jpg": ("a_1", 0), "att/9-1.png": ("l_9", 0)}
    bodies = spark.createDataFrame([("h/1.jpg", bytearray(b"one")), ("h/4.jpg", bytearray(b"four"))], "url STRING, body BINARY")
    chosen = images.new_attachments(files, have, [])
    data = {r["path"]: bytes(r["body"]) for r in images.attachment_bytes(chosen, bodies).collect()}
    assert data == {"att/1-1.webp": b"one", "att/1-2.png": b"hi", "att/1-3.jpg": b"four", "att/9-1.png": b"hello" * 100}


def test_references_keep_their_address(spark):
    """Also where it is a long data URI; the key alone is a digest."""
    uri = "data:image/png;base64," + "aGk=" * 400
    docs = spark.createDataFrame([("a_1", f"![x]({uri}) ![y](h/1.jpg)", "att")], "doc_id STRING, content STRING, image_dir STRING")
    blobs = spark.createDataFrame([("h/1.jpg", "image/jpeg")], "url STRING, content_type STRING")
    resolved = images.resolve_refs(images.image_refs(docs), blobs)
    assert {r["url"] for r in resolved.collect()} == {uri, "h/1.jpg"}
    _, files = images.localize(docs, blobs)
    assert {r["url"] for r in images.new_attachments(files, files.select("path").limit(0), []).collect()} <= {uri, "h/1.jpg"}


def test_absolute_image_urls(spark):
    rows = [
        ("![a](/x/y z.png) ![a](/x/ä.png) ![b](http://o/p) ![c](../q.gif?v=1) ![d](data:x)", "https://H.com/a/b/c"),
        ('<img alt="r.png" src="r.png"> <img class="k" src="//cdn/s.png"> <img src="https://o/p">', "https://h.com/a/"),
        ("![a](x.png)", "not a url"),
        (None, "https://h.com"),
        ("plain", "https://h.com"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, body STRING, url STRING")
    got = [r["body"] for r in images.absolute_image_urls(frame, "body", "url").orderBy("i").collect()]
    assert got == [
        "![a](/x/y z.png) ![a](https://h.com/x/%C3%A4.png) ![b](http://o/p) ![c](https://h.com/a/q.gif?v=1) ![d](data:x)",
        '<img alt="https://h.com/a/r.png" src="r.png"> <img class="k" src="https://cdn/s.png"> <img src="https://o/p">',
        "![a](x.png)",
        None,
        "plain",
    ]


def test_rank_chain_against_walking(spark):
    """Chains of many lengths, broken ones, loops and rows that no walk meets."""
    from inkmirror.operators.chains import rank_chain

    draw, rows, want = random.Random(5), [], {}
    for key in range(30):
        many = draw.choice([1, 2, 3, 17, 64, 65, 300])
        names = [f"n{i}" for i in draw.sample(range(1000), many)]
        ahead = dict(zip(names, [*names[1:], None]))
        kind = key % 4
        if kind == 1:
            ahead[names[-1]] = draw.choice(names)  # a loop
        if kind == 2:
            ahead[names[many // 2]] = "lost"
        rows += [(key, at, to, at == names[0] and kind != 3 or key == 3 and at == names[0]) for at, to in ahead.items()]
        at, rank = names[0], 0
        while (kind != 3 or key == 3) and at in ahead and (key, at) not in want:
            want[(key, at)] = rank
            at, rank = ahead[at], rank + 1
    draw.shuffle(rows)
    nodes = spark.createDataFrame(rows, "k int, at string, to string, head boolean")
    got = {(r["k"], r["at"]): r["rank"] for r in rank_chain(nodes, ["k"], "at", "to", F.col("head")).collect()}
    assert got == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from inkmirror.operators import chains

    rounds = []
    plain = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rounds.append(1) or plain(df))
    nodes = spark.range(3000).select(F.lit(0).alias("k"), "id", F.when(F.col("id") < 2999, F.col("id") + 1).alias("to"))
    ranked = chains.rank_chain(nodes, ["k"], "id", "to", F.col("id") == 0)
    assert ranked.where("rank <> id").count() == 0 and ranked.count() == 3000
    assert len(rounds) <= 3 + 2 * 13


def test_follow_cursors_edges(spark):
    """No first page, an empty page, a null cursor, the newest of repeated answers, one listing without rows."""
    def page(ids, cursor=None, is_end=False):
        rows = [{"kb_id": i} for i in ids]
        return json.dumps({"code": 0, "data": {"info_list": rows, "is_end": is_end, "next_cursor": cursor}})

    rows = [
        ("a", None, page(["old"], "x"), 1), ("a", "", page(["a1", "a2"], "x"), 2), ("a", "x", page([], "y"), 1), ("a", "y", page(["never"]), 1),
        ("b", "z", page(["b1"]), 1),
        ("c", "", page(["c1"], "c"), 1), ("c", "c", page(["c2"], ""), 1),
        ("d", "", page(["d1"], "gone"), 1),
        ("e", "", page(["e1"], "e"), 1), ("e", "e", page(["e2"], "e"), 1),
        ("f", "", "no json", 1),
    ]
    landed = spark.createDataFrame(rows, "listing string, cursor string, payload string, no int")
    pages, ends = listings.follow_cursors(landed, ["listing"], listings.CATALOG_PAGE, "info_list", newest="no")
    found = listings.assemble_catalog(pages, ["listing"]).collect()
    assert sorted((r["listing"], r["page_no"], r["kb_id"]) for r in found) == [
        ("a", 0, "a1"), ("a", 0, "a2"), ("c", 0, "c1"), ("c", 1, "c2"), ("d", 0, "d1"), ("e", 0, "e1"), ("e", 1, "e2"),
    ]
    assert {r["listing"]: (r["pages"], r["ending"]) for r in ends.collect()} == {
        "a": (2, "complete"), "c": (2, "complete"), "d": (1, "broken"), "e": (2, "loop"),
    }
    none, ended = listings.follow_cursors(landed.limit(0), ["listing"], listings.CATALOG_PAGE, "info_list")
    assert none.count() == 0 and ended.count() == 0


def test_note_offsets_edges(spark):
    """Gaps and overlaps among empty, repeated and nested pages, also when a listing is cut into ranges."""
    def page(many, is_end=False):
        entry = {"basic_info": {"basic_info": {"docid": "x"}}}
        return json.dumps({"code": 0, "data": {"note_book_list": [entry] * many, "is_end": is_end}})

    rows = [("a", 0, page(20)), ("a", 0, page(20)), ("a", 20, page(20)), ("a", 45, page(10)), ("a", 50, page(2)), ("a", 55, page(5, True)), ("a", 90, page(9))]
    rows += [("b", 5, page(1)), ("b", 6, page(0)), ("c", 0, page(0))]
    landed = spark.createDataFrame(rows, "listing string, page_offset bigint, payload string")
    for group_rows in (1_000_000, 2):
        found = listings.note_offset_gaps(landed, ["listing"], group_rows=group_rows).collect()
        assert sorted((r["listing"], r["page_offset"], r["kind"], r["from_entry"], r["until_entry"]) for r in found) == [
            ("a", 45, "gap", 40, 45), ("a", 50, "overlap", 50, 52), ("b", 5, "gap", 0, 5),
        ]


def test_data_uris_step_by_step(spark):
    """Blanks, padding and line ends of data URIs, each with the bytes of a plain decoder."""
    cases = {
        "data:image/png;base64,aGk=": b"hi", "data:image/png;base64,aGk": b"hi", "data:a/b;base64, aG\tk =\f": b"hi",
        "data:a/b;base64,": b"", "data:a/b;base64,aG\nk=": None, "data:a/b;base64,aGk=\r": None, "data:a/b;base64,aGk ": None,
        "data:a/b;base64,aGk==": None, "data:a/b;base64,a===": None, "data:a/b;base64,aGkhaGkh": b"hi!hi!",
        "data:a b;base64,aGk=": None, "data:;base64,aGk=": None, " data:a/b;base64,aGk=": None, "data:a/b;base64,a,Gk": None,
        "data:a/b;base64,aGkhaQ==": b"hi!i", "data:a/b;base64,é": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "uri STRING").withColumn("b", images.data_uri_bytes(F.col("uri")))
    assert {r["uri"]: None if r["b"] is None else bytes(r["b"]) for r in rows.collect()} == cases
    # the address is read in few steps, however long it is
    column = spark.range(1).select(images.data_uri_bytes(F.col("id").cast("string")).alias("b"))
    assert column._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2
