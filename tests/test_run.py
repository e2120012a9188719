"""Whole runs against the sequential model, and what later runs do."""

import random

import pytest
from pyspark.sql import functions as F

import model
from inkmirror.functions.names import safe_file_name
from inkmirror.plans.run import SyncInputs, SyncParams, commit_run, run_rows, run_sync, vault
from inkmirror.sources import index_store
from inkmirror.sources.index_store import IndexStore

PARAMS = SyncParams("root", "2024-06-01", "2024-06-01T00:00:00Z")
ITEM = "kb_id STRING, media_id STRING, parent_folder_id STRING, title STRING, media_type INT, pos BIGINT"
MEDIA = "media_id STRING, media_type INT, notebook_id STRING, url STRING, update_time STRING, outcome STRING"
FETCHED = "url STRING, status INT, content_type STRING, text STRING"


class World:
    """Random small inputs, as plain rows and as tables."""

    def __init__(self, spark, seed, quota=False):
        rng = random.Random(seed)
        titles = ["same", "same", "same-abcdefgh", "other/x", "", "..dots..", "same-doc3"]
        docs = [f"abcdefgh{i}" if rng.random() < 0.4 else f"doc{i}" for i in range(40)]
        folders = [("k0", "folder_1", "", "F", 99, 3), ("k0", "folder_2", "folder_1", "G", 99, 1), ("k1", "folder_3", "", "H", 99, 2)]
        places = [("k0", ""), ("k0", "folder_1"), ("k0", "folder_2"), ("k1", ""), ("k1", "folder_3")]
        self.items, used = list(folders), 100
        for doc in docs + rng.sample(docs, 12):  # some documents are listed twice
            kb, parent = rng.choice(places)
            used += 1
            self.items.append((kb, doc, parent, rng.choice(titles), 6, used))
        self.media, self.contents, self.fetched = {}, {}, {}
        for i, doc in enumerate(docs):
            if rng.random() < 0.1:
                continue
            time = rng.choice([None, "", "100", "1700000000", "1700000000000"])
            kind = rng.choice(["note", "own", "url", "url", "none"])
            note, url = (f"n{i}" if kind == "note" else None), (f"http://h/{i}.{rng.choice(['pdf', 'md'])}" if kind == "url" else None)
            outcome = "quota" if quota and i == 17 else "success"
            self.media[doc] = (11 if kind in ("note", "own") else 6, note, url, time, outcome)
            if kind in ("note", "own") and rng.random() < 0.9:
                text = "x &#x110000;" if rng.random() < 0.15 else f"body of {doc} ![i](http://img/{i}.png)"
                self.contents[note or doc] = (text, "quota" if quota and i == 30 else "success")
            if kind == "url" and rng.random() < 0.9:
                page = rng.choice([("Text/HTML", "<div>short</div>"), ("text/html", ""), ("application/pdf", "b"), ("text/markdown", "m"), ("", "b")])
                ext = {"application/pdf": "pdf", "text/markdown": "md", "text/html": "html"}.get(page[0].lower(), url.rsplit(".", 1)[1])
                self.fetched[url] = (rng.choice([200, 200, 200, 404, 503]), page[0].lower(), page[1], ext)
        self.index, self.documents = {}, []
        for doc in rng.sample(docs, 15):
            path = f"root/Base 0/old {doc}.md"
            self.index[doc] = (path, rng.choice(["", "50", "1700000000"]))
            if rng.random() < 0.6:
                self.documents.append(path)
        self.documents += ["root/Base 0/same.md", "root/Base 1/H/untitled.md"]
        self.notes = [(f"note{i}", rng.choice(["same", "note"]), rng.choice(["0", "1700000000000"]), i) for i in range(6)]
        for doc, *_ in self.notes:
            self.contents[doc] = (f"text of {doc}", "success")
        self.bases = [("k0", "Base 0", 0), ("k1", "Base 1", 1)]
        self.spark = spark

    def feed(self):
        by_parent = {}
        for row in self.items:
            by_parent.setdefault((row[0], row[2]), []).append(row)

        def walk(kb, folder, path):
            for row in sorted(by_parent.get((kb, folder), []), key=lambda r: (r[5], r[1])):
                if row[1].startswith("folder_"):
                    yield from walk(kb, row[1], f"{path}/{row[3]}")
                else:
                    yield row[1], row[3], path, False, None

        for kb, name, _ in self.bases:
            yield from walk(kb, "", f"root/{name}")
        for doc, title, time, _ in self.notes:
            yield doc, title, "root/Notes", True, time

    def safe(self):
        titles = sorted({r[1] for r in self.feed()})
        frame = self.spark.createDataFrame([(t,) for t in titles], "t STRING")
        return {r[0]: r[1] for r in frame.select("t", safe_file_name("t")).collect()}

    def inputs(self, index=None, documents=None):
        table = self.spark.createDataFrame
        entries = [(d, p, "k", "t", 0, t, "s") for d, (p, t) in self.index.items()]
        existing = [(p, "---\nmine: 1\n---\n\nold") for p in self.documents]
        return SyncInputs(
            bases=table(self.bases, "kb_id STRING, kb_name STRING, kb_pos INT"),
            items=table(self.items, ITEM),
            media=table([(d, *v) for d, v in self.media.items()], MEDIA),
            contents=table([(k, *v) for k, v in self.contents.items()], "doc_id STRING, content STRING, outcome STRING"),
            fetched=table([(u, *v[:3]) for u, v in self.fetched.items()], FETCHED),
            image_blobs=table([(f"http://img/{i}.png", "image/png") for i in range(0, 40, 2)], "url STRING, content_type STRING"),
            index=table(entries, index_store.INDEX) if index is None else index,
            documents=table(existing, "path STRING, content STRING") if documents is None else documents,
            attachments=table([], "path STRING"),
            notes=table(self.notes, "docid STRING, title STRING, modify_time STRING, pos BIGINT"),
        )


@pytest.mark.parametrize("seed,quota", [(1, False), (3, True)])
def test_run_equals_the_loop(spark, seed, quota):
    world = World(spark, seed, quota)
    want, index = model.run(world.feed(), world.media, world.contents, world.fetched, world.index, world.documents, world.safe())
    result = run_sync(world.inputs(), PARAMS)
    got = [(r["doc_id"], r["result"], r["path"]) for r in result.results.orderBy("seq").collect()]
    assert got == want
    changed = {r["doc_id"]: (r["path"], r["update_time"]) for r in result.index_changes.collect()}
    assert {**world.index, **changed} == index
    counts = result.report.first()
    assert [counts[c] for c in ("created", "updated", "skipped", "failed")] == [sum(w[1] == r for w in want) for r in ("created", "updated", "skipped", "failed")]
    assert result.errors.count() == counts["failed"]
    assert result.results.where("result = 'failed' AND error IS NULL").count() == 0
    written = {r["path"]: r["content"] for r in result.documents.collect()}
    assert sorted(written) == sorted(p for _, r, p in want if p)
    for doc, outcome, path in want:
        if outcome == "created":
            assert written[path].startswith("---\ntitle: ") and "\n---\n\n" in written[path]
        elif path in world.documents:
            assert written[path].startswith("---\nmine: 1\n") and "old" not in written[path].split("---\n\n")[1].split("\n")[0]


def test_later_runs(spark, tmp_path):
    world = World(spark, 5)
    store = IndexStore(spark, str(tmp_path / "index"))
    table = spark.createDataFrame
    empty = table([], "path STRING, doc_id STRING, content STRING")
    first = run_sync(world.inputs(store.load(), empty), PARAMS)
    assert commit_run(first, store, str(tmp_path), 0)
    assert not commit_run(first, store, str(tmp_path), 0)
    documents = vault(store, str(tmp_path), "documents", empty)
    created = documents.count()
    assert store.size() == created and documents.select("path").distinct().count() == created
    images = {r["path"] for r in run_rows(store, str(tmp_path), "attachments").collect()}
    embeds = documents.where("content LIKE '%![[%'").count()
    assert embeds and len(images) >= embeds
    folders = {r["folder"] for r in run_rows(store, str(tmp_path), "folders").collect()}
    assert {"root", "root/Base 0", "root/Base 0/F/G", "root/Notes"} <= folders

    second = run_sync(world.inputs(store.load(), documents), PARAMS)
    report = second.report.first()
    assert report["created"] == report["updated"] == 0 and report["skipped"] >= created
    # it wrote no document, and its report counts
    assert commit_run(second, store, str(tmp_path), 1) and store.last_run() == 1
    assert run_rows(store, str(tmp_path), "report").count() == 2
    assert not commit_run(second, store, str(tmp_path), 1)

    store.clear(2)  # the documents stay, so every document is created once more beside its old file
    third = run_sync(world.inputs(store.load(), documents), PARAMS)
    paths = {r["path"] for r in third.documents.collect()}
    old = {r["path"] for r in documents.select("path").collect()}
    assert paths and not paths & old and third.report.first()["updated"] == 0


def test_a_run_needs_something_to_sync(spark):
    world = World(spark, 6)
    inputs = world.inputs()
    nothing = SyncInputs(**{**inputs.__dict__, "bases": inputs.bases.where(F.lit(False)), "notes": None})
    with pytest.raises(ValueError):
        run_sync(nothing, PARAMS)


@pytest.mark.parametrize("root", ["", "  ", "/"])
def test_a_run_needs_a_folder(spark, root):
    with pytest.raises(ValueError):
        run_sync(World(spark, 6).inputs(), SyncParams(root, "2024-06-01", "s"))


def walked(rows, bases, broken, files, root="root"):
    """Items that a walk visits and the failures it meets, folder by folder. ``broken``:
    (kb, folder) -> (outcome, message)."""
    seen, failures = [], []

    class Stop(Exception):
        pass

    def level(kb, folder, path):
        if path in files:
            raise Stop("failed", f"路径 {path} 已被文件占用，无法创建文件夹")
        if (kb, folder) in broken:
            raise Stop(*broken[(kb, folder)])
        for _, media_id, _, title, kind, _ in sorted((r for r in rows if r[0] == kb and r[2] == folder), key=lambda r: (r[5], r[1])):
            if kind == 99:
                level(kb, media_id, f"{path}/{title}")
            else:
                seen.append(media_id)

    for kb, name, _ in bases:
        try:
            level(kb, "", f"{root}/{name}")
        except Stop as stop:
            outcome, message = stop.args
            if outcome == "quota":
                return seen, failures, True
            failures.append((f"知识库「{name}」", message))
    return seen, failures, False


@pytest.mark.parametrize("seed", range(4))
def test_failed_listings_and_blocked_folders(spark, seed):
    """Against the walk: what comes after a failure in its base is not visited, quota ends the run."""
    rng = random.Random(seed)
    rows, bases = [], [(f"k{b}", f"Base{b}", b) for b in range(4)]
    for kb, _, _ in bases:
        folders = [f"folder_{i}" for i in range(8)]
        rows += [(kb, f, rng.choice(["", *folders[:i]]), f"t{i}", 99, rng.randrange(5)) for i, f in enumerate(folders)]
        rows += [(kb, f"{kb}_d{i}", rng.choice(["", *folders]), "x", 11, rng.randrange(5)) for i in range(20)]
    broken = {(rng.choice(bases)[0], rng.choice(["", *folders])): ("fatal", f"m{i}") for i in range(2)}
    if seed % 2:
        broken[(rng.choice(bases[1:])[0], rng.choice(folders))] = ("quota", "q")
    files = {"root/Base3/t0", "root/Base2"} if seed == 2 else set()
    seen, failures, stopped = walked(rows, bases, broken, files)
    table = spark.createDataFrame
    notes_broken = seed == 3
    listings = [(kb, f, o, m) for (kb, f), (o, m) in broken.items()] + [("k0", "folder_7", "success", None)]
    listings = [r for r in listings if not (r[2] == "success" and ("k0", "folder_7") in broken)]
    result = run_sync(
        SyncInputs(
            bases=table(bases, "kb_id STRING, kb_name STRING, kb_pos INT"),
            items=table(rows, ITEM),
            media=table([], MEDIA), contents=table([], "doc_id STRING, content STRING, outcome STRING"), fetched=table([], FETCHED),
            image_blobs=table([], "url STRING, content_type STRING"), index=table([], index_store.INDEX),
            documents=table([], "path STRING, content STRING"), attachments=table([], "path STRING"),
            notes=table([("n1", "note", "100", 0)], "docid STRING, title STRING, modify_time STRING, pos BIGINT"),
            listings=table(listings + ([("", "", "fatal", "no notes")] if notes_broken else []), "kb_id STRING, folder_id STRING, outcome STRING, message STRING"),
            files=table([(f,) for f in files], "path STRING"),
        ),
        PARAMS,
    )
    got = result.results.orderBy("seq").collect()
    want_notes = [] if stopped or notes_broken else ["n1"]
    assert [r["doc_id"] for r in got if r["doc_id"]] == seen + want_notes
    want_failures = failures + ([("独立笔记", "no notes")] if notes_broken and not stopped else [])
    assert sorted((r["title"], r["error"]) for r in got if not r["doc_id"]) == sorted(want_failures)
    assert result.report.first()["failed"] == len(got)


def test_global_attachment_folder(spark):
    world = World(spark, 7)
    result = run_sync(world.inputs(), SyncParams("root", "2024-06-01", "s", per_kb_attachments=False, global_folder=" /media/ "))
    paths = [r["path"] for r in result.attachments.collect()]
    assert paths and all(p.startswith("media/") for p in paths)


def one_item_run(spark, title, fetched, url="http://h/a.md", media_type=6):
    """A run over one link item."""
    empty = spark.createDataFrame
    return run_sync(
        SyncInputs(
            bases=empty([("k", "K", 0)], "kb_id STRING, kb_name STRING, kb_pos INT"),
            items=empty([("k", "d1", None, title, media_type, 0)], ITEM),
            media=empty([("d1", media_type, None, url, "100", "success")], MEDIA),
            contents=empty([], "doc_id STRING, content STRING, outcome STRING"),
            fetched=empty([(url, 200, *fetched)], FETCHED),
            image_blobs=empty([], "url STRING, content_type STRING"),
            index=empty([], index_store.INDEX),
            documents=empty([], "path STRING, content STRING"),
            attachments=empty([], "path STRING"),
        ),
        PARAMS,
    )


def test_an_original_typed_as_markdown_is_kept(spark):
    result = one_item_run(spark, "same", ("text/markdown", "# m"))
    assert [(r["result"], r["error"]) for r in result.results.collect()] == [("failed", "path exists")]
    assert [r["file_path"] for r in result.originals.collect()] == ["root/K/same.md"]
    assert [(r["path"], bytes(r["body"])) for r in result.original_files.collect()] == [("root/K/same.md", b"# m")]
    assert result.documents.count() == 0 and result.index_changes.count() == 0


@pytest.mark.parametrize("fetched", [("application/pdf", "b"), ("text/html", "<div>short</div>")])
def test_a_missing_title_gives_a_document(spark, fetched):
    result = one_item_run(spark, None, fetched)
    content = result.documents.first()["content"]
    assert result.documents.count() == 1 and "\n# \n" in content


def test_a_run_writes_all_of_its_tables(spark, tmp_path):
    result = one_item_run(spark, "t", ("application/pdf", "b"))
    store = IndexStore(spark, str(tmp_path / "index"))
    assert commit_run(result, store, str(tmp_path), 0)
    for name in ("results", "errors", "report", "refused_folders", "attachment_files", "original_files"):
        assert spark.read.parquet(str(tmp_path / name)).count() == getattr(result, name).count()
