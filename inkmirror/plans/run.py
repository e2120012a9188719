"""A whole sync run as one job: listings and state in, tables out.

``run_sync`` takes the landed tables and the state of the last run and returns
what the run would write: documents, attachments, folders, index changes, counts
and errors. ``commit_run`` writes them so that a broken run leaves no trace.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import merge_properties, new_document, property_block, run_summary, splice_body
from ..functions.names import (
    NOTES_DIR_NAME,
    attachment_dir,
    document_title,
    file_ext,
    safe_file_name,
)
from ..functions.rules import content_route, download_outcome, url_kind
from ..functions.times import to_seconds
from ..operators.bodies import convert_bodies, extract_articles, stored_originals
from ..operators.decide import NO_CUT, before_quota, error_lines, fold_actions, run_counts, run_result, with_index
from ..operators.images import attachment_bytes, localize, new_attachments
from ..operators.joins import lookup, settings_table
from ..operators.key_filter import only_wanted
from ..operators.naming import claim_paths, name_seen_by, with_files, write_targets
from ..operators.scans import GROUP_ROWS, repeated_keys, with_again, with_order_number
from ..operators.tree import expand_folders, folders_needed, place_items, walk
from ..session import cut
from ..sources.index_store import IndexStore

# Error texts.
NO_SOURCE = "无 notebook_id 也无 url_info，无法获取内容"
DOWNLOAD_FAILED = "下载失败 "
NOT_LANDED = "no answer landed"
PATH_EXISTS = "path exists"
PATH_TAKEN = "路径 %s 已被文件占用，无法创建文件夹"
# Titles of failures that are no item's.
BASE_FAILED = "知识库「%s」"
NOTES_FAILED = "独立笔记"
# What only the decision asks for.
DECIDED = [
    "standalone", "has_media", "media_quota", "content_quota", "has_content", "ready", "fetch_status", "fetch_outcome", "content_type",
    "known", "known_t", "prior_ok", "prior_t", "ok", "clashed",
]
# What a document's text is written with, beside its body.
DOCUMENT = ["seq", "doc_id", "kb_name", "title", "url", "path", "in_place"]


@dataclass(frozen=True)
class SyncParams:
    """Settings of a run."""

    root: str
    run_date: str
    synced_at: str
    per_kb_attachments: bool = True
    global_folder: str = ""
    group_rows: int = GROUP_ROWS


@dataclass(frozen=True)
class SyncInputs:
    """Landed tables and state.

    ``bases`` are the selected knowledge bases in order, ``notes`` is None when
    standalone notes are off. ``contents`` is unique per doc_id, ``fetched`` and
    ``image_blobs`` per url, ``documents`` per path, ``index`` per doc_id. ``body`` has the
    bytes of fetched files and of images; without it a file's text counts. Tables of
    answers may carry ``outcome`` to report a quota answer, ``fetched`` may carry
    ``has_text`` to spare the decision from reading the pages. ``listings`` (kb_id, folder_id,
    outcome, message; the notes under an empty kb_id) tells which folder listings failed, ``files``
    which other files stand in the vault.
    """

    bases: DataFrame
    items: DataFrame
    media: DataFrame
    contents: DataFrame
    fetched: DataFrame
    image_blobs: DataFrame
    index: DataFrame
    documents: DataFrame
    attachments: DataFrame
    notes: DataFrame | None = None
    listings: DataFrame | None = None
    files: DataFrame | None = None


@dataclass(frozen=True)
class SyncResult:
    """What the run writes; ``results`` has one row per processed item and one, without a
    document, per knowledge base whose listing failed."""

    results: DataFrame
    documents: DataFrame
    attachments: DataFrame
    attachment_files: DataFrame
    originals: DataFrame
    original_files: DataFrame
    folders: DataFrame
    index_changes: DataFrame
    report: DataFrame
    errors: DataFrame
    refused_folders: DataFrame


# Tables of a run that are written beside the index.
RUN_TABLES = (
    "documents", "attachments", "attachment_files", "originals", "original_files", "folders", "results", "errors",
    "report", "refused_folders",
)


def check_scope(inputs: SyncInputs, root: str) -> None:
    """A run needs a folder of its own, and a knowledge base or the notes."""
    if not root.strip().strip("/"):
        raise ValueError("name the folder to sync into")
    if inputs.notes is None and inputs.bases.isEmpty():
        raise ValueError("select at least one knowledge base or turn note sync on")


def standing_files(inputs: SyncInputs) -> DataFrame:
    """Paths of the files that a folder of the run could meet."""
    paths = inputs.documents.select("path").unionByName(inputs.attachments.select("path"))
    return paths if inputs.files is None else paths.unionByName(inputs.files.select("path"))


def stopped_walks(inputs: SyncInputs, root: str, folders: DataFrame, starts: DataFrame) -> DataFrame:
    """``kb_id, kb_name, seq, visit, quota, message``: where the walk through a knowledge base
    ends early, at most one row each. It ends at the first folder whose listing failed or
    whose path is a file's; the rest of the base is not visited. The notes count as one
    folder of a base without id, behind all others."""
    notes = folders.sparkSession.range(0 if inputs.notes is None else 1)
    last = F.lit(NO_CUT)
    everything = folders.join(starts, "node").select("kb_id", "kb_name", "folder_id", "path", "seq", "visit").unionByName(
        notes.select(
            F.lit("").alias("kb_id"), F.lit(None).cast("string").alias("kb_name"), F.lit("").alias("folder_id"),
            F.lit(f"{root}/{NOTES_DIR_NAME}").alias("path"), last.alias("seq"), last.alias("visit"),
        )
    )
    taken = standing_files(inputs)
    blocked = everything.join(taken, "path", "left_semi").select(
        "kb_id", "kb_name", "seq", "visit", F.lit(False).alias("quota"), F.format_string(PATH_TAKEN, "path").alias("message")
    )
    if inputs.listings is not None:
        failed = inputs.listings.where("outcome <> 'success'").select(
            F.coalesce("kb_id", F.lit("")).alias("kb_id"), F.coalesce("folder_id", F.lit("")).alias("folder_id"),
            (F.col("outcome") == "quota").alias("quota"), F.coalesce("message", F.lit("")).alias("message"),
        )
        unread = everything.join(failed, ["kb_id", "folder_id"]).select("kb_id", "kb_name", "seq", "visit", "quota", "message")
        # a folder is made before it is listed
        blocked = blocked.withColumn("later", F.lit(0)).unionByName(unread.withColumn("later", F.lit(1)))
    else:
        blocked = blocked.withColumn("later", F.lit(0))
    where = F.struct("visit", "later", "message")
    first = blocked.groupBy("kb_id").agg(F.min_by(F.struct("kb_name", "seq", "visit", "quota", "message"), where).alias("stop"))
    return first.select("kb_id", "stop.*")


def change_feed(
    inputs: SyncInputs, root: str, folders: DataFrame, group_rows: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """All items in processing order, knowledge bases first, then notes, and the walks that
    failed (``seq, kb_id, title, error``; None: no walk did).

    A failed walk drops the rest of its base and is one failure; one that met the quota ends
    the run there and is none.
    """
    numbered, starts = walk(place_items(inputs.items, folders), folders, group_rows=group_rows)
    feed = numbered.select(
        "seq", F.lit(False).alias("standalone"), "kb_id", "kb_name", F.col("media_id").alias("doc_id"), "title",
        F.col("parent_path").alias("parent"), F.lit(None).cast("bigint").alias("note_t"),
    )
    if inputs.notes is not None:
        # notes are numbered on their own and stand behind all others
        feed = cut(feed)
        notes = with_order_number(inputs.notes, [F.col("pos").cast("bigint"), "docid"])
        feed = feed.unionByName(
            notes.select(
                (F.col("seq") + feed.count()).alias("seq"), F.lit(True).alias("standalone"), F.lit("").alias("kb_id"),
                F.lit(NOTES_DIR_NAME).alias("kb_name"), F.col("docid").alias("doc_id"), "title",
                F.lit(f"{root}/{NOTES_DIR_NAME}").alias("parent"), to_seconds("modify_time").alias("note_t"),
            )
        )
    # one row per knowledge base at most, as many as the settings list
    stops = cut(stopped_walks(inputs, root, folders, starts))
    if stops.isEmpty():
        return feed, None
    quota = stops.where("quota").agg(F.min("visit").alias("visit"), F.min("seq").alias("seq")).first()
    border = F.when(F.col("standalone"), F.lit(-1)).otherwise(F.col("_end"))
    reached = feed.join(settings_table(stops.select("kb_id", F.col("seq").alias("_end"))), "kb_id", "left")
    kept = reached.where(F.col("_end").isNull() | (F.col("seq") < border)).select(feed.columns)
    failures = stops.where("NOT quota")
    if quota["visit"] is not None:
        failures = failures.where(F.col("visit") < quota["visit"])
        if quota["visit"] != NO_CUT:  # not the listing of the notes, which is the last
            kept = kept.where(~F.col("standalone") & (F.col("seq") < quota["seq"]))
    title = F.when(F.col("kb_id") == "", F.lit(NOTES_FAILED)).otherwise(F.format_string(BASE_FAILED, "kb_name"))
    return kept, failures.select("seq", "kb_id", title.alias("title"), F.col("message").alias("error"))


def _quota(table: DataFrame) -> Column:
    return F.col("outcome") == "quota" if "outcome" in table.columns else F.lit(False)


def with_answers(feed: DataFrame, inputs: SyncInputs) -> DataFrame:
    """Join the heads of all answers: never a body, only whether it is there.

    Where the index holds each document once, its entries are joined beside the media answers,
    by the same key; the fold then moves no rows to it.
    """
    media = inputs.media.select(
        F.col("media_id").alias("doc_id"),
        F.col("media_type").alias("info_media_type"),
        "notebook_id",
        "url",
        to_seconds("update_time").alias("media_t"),
        _quota(inputs.media).alias("media_quota"),
        F.lit(True).alias("has_info"),
    )
    contents = inputs.contents.select(
        F.col("doc_id").alias("content_key"), F.lit(True).alias("has_content"), _quota(inputs.contents).alias("content_quota")
    )
    # with a landed has_text flag the decision does not read the pages at all
    text = F.when(F.col("has_text"), "x") if "has_text" in inputs.fetched.columns else F.col("text")
    fetched = inputs.fetched.select(
        "url",
        F.col("status").alias("fetch_status"),
        download_outcome("status").alias("fetch_outcome"),
        url_kind("content_type", text).alias("kind"),
        "content_type",
    )
    joined = feed.join(media, "doc_id", "left")
    indexed = []
    if repeated_keys(inputs.index.where("doc_id IS NOT NULL"), "doc_id").isEmpty():
        joined = with_index(joined, inputs.index, "doc_id")
        indexed = [c for c in joined.columns if c in ("known", "known_t", "index_path", "there")]
    has_media = F.col("standalone") | F.coalesce(F.col("has_info") & ~F.col("media_quota"), F.lit(False))
    route = F.when(F.col("standalone"), "note").otherwise(content_route("info_media_type", "notebook_id", "url"))
    joined = joined.select(
        "seq", "standalone", "kb_id", "kb_name", "doc_id", "title", "parent", *indexed,
        F.coalesce("note_t", "media_t", F.lit(0).cast("bigint")).alias("t"),
        has_media.alias("has_media"),
        F.coalesce("media_quota", F.lit(False)).alias("media_quota"),
        route.alias("route"),
        F.when(route == "note", F.concat(F.lit("n"), F.when(F.col("standalone"), F.col("doc_id")).otherwise(F.coalesce("notebook_id", "doc_id"))))
        .when(route == "url", F.concat(F.lit("u"), "url")).alias("asked"),
    )
    # an item asks for a note's text or for an address, so it meets both kinds of answers at once
    answers = contents.withColumn("asked", F.concat(F.lit("n"), "content_key")).drop("content_key").unionByName(
        fetched.withColumn("asked", F.concat(F.lit("u"), "url")).drop("url"), allowMissingColumns=True
    )
    joined = lookup(joined, answers, "asked", "seq")
    key = F.expr("substring(asked, 2)")
    joined = joined.withColumns({"content_key": F.when(F.col("route") == "note", key), "url": F.when(F.col("route") == "url", key)}).drop("asked")
    note_ready = F.coalesce(F.col("has_content") & ~F.col("content_quota"), F.lit(False))
    url_ready = F.coalesce(F.col("fetch_outcome") == "success", F.lit(False))
    ready = F.when(F.col("route") == "note", note_ready).when(F.col("route") == "url", url_ready).otherwise(F.lit(False))
    error = (
        F.when(~F.col("has_media"), F.lit(NOT_LANDED))
        .when(F.col("route") == "none", F.lit(NO_SOURCE))
        .when(F.col("fetch_status").isNotNull(), F.format_string(DOWNLOAD_FAILED + "(%d)", "fetch_status"))
        .otherwise(F.lit(NOT_LANDED))
    )
    return joined.withColumns(
        {
            "ready": ready,
            "error": F.when(~F.col("has_media") | ~ready, error),
            "content_quota": F.coalesce("content_quota", F.lit(False)),
        }
    )


def settle(staged: DataFrame, inputs: SyncInputs, params: SyncParams) -> tuple[DataFrame, DataFrame]:
    """Actions, results and paths of all items, and the claims behind the paths.

    A document whose path clashes counts as failed, and a failed occurrence does
    not enter the index, so later occurrences of it are decided anew. Decisions
    only depend on earlier rows, so repeating the pass with the clashes found so
    far settles; without clashes one pass is enough.
    """
    clashed = None
    may_stop = not staged.where("media_quota OR content_quota").isEmpty()
    while True:
        ok = F.col("has_media") & F.col("ready")
        feed = staged
        if clashed is not None:
            feed = staged.join(clashed.withColumn("clashed", F.lit(True)), "seq", "left")
            ok = ok & F.col("clashed").isNull()
        acted = fold_actions(feed.withColumn("ok", ok), inputs.index, params.group_rows)
        if may_stop:
            asked = (F.col("action") != "skip") & F.col("content_quota")
            acted = before_quota(acted, "seq", F.col("media_quota") | asked)
        result = run_result(F.col("has_media"), F.col("action"), F.col("ready"))
        targets = write_targets(acted.withColumn("result", result), inputs.documents)
        in_place = F.col("in_place") | ((F.col("action") == "update") & F.col("prior_ok").isNotNull())
        # names and extensions are worked out for rows that write
        writes = F.coalesce(F.col("result").isin("created", "updated"), F.lit(False))
        judged = cut(
            targets.withColumn("in_place", in_place)
            .withColumn("base", F.when(writes, safe_file_name("title")))
            .withColumn("fetch_ext", F.when(writes & (F.col("kind") == "file"), file_ext("content_type", "url")))
            .withColumn("writes", F.col("result").isin("created", "updated"))
            .drop(*DECIDED)
        )
        claims = cut(claim_paths(judged.where("writes AND NOT in_place"), inputs.documents))
        # an original typed as Markdown takes the path its own document needs
        blocks_itself = judged.where("writes AND NOT in_place AND kind = 'file' AND fetch_ext = 'md'").select("seq")
        found = cut(claims.where("clash").select("seq").union(blocks_itself).distinct())
        changed = found if clashed is None else found.exceptAll(clashed).union(clashed.exceptAll(found))
        clashed = found
        if changed.isEmpty():
            break
    paths = claims.select("seq", F.col("path").alias("claimed_path"), F.col("name").alias("claimed_name"))
    failed = clashed.withColumn("path_exists", F.lit(True))
    # only rows that claimed a path meet the claims, the others stay where they are
    claiming, own = F.col("writes") & ~F.col("in_place"), judged
    named = own.where(claiming).join(paths, "seq", "left").join(failed, "seq", "left").unionByName(
        own.where(~claiming), allowMissingColumns=True
    )
    clash = F.coalesce("path_exists", F.lit(False)) & F.col("writes")
    settled = named.withColumns(
        {
            "result": F.when(clash, "failed").otherwise(F.col("result")),
            "error": F.when(clash, F.lit(PATH_EXISTS)).otherwise(F.col("error")),
            "path": F.when(F.col("in_place"), F.col("index_path")).otherwise(F.col("claimed_path")),
            "writes": F.col("writes") & ~clash,
        }
    )
    settled = settled.withColumns(
        {
            "path": F.when(F.col("writes"), F.col("path")),
            "in_place": F.col("in_place") & F.col("writes"),
        }
    ).drop("path_exists", "claimed_path")
    return settled, claims


def last_writes_of(settled: DataFrame) -> DataFrame:
    """One write per document, its last: a combined maximum, then a unique key. Documents that
    do not come again stay where they are."""
    more = settled.where("writes AND again")
    last = more.groupBy("doc_id").agg(F.max("seq").alias("seq")).select("seq")
    return settled.where("writes AND NOT again").unionByName(more.join(last, "seq", "left_semi").select(settled.columns))


def converted(writes: DataFrame, inputs: SyncInputs, at_most: int) -> DataFrame:
    """Written notes and articles (``DOCUMENT``) with ``body, body_error``, ``at_most`` so many.

    Only rows that are written reach this point, so nothing is converted in vain. What the
    documents are made of goes along, so a body need not be moved to meet it again.
    """
    contents = inputs.contents.select(F.col("doc_id").alias("content_key"), F.coalesce("content", F.lit("")).alias("raw"))
    asked = writes.where("route = 'note'")
    notes = asked.join(only_wanted(contents, asked, "content_key", at_most), "content_key").select(*DOCUMENT, "raw")
    asked = writes.where("kind = 'article'")
    pages = only_wanted(inputs.fetched.select("url", "text"), asked, "url", at_most)
    articles = asked.join(pages, "url").select(*DOCUMENT, "text")
    return cut(
        convert_bodies(notes, "raw")
        .select(*DOCUMENT, "body", "body_error")
        .unionByName(extract_articles(articles).select(*DOCUMENT, "body", F.lit(None).cast("string").alias("body_error")))
    )


def redecided(settled: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies of earlier rounds with what was decided last."""
    return cut(last_writes_of(settled).select(*DOCUMENT).join(bodies.select("seq", "body"), "seq"))


def settle_and_convert(
    staged: DataFrame, inputs: SyncInputs, params: SyncParams
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled items, claims, and the written notes and articles with their bodies.

    A body that cannot be converted makes its item fail, which frees its path and
    its place in the index. The narrow decisions are then taken again; bodies that
    are converted already are kept and meet the new decisions. Otherwise they stand
    beside the decisions they were converted for.
    """
    bodies = None
    while True:
        settled, claims = settle(staged, inputs, params)
        settled = cut(settled)
        waiting = last_writes_of(settled).where("route = 'note' OR kind = 'article'")
        if bodies is not None:
            waiting = waiting.join(bodies.select("seq"), "seq", "left_anti")
            if waiting.isEmpty():
                return settled, claims, redecided(settled, bodies)
        fresh = converted(waiting, inputs, settled.where("writes").count())
        bodies = fresh if bodies is None else bodies.unionByName(fresh)
        broken = fresh.where("body_error IS NOT NULL").join(settled.select("seq", "content_key"), "seq")
        broken = broken.groupBy("content_key").agg(F.min("body_error").alias("body_error"))
        if broken.isEmpty():
            return settled, claims, fresh if bodies is fresh else redecided(settled, bodies)
        marked = staged.join(broken, "content_key", "left")
        unusable = F.col("body_error").isNotNull()
        staged = cut(
            marked.withColumn("ready", F.col("ready") & ~unusable)
            .withColumn("error", F.coalesce("error", "body_error"))
            .drop("body_error")
        )


def blocked_originals(settled: DataFrame, inputs: SyncInputs) -> DataFrame:
    """Originals typed as Markdown: stored under the path that their document needed,
    which then failed."""
    own = (F.col("error") == PATH_EXISTS) & (F.col("kind") == "file") & (F.col("fetch_ext") == "md")
    files = settled.where(own & F.col("claimed_name").isNotNull()).withColumn("name", F.col("claimed_name"))
    types = inputs.fetched.select("url", "content_type")
    return stored_originals(files.join(types, "url")).select("seq", "doc_id", "url", "file_path", "ext")


def file_bytes(originals: DataFrame, fetched: DataFrame, at_most: int) -> DataFrame:
    """Path and bytes of stored originals; only files that are written are joined."""
    body = F.col("body") if "body" in fetched.columns else F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    wanted = only_wanted(fetched.select("url", body.alias("body")), originals, "url", at_most)
    return originals.join(wanted, "url").select(
        F.col("file_path").alias("path"), "doc_id", "seq", "body"
    )


def file_bodies(writes: DataFrame, inputs: SyncInputs, claims: DataFrame) -> DataFrame:
    """Items kept as their original bytes (``DOCUMENT``), with stub body, file path and extension."""
    files = writes.where("kind = 'file'")
    names = name_seen_by(files.where("in_place"), claims, inputs.documents)
    named = files.where("NOT in_place").withColumn("name", F.col("claimed_name")).unionByName(names)
    types = inputs.fetched.select("url", "content_type")
    return stored_originals(named.join(types, "url")).select(*DOCUMENT, "file_path", "ext", "body")


def run_sync(inputs: SyncInputs, params: SyncParams) -> SyncResult:
    """One incremental run over all selected knowledge bases and notes."""
    check_scope(inputs, params.root)
    known = with_files(inputs.index.select("doc_id", "path", "update_time"), inputs.documents)
    inputs = replace(inputs, index=cut(known))
    folders, refused = expand_folders(inputs.items, inputs.bases, params.root)
    feed, failed_walks = change_feed(inputs, params.root, folders, params.group_rows)
    staged = with_again(cut(with_answers(feed, inputs)), "doc_id")
    settled, claims, bodies = settle_and_convert(staged, inputs, params)

    writes, items = last_writes_of(settled), settled.count()
    stubs = cut(file_bodies(writes, inputs, claims))
    written = bodies.select(*DOCUMENT, F.col("body").alias("content")).unionByName(
        stubs.select(*DOCUMENT, F.col("body").alias("content"))
    )
    image_dir, _ = attachment_dir(
        F.lit(params.root), F.col("kb_name"), F.lit(params.per_kb_attachments), F.lit(params.global_folder)
    )
    localized, files = localize(written.withColumn("image_dir", image_dir), inputs.image_blobs, stored=True)

    title = document_title("title", "doc_id")
    block = property_block(title, F.lit(params.run_date), F.col("url"))
    old = inputs.documents.select("path", F.col("content").alias("old_content"))
    created = localized.where("NOT in_place").withColumn("content", new_document(block, F.col("content")))
    in_place = localized.where("in_place")
    updated = in_place.join(only_wanted(old, writes.where("in_place"), "path", items), "path", "left")
    spliced = splice_body(F.coalesce("old_content", F.lit("")), F.col("content"), block)
    updated = updated.withColumn("content", spliced)
    updated = updated.withColumn(
        "content", merge_properties(F.col("content"), title, F.lit(params.run_date), F.col("url"))
    )
    columns = ["path", "doc_id", "content", "downloaded", "failed"]
    documents = created.select(*columns).unionByName(updated.select(*columns))

    index_changes = writes.select(
        "doc_id",
        "path",
        "kb_id",
        title.alias("title"),
        F.lit(0).alias("media_type"),
        F.when(F.col("t") > 0, F.col("t").cast("string")).otherwise("").alias("update_time"),
        F.lit(params.synced_at).alias("synced_at"),
    )
    attachments = new_attachments(files, inputs.attachments, ["seq"])
    blobs = inputs.image_blobs
    if "body" not in blobs.columns:
        blobs = blobs.withColumn("body", F.lit(None).cast("binary"))
    originals = stubs.select("seq", "doc_id", "url", "file_path", "ext").unionByName(blocked_originals(settled, inputs))
    results = settled.select(
        "seq", "doc_id", "kb_id", "title", "route", "kind", "action", "result", "error", "path", "in_place"
    )
    if failed_walks is not None:
        failures = failed_walks.select("seq", "kb_id", "title", F.lit("failed").alias("result"), "error", F.lit(False).alias("in_place"))
        results = results.unionByName(failures, allowMissingColumns=True)
    needed = folders.select("path").union(files.select(F.col("image_dir").alias("path")))
    if inputs.notes is not None:
        notes_folder = F.lit(f"{params.root}/{NOTES_DIR_NAME}").alias("path")
        needed = needed.union(needed.sparkSession.range(1).select(notes_folder))
    return SyncResult(
        results=results,
        documents=documents,
        attachments=attachments,
        attachment_files=attachment_bytes(attachments, blobs),
        originals=originals,
        original_files=file_bytes(originals, inputs.fetched, items),
        folders=folders_needed(needed, "path"),
        index_changes=index_changes,
        report=with_summary(run_counts(results)),
        errors=error_lines(results),
        refused_folders=refused,
    )


def with_summary(counts: DataFrame) -> DataFrame:
    return counts.withColumn("summary", run_summary(*[F.col(c) for c in ("created", "updated", "skipped", "failed")]))


def commit_run(result: SyncResult, store: IndexStore, folder: str, run: int) -> bool:
    """Write the tables of a run into folders of its own; they and its index changes become
    visible with one commit. A run that breaks before leaves folders nobody reads, and
    repeating a committed run changes nothing."""
    if run <= store.last_run():
        return False
    own = f"r{run}-{uuid.uuid4().hex}"
    for name in RUN_TABLES:
        getattr(result, name).write.parquet(f"{folder}/{name}/run={own}")
    return store.append(result.index_changes, run, own)


def run_rows(store: IndexStore, folder: str, name: str) -> DataFrame:
    """A table of all committed runs, with the ``number`` of the commit."""
    rows = store.spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")
    # one row per run
    return rows.join(F.broadcast(store.run_folders()), "run").drop("run")


def vault(store: IndexStore, folder: str, name: str, before: DataFrame) -> DataFrame:
    """A table of all committed runs, unique per path, over what stood there ``before``.

    The newest run of a path is found on narrow columns; a single run is the newest of all.
    """
    rows = run_rows(store, folder, name)
    if store.run_folders().count() == 1:
        rows = rows.where("path IS NOT NULL")
        kept = before.join(rows.select("path"), "path", "left_anti")
        return kept.unionByName(rows.select(*before.columns))
    newest = rows.groupBy("path").agg(F.max("number").alias("number"))
    written = rows.join(newest, ["path", "number"]).drop("number")
    kept = before.join(newest.select("path"), "path", "left_anti")
    return kept.unionByName(written.select(*before.columns))


def catalog_probe(items: DataFrame) -> DataFrame:
    """Items per knowledge base and type, in all and at the first level."""
    return items.groupBy("kb_id", "media_type").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.coalesce("parent_folder_id", F.lit("")) == "").alias("first_level"),
    )


def selected_scope(items: DataFrame, bases: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Items of the selected bases with the base position, plus notes if they are on."""
    chosen = settings_table(bases.where("selected").select("kb_id", "kb_pos"))
    feed = items.join(chosen, "kb_id").select("kb_id", "kb_pos", F.col("media_id").alias("doc_id"), "title")
    if notes is None:
        return feed
    extra = notes.select(F.col("docid").alias("doc_id"), "title", F.lit("").alias("kb_id"))
    return feed.unionByName(extra, allowMissingColumns=True)

