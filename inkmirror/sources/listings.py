"""Paged listings, assembled from landed responses.

A listing is read page by page until a page says it is the last, is empty, or
(for catalogs and folder levels) names no next cursor. Pages landed after that
one are left over from another read and are ignored.

Landed pages may carry their number, or only the cursor they were asked with:
``follow_cursors`` then finds their order, ``note_offset_gaps`` and ``assemble_notes_at`` do
so for notes, whose cursors are offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_basics import has_text
from ..operators.chains import rank_chain
from ..operators.scans import GROUP_ROWS, running_before
from ..session import cut

# Fixed value: rows per page.
PAGE_ROWS = 20

CATALOG_PAGE = """info_list ARRAY<STRUCT<kb_id STRING, kb_name STRING, base_type STRING, role_type STRING,
    content_count STRING, member_count STRING>>, is_end BOOLEAN, next_cursor STRING"""
LEVEL_PAGE = """knowledge_list ARRAY<STRUCT<media_id STRING, media_type INT, title STRING,
    parent_folder_id STRING, tags ARRAY<STRING>>>, is_end BOOLEAN, next_cursor STRING"""
NOTE_PAGE = """note_book_list ARRAY<STRUCT<basic_info STRUCT<basic_info STRUCT<docid STRING, title STRING,
    summary STRING, create_time STRING, modify_time STRING, status INT, folder_id STRING,
    folder_name STRING>>>>, is_end BOOLEAN"""


def until_last_page(pages: DataFrame, keys: list[str], terminal: Column) -> DataFrame:
    """Pages up to and including the first terminal one of each listing.

    The border is an aggregate over the page heads, so no listing has to fit a window.
    """
    borders = pages.where(terminal).groupBy(*keys).agg(F.min("page_no").alias("_border"))
    joined = pages.join(borders, keys, "left")
    return joined.where(F.col("_border").isNull() | (F.col("page_no") <= F.col("_border"))).drop("_border")


def _parsed(envelopes: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in envelopes.columns if c != "payload"]
    data = F.from_json("payload", f"code BIGINT, msg STRING, data STRUCT<{_as_struct(schema)}>")["data"]
    return envelopes.select(*keep, data.alias("page")).where(F.col("page").isNotNull())


def _as_struct(ddl: str) -> str:
    """Column list ``name TYPE, ...`` in the ``name: TYPE`` form of a struct."""
    import pyspark.sql.types as T

    inner = T.StructType.fromDDL(ddl).simpleString()
    return inner[len("struct<") : -1]


def _ends(items: Column, with_cursor: bool) -> Column:
    ended = F.coalesce(F.col("page.is_end"), F.lit(False)) | (F.coalesce(F.size(items), F.lit(0)) <= 0)
    return ended | ~has_text(F.col("page.next_cursor")) if with_cursor else ended


def newest_answers(envelopes: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The last landed answer of each request; found on the request's columns alone."""
    last = envelopes.groupBy(*keys).agg(F.max(newest).alias(newest))
    return envelopes.join(last, [*keys, newest], "left_semi")


def follow_cursors(
    envelopes: DataFrame, keys: list[str], page: str, items: str, cursor: str = "cursor", newest: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Landed pages with their place in the listing, and how each listing ends.

    A page was asked with ``cursor`` (empty: the first) and names the next one; ``page`` is its
    schema and ``items`` its list. ``newest`` orders repeated answers to one request. Returns
    the pages that a reader following the cursors meets, with ``page_no``, and ``keys, pages,
    ending``: complete, broken (the next page never landed) or loop (it was read before).
    A listing without a first page has no pages and no ending.
    """
    asked = envelopes.withColumn(cursor, F.coalesce(F.col(cursor), F.lit("")))
    if newest:
        asked = newest_answers(asked, [*keys, cursor], newest)
    parsed = _parsed(asked, page).select(
        *keys, cursor, F.when(~_ends(F.col(f"page.{items}"), with_cursor=True), F.col("page.next_cursor")).alias("_next")
    )
    # equal answers to one request are one page
    heads = cut(parsed.groupBy(*keys, cursor).agg(F.max("_next").alias("_next")))
    ranked = cut(rank_chain(heads, keys, cursor, "_next", F.col(cursor) == "").withColumnRenamed("rank", "page_no"))
    last = ranked.groupBy(*keys).agg(F.max_by(cursor, "page_no").alias(cursor), F.count(F.lit(1)).alias("pages"))
    landed = heads.select(*keys, F.col(cursor).alias("_next"), F.lit(True).alias("_landed"))
    ends = last.join(heads, [*keys, cursor]).join(landed, [*keys, "_next"], "left")
    ending = F.when(F.col("_next").isNull(), "complete").when(F.col("_landed"), "loop").otherwise("broken")
    return asked.join(ranked, [*keys, cursor]), ends.select(*keys, "pages", ending.alias("ending"))


def assemble_catalog(envelopes: DataFrame, keys: list[str]) -> DataFrame:
    """Knowledge bases of each catalog read, in listing order."""
    pages = _parsed(envelopes, CATALOG_PAGE)
    kept = until_last_page(pages, keys, _ends(F.col("page.info_list"), with_cursor=True))
    rows = kept.select(*keys, "page_no", F.posexplode("page.info_list").alias("pos", "entry"))
    return rows.select(*keys, "page_no", "pos", "entry.*")


def assemble_levels(envelopes: DataFrame, keys: list[str]) -> DataFrame:
    """Items of each folder level, in listing order."""
    pages = _parsed(envelopes, LEVEL_PAGE)
    kept = until_last_page(pages, keys, _ends(F.col("page.knowledge_list"), with_cursor=True))
    rows = kept.select(*keys, "page_no", F.posexplode("page.knowledge_list").alias("pos", "entry"))
    return rows.select(*keys, "page_no", "pos", "entry.*")


def tree_items(levels: DataFrame, kb: str = "kb_id", folder: str = "folder_id") -> DataFrame:
    """Assembled folder levels as the adjacency list of a run: an item belongs to the
    folder whose level lists it, at its place in that level."""
    return levels.select(
        F.col(kb).alias("kb_id"),
        "media_id",
        F.coalesce(F.col(folder), F.lit("")).alias("parent_folder_id"),
        "title",
        "media_type",
        (F.col("page_no").cast("bigint") * PAGE_ROWS + F.col("pos")).alias("pos"),
    )


def assemble_notes(envelopes: DataFrame, keys: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Notes of each listing, unwrapped; entries without an id are dropped but
    still count in the offset at which their page was asked for."""
    pages = _parsed(envelopes, NOTE_PAGE)
    kept = until_last_page(pages, keys, _ends(F.col("page.note_book_list"), with_cursor=False))
    size = F.greatest(F.coalesce(F.size("page.note_book_list"), F.lit(0)), F.lit(0)).cast("bigint")
    heads = running_before(
        kept.select(*keys, "page_no", size.alias("entries")),
        keys, "page_no", {"page_offset": ("sum", F.col("entries"))}, group_rows,
    ).drop("entries")
    rows = kept.select(*keys, "page_no", F.posexplode("page.note_book_list").alias("pos", "entry"))
    notes = rows.select(*keys, "page_no", "pos", F.col("entry.basic_info.basic_info.*"))
    return notes.where(has_text("docid")).join(heads, [*keys, "page_no"])


def _note_pages(envelopes: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Parsed note pages up to the last one, with the raw entries each covers."""
    asked = _parsed(envelopes, NOTE_PAGE).withColumn("page_no", F.col(offset).cast("bigint"))
    kept = until_last_page(asked, keys, _ends(F.col("page.note_book_list"), with_cursor=False))
    return kept.withColumn("entries", F.greatest(F.coalesce(F.size("page.note_book_list"), F.lit(0)), F.lit(0)).cast("bigint"))


def note_offset_gaps(envelopes: DataFrame, keys: list[str], offset: str = "page_offset", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``keys, page_offset, kind, from_entry, until_entry``: raw entries that no page of a note
    listing covers (gap) or that a page covers once more (overlap).

    A page asked at ``offset`` covers the raw entries from there on, those without an id
    included. Each page is held against how far all pages asked at lower offsets reach,
    a running maximum, so no two pages are paired. Repeated answers count once.
    """
    covers = _note_pages(envelopes, keys, offset).groupBy(*keys, "page_no").agg(F.max("entries").alias("entries"))
    reach = {"reached": ("max", F.col("page_no") + F.col("entries"))}
    seen = running_before(covers, keys, "page_no", reach, group_rows).withColumn("reached", F.coalesce("reached", F.lit(0).cast("bigint")))
    gap = F.col("page_no") > F.col("reached")
    found = seen.where(gap | ((F.col("page_no") < F.col("reached")) & (F.col("entries") > 0)))
    return found.select(
        *keys,
        F.col("page_no").alias("page_offset"),
        F.when(gap, "gap").otherwise("overlap").alias("kind"),
        F.least("page_no", "reached").alias("from_entry"),
        F.when(gap, F.col("page_no")).otherwise(F.least("reached", F.col("page_no") + F.col("entries"))).alias("until_entry"),
    )


def assemble_notes_at(envelopes: DataFrame, keys: list[str], newest: str, offset: str = "page_offset") -> DataFrame:
    """Notes of each listing by the raw entry they stand at: an entry that several pages
    cover is taken from the one that landed last (``newest``), so overlaps repeat no note."""
    pages = _note_pages(envelopes, keys, offset)
    rows = pages.select(*keys, newest, "page_no", F.posexplode("page.note_book_list").alias("pos", "entry"))
    placed = rows.select(
        *keys, (F.col("page_no") + F.col("pos")).alias("entry_no"), F.struct(newest, "page_no").alias("landed"),
        F.col("entry.basic_info.basic_info").alias("note"),
    )
    last = placed.groupBy(*keys, "entry_no").agg(F.max_by("note", "landed").alias("note"))
    return last.where(has_text("note.docid")).select(*keys, "entry_no", "note.*")


def land_pages(
    rows: DataFrame, keys: list[str], list_name: str, entry: Column, page_fields: dict[str, Column]
) -> DataFrame:
    """Flat listing rows (keys, page_no, pos) as landed responses, one per page.

    The inverse of the readers above; a page's list is bounded by the page size.
    """
    entries = F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"))))
    pages = rows.groupBy(*keys, "page_no").agg(
        F.transform(entries, lambda e: e["entry"]).alias(list_name),
        *[F.any_value(value).alias(name) for name, value in page_fields.items()],
    )
    data = F.struct(list_name, *page_fields)
    payload = F.to_json(F.struct(F.lit(0).alias("code"), F.lit("ok").alias("msg"), data.alias("data")))
    return pages.select(*keys, "page_no", payload.alias("payload"))


def paginate(rows: DataFrame, keys: list[str], order: str, page_rows: int = PAGE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Page number and place of each row within its listing, in ``order``."""
    ranked = running_before(rows, keys, order, {"_rank": ("sum", F.lit(1).cast("bigint"))}, group_rows)
    return ranked.select(
        *rows.columns,
        F.floor(F.col("_rank") / page_rows).cast("int").alias("page_no"),
        (F.col("_rank") % page_rows).cast("int").alias("pos"),
    )
