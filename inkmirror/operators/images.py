"""Image references: extraction, fetch join, naming, rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import image_ext, image_file_name, join_path
from ..functions.rules import download_outcome
from ..functions.text_basics import TAG_END, WS, replace_each_match
from ..functions.urls import absolute_url
from ..session import cut

# The reference forms.
_NOT_WS = WS.replace("[", "[^)", 1)
MARKDOWN_IMAGE = rf'!\[([^\]]*)\]\(({_NOT_WS}+)(?:{WS}+"[^"]*")?\)'
HTML_IMAGE = rf'(?i)<img{TAG_END}[^>]*(?<![A-Za-z0-9_])src="([^"]+)"[^>]*>'
RELATIVE_MARKDOWN_IMAGE = rf"!\[([^\]]*)\]\(((?!https?:|data:){_NOT_WS}+)\)"
RELATIVE_HTML_IMAGE = rf'(?i)<img{TAG_END}([^>]*)(?<![A-Za-z0-9_])src="((?!https?:|data:)[^"]+)"'
DATA_URI_HEAD = r"^data:([\w/+.-]+);base64,"
HAS_IMAGE = rf"{MARKDOWN_IMAGE}|{HTML_IMAGE}"


def image_urls(content: Column | str) -> Column:
    """URLs in first-seen order: all Markdown references, then all HTML ones."""
    content = F.col(content) if isinstance(content, str) else content
    markdown = F.regexp_extract_all(content, F.lit(MARKDOWN_IMAGE), F.lit(2))
    html = F.regexp_extract_all(content, F.lit(HTML_IMAGE), F.lit(1))
    return F.array_distinct(F.concat(markdown, html))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, in which the value is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def data_uri_bytes(uri: Column) -> Column:
    """Bytes of a base64 data URI, NULL where it cannot be decoded.

    White space and missing padding are tolerated, other characters are not.
    """

    def unpadded(packed: Column) -> Column:
        cut_by = F.when(F.endswith(packed, F.lit("==")), 2).when(F.endswith(packed, F.lit("=")), 1).otherwise(0)
        return F.when(F.length(packed) % 4 == 0, F.left(packed, F.length(packed) - cut_by)).otherwise(packed)

    def decoded(bare: Column) -> Column:
        # other line ends and all else that is not base64 fail here
        sound = bare.rlike(r"^[A-Za-z0-9+/]*\z") & (F.length(bare) % 4 != 1)
        padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
        return F.when(sound, F.try_to_binary(padded, F.lit("base64")))

    def of_uri(u: Column) -> Column:
        head = F.regexp_extract(u, DATA_URI_HEAD, 0)
        packed = F.substring(u, F.length(head) + 1, F.length(u))
        for blank in "\t\f ":
            packed = F.replace(packed, F.lit(blank), F.lit(""))
        one_line = ~F.contains(u, F.lit("\n")) & ~F.contains(u, F.lit("\r"))
        return F.when((head != "") & one_line, _once(_once(packed, unpadded), decoded))

    return _once(uri, of_uri)


def data_uri_ext(uri: Column) -> Column:
    """Extension of a data URI that can be decoded; the type stands in its head."""
    return image_ext(F.regexp_extract(uri, DATA_URI_HEAD, 1), F.lit(""))


def absolute_image_urls(docs: DataFrame, content: str, base_url: str) -> DataFrame:
    """Relative image references made absolute; what cannot be resolved stays.

    Addresses are worked out on the short list of references, then the text is rewritten.
    """
    text = F.col(content)
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(2)) for p in (RELATIVE_MARKDOWN_IMAGE, RELATIVE_HTML_IMAGE)]
    step = docs.withColumn("_relative", F.array_distinct(F.concat(*found)))
    step = step.withColumn("_absolute", F.transform("_relative", lambda r: absolute_url(r, F.coalesce(base_url, F.lit("")))))
    pairs = F.filter(F.arrays_zip("_relative", "_absolute"), lambda p: p["_absolute"].isNotNull())
    step = step.withColumn("_known", F.map_from_entries(pairs))

    def swapped(pattern: str, at_end: bool):
        def replacement(match: Column) -> Column:
            old = F.regexp_extract(match, pattern, 2)
            # in Markdown the URL closes the match; in HTML its first occurrence in the tag counts
            at = F.length(match) - F.length(old) if at_end else F.position(old, match)
            return F.coalesce(_spliced(match, at, old, F.try_element_at(F.col("_known"), old)), match)

        return replacement

    in_markdown = replace_each_match(text, RELATIVE_MARKDOWN_IMAGE, swapped(RELATIVE_MARKDOWN_IMAGE, True))
    step = step.withColumn("_step", F.when(F.size("_relative") > 0, in_markdown))
    in_html = replace_each_match(F.col("_step"), RELATIVE_HTML_IMAGE, swapped(RELATIVE_HTML_IMAGE, False))
    step = step.withColumn(content, F.when(F.size("_relative") > 0, in_html).otherwise(text))
    return step.drop("_relative", "_absolute", "_known", "_step")


def _spliced(text: Column, at: Column, old: Column, new: Column) -> Column:
    after = at + F.length(old)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, after, F.length(text)))


def url_key(url: Column) -> Column:
    """What names a URL in maps and joins: a digest for data URIs, else the URL."""
    return F.when(url.startswith("data:"), F.concat(F.lit("data:"), F.sha2(url, 256))).otherwise(url)


def image_refs(docs: DataFrame) -> DataFrame:
    """One row per document and distinct URL: ``doc_id, pos, url``."""
    listed = docs.select("doc_id", image_urls("content").alias("urls"))
    return listed.select("doc_id", F.posexplode("urls").alias("pos", "url"))


def resolve_refs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """References with ``ok`` and ``ext``; only the blobs' heads are joined, never
    their bytes. ``blobs`` is unique per URL, so a much used URL is a hot key of
    one side only and the adaptive skew join can split it."""
    is_data = F.col("url").startswith("data:")
    # data URIs are judged where they are, before anything is shuffled
    local = refs.select(
        "doc_id",
        "pos",
        "url",
        F.when(is_data, data_uri_bytes(F.col("url")).isNotNull()).alias("inline_ok"),
        F.when(is_data, data_uri_ext(F.col("url"))).alias("inline_ext"),
    )
    heads = blobs.select(
        "url",
        F.col("content_type"),
        (download_outcome("status") == "success" if "status" in blobs.columns else F.lit(True)).alias("fetched"),
    )
    joined = local.join(heads, "url", "left")
    ok = F.coalesce("inline_ok", "fetched", F.lit(False))
    ext = F.coalesce(F.col("inline_ext"), image_ext("content_type", "url"))
    return joined.select("doc_id", "pos", "url", ok.alias("ok"), F.when(ok, ext).alias("ext"))


def numbered(resolved: DataFrame) -> DataFrame:
    """Per document the stored images, numbered from 1 over the successes only.

    The list of a document is no longer than its own text, so it fits a group.
    """
    all_refs = F.array_sort(F.collect_list(F.struct("pos", "url", "ok", "ext")))
    grouped = resolved.groupBy("doc_id").agg(all_refs.alias("refs"))
    stored = F.filter("refs", lambda r: r["ok"])
    images = F.transform(
        stored,
        lambda r, i: F.struct(
            r["url"].alias("url"),
            (i + 1).alias("image_no"),
            image_file_name(F.col("doc_id"), i + 1, r["ext"]).alias("file_name"),
        ),
    )
    return grouped.select(
        "doc_id",
        images.alias("images"),
        F.size(stored).alias("downloaded"),
        (F.size("refs") - F.size(stored)).alias("failed"),
    )


def rewrite_refs(content: Column, names: Column) -> Column:
    """References to stored images as embeds; ``names`` maps the key of a URL to a file name."""

    def embed_markdown(match: Column) -> Column:
        alt = F.regexp_extract(match, MARKDOWN_IMAGE, 1)
        file_name = F.try_element_at(names, url_key(F.regexp_extract(match, MARKDOWN_IMAGE, 2)))
        shown = F.when(alt != "", F.concat(F.lit("|"), alt)).otherwise("")
        return F.coalesce(F.concat(F.lit("![["), file_name, shown, F.lit("]]")), match)

    def embed_html(match: Column) -> Column:
        file_name = F.try_element_at(names, url_key(F.regexp_extract(match, HTML_IMAGE, 1)))
        return F.coalesce(F.concat(F.lit("![["), file_name, F.lit("]]")), match)

    return replace_each_match(replace_each_match(content, MARKDOWN_IMAGE, embed_markdown), HTML_IMAGE, embed_html)


def localize(docs: DataFrame, blobs: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with embedded images, and the images to store.

    ``docs`` has ``doc_id, content, image_dir`` and maybe ``seq``, one row per document. Texts
    without a reference stay where they are; only the others meet the join. The
    texts are written once, because three branches read them, unless they are ``stored`` already.
    """
    docs = docs if stored else cut(docs)
    with_images = docs.where(F.col("content").rlike(HAS_IMAGE))
    plain = docs.where(~F.coalesce(F.col("content").rlike(HAS_IMAGE), F.lit(False)))
    images = numbered(resolve_refs(image_refs(with_images), blobs))
    joined = with_images.join(images, "doc_id", "left")
    names = F.map_from_entries(F.transform("images", lambda r: F.struct(url_key(r["url"]), r["file_name"])))
    named = joined.withColumn("_names", names)
    rewritten = named.withColumn("content", rewrite_refs(F.col("content"), F.col("_names"))).select(
        *docs.columns, "downloaded", "failed"
    )
    nothing = plain.select(*docs.columns, F.lit(0).alias("downloaded"), F.lit(0).alias("failed"))
    carried = [c for c in ("seq", "doc_id", "image_dir") if c in docs.columns]
    files = images.join(with_images.select(*carried), "doc_id").select(
        *carried, F.explode("images").alias("image")
    ).select(
        *carried,
        F.col("image.url").alias("url"),
        F.col("image.image_no").alias("image_no"),
        join_path(F.col("image_dir"), F.col("image.file_name")).alias("path"),
    )
    return rewritten.unionByName(nothing), files


def new_attachments(files: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Images whose path is still free; the first writer of a path wins.

    The winner is a combined minimum over narrow columns. ``collided`` counts the
    other documents that wanted the same path.
    """
    key = F.struct(*order, "doc_id", "url")
    first = files.groupBy("path").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("wanted"))
    free = first.join(existing.select("path").distinct(), "path", "left_anti")
    return free.select(
        "path", F.col("first.doc_id").alias("doc_id"), F.col("first.url").alias("url"),
        (F.col("wanted") - 1).alias("collided"),
    )


def attachment_bytes(attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """Bytes of each new attachment: of the fetched blob, or decoded from its data URI."""
    inline = F.col("url").startswith("data:")
    fetched = attachments.where(~inline).join(blobs.select("url", "body"), "url").select("path", "doc_id", "body")
    decoded = attachments.where(inline).select("path", "doc_id", data_uri_bytes(F.col("url")).alias("body"))
    return fetched.unionByName(decoded)
