"""File names, folder paths and extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text_basics import WS_CHARS, as_col, bind, present, trim_all, utf16_prefix

# Names, limits and tables that results must agree on.
ILLEGAL_FILENAME_CHARS = '/\\:*?"<>|'
MAX_NAME_UNITS = 120
ID_PREFIX_UNITS = 8
UNTITLED = "untitled"
ATTACHMENT_DIR_NAME = "attachments"
NOTES_DIR_NAME = "Notes"
FILE_CONTENT_TYPE_EXT = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.ms-excel": "xls",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template": "dotx",
    "application/vnd.openxmlformats-officedocument.presentationml.slideshow": "ppsx",
    "application/vnd.ms-xpsdocument": "xps",
    "application/vnd.ms-visio.drawing": "vsdx",
    "text/plain": "txt",
    "text/markdown": "md",
    "text/html": "html",
    "application/zip": "zip",
    "application/x-zip-compressed": "zip",
    "application/vnd.rar": "rar",
    "application/x-7z-compressed": "7z",
    "application/octet-stream": "",
    "video/mp4": "mp4",
    "video/quicktime": "mov",
    "audio/mpeg": "mp3",
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "image/bmp": "bmp",
}
IMAGE_CONTENT_TYPE_EXT = {
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "image/bmp": "bmp",
    "image/x-icon": "ico",
    "image/tiff": "tiff",
}
FILE_URL_EXT = r"\.([a-zA-Z0-9]{2,5})\z"
IMAGE_URL_EXT = r"\.([a-zA-Z0-9]{2,4})(?:\z|\?|#)"

MAPPED_CHARS = "_" * len(ILLEGAL_FILENAME_CHARS) + " " * len(WS_CHARS)


def safe_file_name(title: Column | str, max_units: int = MAX_NAME_UNITS) -> Column:
    """A title as a file name; never empty."""
    # one pass maps illegal characters and every kind of white space
    mapped = F.translate(F.coalesce(as_col(title), F.lit("")), ILLEGAL_FILENAME_CHARS + WS_CHARS, MAPPED_CHARS)
    cleaned = F.trim(F.trim(F.regexp_replace(mapped, " {2,}", " ")), F.lit("."))
    return F.coalesce(present(trim_all(utf16_prefix(cleaned, max_units))), F.lit(UNTITLED))


def id_prefix(doc_id: Column | str, units: int = ID_PREFIX_UNITS) -> Column:
    return utf16_prefix(F.coalesce(as_col(doc_id), F.lit("")), units)


def fallback_title(doc_id: Column | str) -> Column:
    return F.concat(F.lit(UNTITLED + "-"), id_prefix(doc_id))


def document_title(title: Column | str, doc_id: Column | str) -> Column:
    """Title property; only an empty or missing title gets the fallback."""
    return F.coalesce(present(title), fallback_title(doc_id))


def clean_path(path: Column | str) -> Column:
    """One slash between parts, none at the edges."""
    return F.regexp_replace(F.regexp_replace(as_col(path), "/+", "/"), r"^/|/\z", "")


def join_path(*parts: Column) -> Column:
    return clean_path(F.concat_ws("/", *parts))


def attachment_dir(
    root: Column, kb_name: Column | str, per_kb: Column, global_folder: Column | str
) -> tuple[Column, Column]:
    """Attachment folder and whether the global mode fell back to the per-base one."""
    configured = present(trim_all(F.coalesce(as_col(global_folder), F.lit(""))))
    own = join_path(root, as_col(kb_name), F.lit(ATTACHMENT_DIR_NAME))
    folder = F.when(per_kb | configured.isNull(), own).otherwise(clean_path(configured))
    return folder, ~per_kb & configured.isNull()


def media_type_of(content_type: Column | str) -> Column:
    """Content type without parameters, lower case."""
    bare = F.split_part(F.coalesce(as_col(content_type), F.lit("")), F.lit(";"), F.lit(1))
    return F.lower(trim_all(bare))


def _lookup(table: dict[str, str], key: Column) -> Column:
    # fixed tables of 28 and 9 rows: a literal map needs no join at all
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return present(F.try_element_at(literal, key))


def url_path(url: Column | str) -> Column:
    return F.try_parse_url(as_col(url), F.lit("PATH"))


def file_ext(content_type: Column | str, url: Column | str) -> Column:
    """Extension of a stored original: content type, then URL path, then ``bin``."""
    from_type = _lookup(FILE_CONTENT_TYPE_EXT, media_type_of(content_type))
    from_url = present(F.lower(F.regexp_extract(url_path(url), FILE_URL_EXT, 1)))
    return F.coalesce(from_type, from_url, F.lit("bin"))


def image_ext(content_type: Column | str, url: Column | str) -> Column:
    """Extension of an image: content type, then anywhere in the URL, then ``png``."""
    from_type = _lookup(IMAGE_CONTENT_TYPE_EXT, media_type_of(content_type))
    from_url = present(F.lower(F.regexp_extract(as_col(url), IMAGE_URL_EXT, 1)))
    return F.coalesce(from_type, from_url, F.lit("png"))


def image_file_name(doc_id: Column | str, index: Column, ext: Column) -> Column:
    """Last ``_`` part of the document id, the image number and the extension."""
    suffix = F.element_at(F.split(as_col(doc_id), "_", -1), -1)
    return F.concat(suffix, F.lit("-"), index.cast("string"), F.lit("."), ext)


def path_prefixes(path: Column | str) -> Column:
    """Every folder that must exist for ``path``, shortest first."""
    parts = F.filter(F.split(clean_path(path), "/", -1), lambda p: p != "")

    def prefixes(parts: Column) -> Column:
        counts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(counts, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))

    return bind(parts, prefixes)
