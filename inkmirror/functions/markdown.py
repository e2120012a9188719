"""Text cleaning, document bodies and the property block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text_basics import TAG_END, WS, WS_IN_LINE, as_col, bind, has_text, present, replace_each_match, trim_all, trim_start

# Entities, tag names, wording and property names.
NAMED_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
NUMERIC_IN_LAST_PASS = {"&#x20;": " ", "&#160;": " ", "&#39;": "'"}
HEX_ENTITY = r"&#x([0-9a-fA-F]+);"
DECIMAL_ENTITY = r"&#(\d+);"
MAX_CODE_POINT = 0x10FFFF
REPLACEMENT_CODE_POINT = 0xFFFD
STYLE_TAGS = "span|font|mark|s|u|strike"
DEFAULT_TAG = "clippings"
LEGACY_PROPERTIES = ("ima_doc_id", "ima_kb_id", "ima_kb_name", "ima_update_time", "synced_at")
BLANK_VALUES = ("", '""', "''", "null", "~", "false", "0")
BLANK_TAGS = ("", "null", "~", "[]")
LINK_TEXT = "原文链接"
FILE_TYPE_TEXT = "文件类型："
NO_BODY_TEXT = "正文抓取失败，仅保留链接。"
ITEMS_UNIT = "篇"
META_SEPARATOR = " · "


def _code_point_text(number: Column) -> Column:
    """Character for a code point; 0 becomes U+FFFD, beyond the range NULL."""

    def text_of(number: Column) -> Column:
        # lone surrogates have no UTF-8 form, so they show as the replacement character
        shown = F.when((number == 0) | number.between(0xD800, 0xDFFF), REPLACEMENT_CODE_POINT).otherwise(number)
        text = F.decode(F.unhex(F.lpad(F.hex(shown), 8, "0")), "UTF-32")
        return F.when(number <= MAX_CODE_POINT, text)

    return bind(number, text_of)


def _entity_text(pattern: str, base: int):
    def text_of(match: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(match, pattern, 1), r"^0+(?=.)", "")
        # more digits than any code point has: out of range whatever the value
        short = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).try_cast("bigint"))
        return _code_point_text(F.coalesce(short, F.lit(MAX_CODE_POINT + 1).cast("bigint")))

    return text_of


def _numeric_entities(text: Column, mark: str, pattern: str, base: int) -> Column:
    def decoded(source: Column) -> Column:
        changed = replace_each_match(source, pattern, _entity_text(pattern, base), may_fail=True)
        return F.when(source.contains(mark), changed).otherwise(source)

    return bind(text, decoded)


def decode_entities(text: Column | str) -> Column:
    """Hexadecimal, then decimal, then one pass over the six named entities.

    A code point out of range gives NULL, which callers report as a failed row.
    """
    text = as_col(text)
    named = _numeric_entities(text, "&#x", HEX_ENTITY, 16)
    named = _numeric_entities(named, "&#", DECIMAL_ENTITY, 10)
    # numeric forms that the first two passes uncovered, still part of the last pass
    for entity, char in NUMERIC_IN_LAST_PASS.items():
        named = F.replace(named, F.lit(entity), F.lit(char))
    # `&amp;` goes last, so the text it uncovers is not decoded a second time
    for name in ("nbsp", "lt", "gt", "quot", "apos", "amp"):
        named = F.replace(named, F.lit(f"&{name};"), F.lit(NAMED_ENTITIES[name]))
    return F.when(text.contains("&"), named).otherwise(text)


def strip_style_tags(text: Column | str) -> Column:
    """Line breaks become line feeds; style wrappers go, their text stays."""
    text = as_col(text)
    broken = F.regexp_replace(text, rf"(?i)<br{WS}*/?>\n?", "\n")
    bare = F.regexp_replace(broken, rf"(?i)</?({STYLE_TAGS}){TAG_END}[^>]*>", "")
    return F.when(text.contains("<"), bare).otherwise(text)


def clean_markdown(text: Column | str) -> Column:
    """Style tags, entities, runs of empty lines and outer white space.

    Each step looks for its characters first, so a plain text is only scanned.
    """

    def tidied(decoded: Column) -> Column:
        squeezed = F.regexp_replace(decoded, r"\n{3,}", "\n\n")
        return trim_all(F.when(decoded.contains("\n\n\n"), squeezed).otherwise(decoded))

    return bind(bind(strip_style_tags(text), decode_entities), tidied)


def paragraphs(text: Column | str) -> Column:
    """Plain text as paragraphs separated by one empty line."""
    parts = F.transform(F.split(as_col(text), r"\n{2,}", -1), trim_all)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def article_body(title: Column, url: Column, markdown: Column) -> Column:
    return F.concat(_titled_link(title, url), trim_all(markdown))


def degraded_body(title: Column, url: Column, summary: Column) -> Column:
    """Title, link and the summary, or the fixed line where there is none."""
    shown = F.coalesce(present(trim_all(F.coalesce(summary, F.lit("")))), F.lit(NO_BODY_TEXT))
    return F.concat(_titled_link(title, url), F.lit("> "), shown)


def _titled_link(title: Column, url: Column) -> Column:
    empty = F.lit("")
    return F.concat(
        F.lit("# "), F.coalesce(title, empty), F.lit(f"\n\n[{LINK_TEXT}]("), F.coalesce(url, empty), F.lit(")\n\n")
    )


def file_stub_body(title: Column, ext: Column, file_name: Column) -> Column:
    return F.concat(
        F.lit("# "), F.coalesce(title, F.lit("")), F.lit(f"\n\n> {FILE_TYPE_TEXT}"), F.upper(ext),
        F.lit("\n\n["), file_name, F.lit("]("), file_name, F.lit(")\n"),
    )


def catalog_meta(base_type: Column, role_type: Column, content_count: Column) -> Column:
    count = F.when(has_text(content_count), F.concat(content_count, F.lit(f" {ITEMS_UNIT}")))
    return F.concat_ws(META_SEPARATOR, present(base_type), present(role_type), count)


def run_summary(created: Column, updated: Column, skipped: Column, failed: Column) -> Column:
    return F.format_string("同步完成：新增 %d / 更新 %d / 跳过 %d / 失败 %d", created, updated, skipped, failed)


def error_text(message: Column, error: Column) -> Column:
    """The message where there is one, else the error as JSON."""
    return F.coalesce(message, F.to_json(error))


# ---- property block -------------------------------------------------------


def yaml_string(text: Column | str) -> Column:
    escaped = F.replace(as_col(text), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(escaped, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _tag_lines(tags: Column) -> Column:
    filled = F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, tags).otherwise(F.array(F.lit(DEFAULT_TAG)))
    return F.concat(F.lit("tags:"), F.array_join(F.transform(filled, lambda t: F.concat(F.lit("\n  - "), t)), ""))


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def property_block(title: Column, created: Column, source: Column, tags: Column | None = None) -> Column:
    """YAML lines of a new document, without the ``---`` fences."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("title: "), yaml_string(title)),
        F.when(has_text(created), F.concat(F.lit("created: "), created)),
        F.when(has_text(source), F.concat(F.lit("source: "), yaml_string(source))),
        _tag_lines(_no_tags() if tags is None else tags),
    )


def new_document(block: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), block, F.lit("\n---\n\n"), trim_start(body), F.lit("\n"))


_FENCE = rf"{WS_IN_LINE}*---{WS_IN_LINE}*"
# first line is a fence, then the shortest run of lines up to the next fence line
FENCED_BLOCK = rf"(?s)^({_FENCE}?\r?\n(?:.*?\n)??{_FENCE}?)(?:\r?\n|\z)"


def kept_block(content: Column | str) -> Column:
    """The block through its closing fence, line ends as LF; '' without a block."""
    return F.replace(F.regexp_extract(as_col(content), FENCED_BLOCK, 1), F.lit("\r\n"), F.lit("\n"))


def has_block(content: Column | str) -> Column:
    return as_col(content).rlike(FENCED_BLOCK)


def splice_body(content: Column | str, body: Column, fresh_block: Column) -> Column:
    """New body under the kept block, or under a fresh block where there is none
    (in that case the body is not trimmed)."""
    fresh = F.concat(F.lit("---\n"), fresh_block, F.lit("\n---\n\n"), body, F.lit("\n"))

    def spliced(kept: Column) -> Column:
        return F.when(kept != "", F.concat(kept, F.lit("\n\n"), trim_start(body), F.lit("\n"))).otherwise(fresh)

    return bind(kept_block(content), spliced)


def _entry_key(entry: Column) -> Column:
    return F.regexp_extract(entry, r"""^["']?([^:"'\n]+?)["']?\s*:""", 1)


def _entry_value(entry: Column) -> Column:
    return trim_all(F.regexp_replace(entry, r"^[^:\n]*:", ""))


def merge_properties(content: Column, title: Column, created: Column, source: Column, tags: Column | None = None) -> Column:
    """Fill missing properties in the block of ``content`` and drop legacy keys.

    Works on the top-level entries of the block as text, so nested values and the
    author's own properties stay as written. Contents without a block stay as is.
    """
    wanted = {
        "title": F.concat(F.lit("title: "), yaml_string(title)),
        "created": F.when(has_text(created), F.concat(F.lit("created: "), created)),
        "source": F.when(has_text(source), F.concat(F.lit("source: "), yaml_string(source))),
        "tags": _tag_lines(_no_tags() if tags is None else tags),
    }

    def filled(entry: Column) -> Column:
        chosen = entry
        for key, line in wanted.items():
            value = _entry_value(entry)
            blank = value.isin(*BLANK_TAGS) if key == "tags" else value.isin(*BLANK_VALUES)
            chosen = F.when((_entry_key(entry) == key) & blank & line.isNotNull(), line).otherwise(chosen)
        return chosen

    def lines(entries: Column) -> Column:
        keys = F.transform(entries, _entry_key)
        absent = F.array(*[F.when(~F.array_contains(keys, key), line) for key, line in wanted.items()])
        return F.array_join(F.concat(F.transform(entries, filled), F.filter(absent, lambda line: line.isNotNull())), "\n")

    def merged(block: Column) -> Column:
        inner = F.regexp_extract(block, rf"(?s)^{_FENCE}\r?\n(.*?)\r?\n?{_FENCE}\z", 1)
        # a top-level entry starts at a line that is neither indented, a list item nor a comment
        entries = F.split(F.replace(inner, F.lit("\r\n"), F.lit("\n")), r"\n(?=[^\s#-][^\n]*?:)", -1)
        kept = F.filter(entries, lambda e: (trim_all(e) != "") & ~_entry_key(e).isin(*LEGACY_PROPERTIES))
        rest = F.substring(content, F.length(block) + 1, F.length(content))
        return F.when(block == "", content).otherwise(
            F.concat(F.lit("---\n"), bind(kept, lines), F.lit("\n---"), rest)
        )

    return bind(F.regexp_extract(content, FENCED_BLOCK, 1), merged)
