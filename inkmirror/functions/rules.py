"""Predicates and routing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text_basics import TAG_END, WS, as_col, has_text, utf16_prefix

# Codes, markers and tag names.
MEDIA_NOTE = 11
MEDIA_FOLDER = 99
FOLDER_ID_PREFIX = "folder_"
QUOTA_CODE = 200005
QUOTA_MARK = "请求超量"
BLOCK_TAGS_ANYWHERE = "div|p|article|section|table|tbody|thead|tr|td|th|ul|ol|li|h[1-6]|pre|blockquote"
BLOCK_TAGS_AT_START = "!doctype|html|body|div|p|article|section|table|ul|ol|h[1-6]"
HTML_PROBE_UNITS = 2000


def is_folder(media_type: Column | str, media_id: Column | str) -> Column:
    return F.coalesce(as_col(media_type) == MEDIA_FOLDER, F.lit(False)) | as_col(media_id).startswith(FOLDER_ID_PREFIX)


def is_note(media_type: Column | str, notebook_id: Column | str) -> Column:
    return F.coalesce(as_col(media_type) == MEDIA_NOTE, F.lit(False)) | has_text(notebook_id)


def content_route(media_type: Column | str, notebook_id: Column | str, url: Column | str) -> Column:
    """Where the content comes from: ``note``, ``url`` or ``none``."""
    return (
        F.when(is_note(media_type, notebook_id), "note")
        .when(has_text(url), "url")
        .otherwise("none")
    )


def url_kind(content_type: Column | str, text: Column | str) -> Column:
    """``article`` for HTML with text, ``file`` for everything else."""
    html = F.lower(F.coalesce(as_col(content_type), F.lit(""))).contains("text/html")
    return F.when(html & has_text(text), "article").otherwise("file")


def retryable_status(status: Column | str) -> Column:
    status = as_col(status)
    return (status == 429) | status.between(500, 599)


def over_quota(code: Column | str, message: Column | str) -> Column:
    """Quota answer by code or message; the HTTP status plays no part."""
    return F.coalesce(as_col(code) == QUOTA_CODE, F.lit(False)) | F.coalesce(
        as_col(message).contains(QUOTA_MARK), F.lit(False)
    )


def request_outcome(status: Column | str, payload: Column | str) -> Column:
    """Outcome of one API call. The quota test only applies from status 400 on."""
    status = F.coalesce(as_col(status), F.lit(200))
    body = parsed_body(payload)
    return (
        F.when(retryable_status(status), "retryable")
        .when((status >= 400) & over_quota(body["code"], body["msg"]), "quota")
        .when(status >= 400, "fatal")
        .when(body.isNull(), "retryable")
        .when(~F.coalesce(body["code"] == 0, F.lit(False)), "fatal")
        .otherwise("success")
    )


def parsed_body(payload: Column | str) -> Column:
    """Envelope ``code`` and ``msg``; NULL where the payload is not an object."""
    payload = as_col(payload)
    parsed = F.from_json(payload, "code BIGINT, msg STRING, broken STRING", {"columnNameOfCorruptRecord": "broken"})
    return F.when(payload.isNotNull() & parsed["broken"].isNull(), parsed)


def download_outcome(status: Column | str) -> Column:
    status = F.coalesce(as_col(status), F.lit(200))
    return F.when(retryable_status(status), "retryable").when(status >= 400, "fatal").otherwise("success")


def looks_like_html(text: Column | str) -> Column:
    """A block-level tag near the beginning of the text."""
    at_start, anywhere = rf"^{WS}*<({BLOCK_TAGS_AT_START}){TAG_END}", rf"<({BLOCK_TAGS_ANYWHERE}){TAG_END}"
    probe = F.lower(utf16_prefix(as_col(text), HTML_PROBE_UNITS)).rlike(f"{at_start}|{anywhere}")
    return F.when(as_col(text).contains("<"), probe).otherwise(as_col(text).contains("<"))


def change_action(known: Column, known_seconds: Column, remote_seconds: Column) -> Column:
    """create / update / skip for one occurrence of a document."""
    return (
        F.when(~known, "create")
        .when(remote_seconds == 0, "skip")
        .when(remote_seconds > known_seconds, "update")
        .otherwise("skip")
    )
