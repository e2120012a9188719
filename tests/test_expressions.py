"""Scalar rules on literal cases."""

import html
import re

import pytest
from pyspark.sql import functions as F

from inkmirror.functions import markdown as md
from inkmirror.functions import names as nm
from inkmirror.functions import rules, times
from inkmirror.functions.text_basics import WS, WS_CHARS, leading_int, trim_all, trim_start, utf16_prefix

NBSP, IDEOGRAPHIC, BOM = " ", "　", "﻿"


def test_white_space_class_matches_its_characters(evaluate):
    assert evaluate(F.col("s").rlike(f"^{WS}\\z"), "s STRING", list(WS_CHARS)) == [True] * len(WS_CHARS)
    assert len(WS_CHARS) == 25


def test_trim(evaluate):
    rows = [f"\n {NBSP}a b{IDEOGRAPHIC}{BOM}\n", "", "   ", "x"]
    assert evaluate(trim_all("s"), "s STRING", rows) == ["a b", "", "", "x"]
    assert evaluate(trim_start("s"), "s STRING", ["\n a \n"]) == ["a \n"]


def test_leading_int_of_what_a_cast_reads_otherwise(evaluate):
    rows = ["12.7", ".5", "-.5", "7 8", "12 ", "1e3", "9" * 20, "\u0663", "\u00051", "12\u0000", "0x1F", "99L"]
    assert evaluate(leading_int("s"), "s STRING", rows) == [12, None, None, 7, 12, 1, None, None, None, 12, 0, 99]


def test_leading_int(evaluate):
    assert evaluate(leading_int("s"), "s STRING", ["12abc", " -5", "x1", "", None, "+7"]) == [12, -5, None, None, None, 7]


def test_utf16_prefix(evaluate):
    smile = "\U0001f600"
    rows = ["abcdef", smile * 3, "a" + smile * 3, "", None]
    assert evaluate(utf16_prefix("s", 4), "s STRING", rows) == ["abcd", smile * 2, "a" + smile, "", None]


def test_safe_file_name(evaluate):
    cases = {
        "Hello World": "Hello World",
        'a/b:c*d?e"f<g>h|i': "a_b_c_d_e_f_g_h_i",
        "  spaces  ": "spaces",
        ".hidden.": "hidden",
        "": "untitled",
        "   ...test...   ": "test",
        "a\\b": "a_b",
        f"a{NBSP}\t{IDEOGRAPHIC}b\n\nc": "a b c",
        "...": "untitled",
        "." + "x" * 119 + " y": "x" * 119,
        "x" * 200: "x" * 120,
        None: "untitled",
    }
    assert evaluate(nm.safe_file_name("s"), "s STRING", list(cases)) == list(cases.values())


def test_ids_and_titles(evaluate):
    assert evaluate(nm.id_prefix("s"), "s STRING", ["abcdefgh12345678", "short", "", None]) == ["abcdefgh", "short", "", ""]
    assert evaluate(nm.fallback_title("s"), "s STRING", ["abc12345xyz"]) == ["untitled-abc12345"]
    rows = [("", "abc12345xyz"), (None, "abc12345xyz"), (" ", "abc"), ("T", "abc")]
    assert evaluate(nm.document_title("t", "d"), "t STRING, d STRING", rows) == ["untitled-abc12345"] * 2 + [" ", "T"]


def test_times(evaluate):
    rows = ["1700000000", "1700000000000", None, "", "0", "-3", "x", "1000000000000", "1000000000001", "12abc"]
    want = [1700000000, 1700000000, 0, 0, 0, 0, 0, 1000000000000, 1000000000, 12]
    assert evaluate(times.to_seconds("s"), "s STRING", rows) == want
    assert evaluate(times.seconds_to_iso("s"), "s BIGINT", [0, 1728000000, None]) == ["", "2024-10-04T00:00:00", ""]
    assert evaluate(times.timestamp_to_iso("s"), "s STRING", ["1728000000000", None]) == ["2024-10-04T00:00:00", ""]
    assert evaluate(times.millis_to_date("s"), "s BIGINT", [1728000000000, 789004800000000]) == ["2024-10-04", "26972-07-26"]
    assert evaluate(times.retry_delay_ms("a"), "a INT", [1, 2, 3, 4, 5]) == [1000, 2000, 4000, 8000, 8000]


def test_schedule_interval(evaluate):
    """The column form agrees with the form for one setting."""
    rows = [(v, u) for v in (0.0, 0.5, 1.9, 4.9, 5.0, 7.5, 30.0) for u in times.UNIT_MS]
    ms, clamped = times.schedule_interval("v", "u")
    want = [times.clamp_schedule(v, u) for v, u in rows]
    assert evaluate(ms, "v DOUBLE, u STRING", rows) == [times.schedule_ms(c, u) for (c, _), (_, u) in zip(want, rows)]
    assert evaluate(clamped, "v DOUBLE, u STRING", rows) == [raised for _, raised in want]


def test_schedule():
    assert times.schedule_ms(1, "minutes") == 60_000
    assert times.schedule_ms(1.9, "hours") == 3_600_000
    assert times.schedule_ms(0, "days") == 86_400_000
    assert times.clamp_schedule(30, "minutes") == (30, False)
    assert times.clamp_schedule(3, "minutes") == (5, True)
    assert times.clamp_schedule(3, "hours") == (3, False)


def test_paths(evaluate):
    assert evaluate(nm.clean_path("s"), "s STRING", ["a//b/", "/a", "a/b", "//"]) == ["a/b", "a", "a/b", ""]
    assert evaluate(nm.path_prefixes("s"), "s STRING", ["a/b/c", "", "/x/"]) == [["a", "a/b", "a/b/c"], [], ["x"]]


def test_attachment_dir(evaluate):
    rows = [(True, "media"), (False, " media/pics "), (False, "  "), (False, None)]
    schema = "per_kb BOOLEAN, folder STRING"
    folder, fell_back = nm.attachment_dir(F.lit("root"), F.lit("kb"), F.col("per_kb"), "folder")
    assert evaluate(folder, schema, rows) == ["root/kb/attachments", "media/pics"] + ["root/kb/attachments"] * 2
    assert evaluate(fell_back, schema, rows) == [False, False, True, True]


def test_file_ext(evaluate):
    rows = [
        ("application/pdf", "http://x/a.doc"), ("Application/PDF; q=1", "x"), ("application/octet-stream", "http://x/a.PDF?b=c.zip"),
        ("", "http://x/a.verylong"), (None, "not a url.pdf"), ("text/unknown", "http://x/y.tar.gz"), ("application/octet-stream", ""),
    ]
    want = ["pdf", "pdf", "pdf", "bin", "bin", "gz", "bin"]
    assert evaluate(nm.file_ext("c", "u"), "c STRING, u STRING", rows) == want


def test_image_ext(evaluate):
    rows = [
        ("image/jpeg", "x"), ("IMAGE/PNG ; a=b", "x"), ("", "http://a.bc/x.JPG?y"), ("", "http://host.com/x"),
        ("", "http://a/x.webp#f"), ("text/html", "http://a/b.toolong"), (None, "http://a/x.gif"),
    ]
    want = ["jpg", "png", "jpg", "png", "webp", "png", "gif"]
    assert evaluate(nm.image_ext("c", "u"), "c STRING, u STRING", rows) == want


def test_image_file_name(evaluate):
    name = nm.image_file_name("d", F.col("n"), F.col("e"))
    rows = [("article_abc_123", 1, "png"), ("plain", 2, "jpg"), ("article_abc_124", 1, "png"), ("ends_", 1, "png")]
    want = ["123-1.png", "plain-2.jpg", "124-1.png", "-1.png"]
    assert evaluate(name, "d STRING, n INT, e STRING", rows) == want


def test_item_classes(evaluate):
    rows = [(99, "x"), (11, "folder_1"), (6, "doc"), (None, "doc"), (None, "folder_")]
    assert evaluate(rules.is_folder("m", "i"), "m INT, i STRING", rows) == [True, True, False, False, True]
    rows = [(11, None), (6, "nb"), (6, ""), (6, " "), (None, None), (99, None)]
    assert evaluate(rules.is_note("m", "n"), "m INT, n STRING", rows) == [True, True, False, True, False, False]
    rows = [(11, None, None), (6, None, "u"), (6, "n", "u"), (6, None, ""), (6, None, None)]
    assert evaluate(rules.content_route("m", "n", "u"), "m INT, n STRING, u STRING", rows) == ["note", "url", "note", "none", "none"]
    rows = [("Text/HTML; x", "a"), ("text/html", ""), ("text/html", None), (None, "a"), ("application/pdf", "a")]
    assert evaluate(rules.url_kind("c", "t"), "c STRING, t STRING", rows) == ["article", "file", "file", "file", "file"]


def test_request_outcome(evaluate):
    schema = "s INT, p STRING"
    rows = [
        (429, None), (503, '{"code":0}'), (403, '{"code":200005,"msg":"x"}'), (403, '{"code":1,"msg":"请求超量，请明日再试"}'),
        (403, None), (404, "not json"), (200, '{"code":0,"msg":"ok"}'), (200, '{"code":200005,"msg":"late"}'), (200, None),
        (200, "broken{"), (None, '{"code":0}'), (200, '{"msg":"no code"}'), (600, '{"code":0}'),
    ]
    want = [
        "retryable", "retryable", "quota", "quota", "fatal", "fatal", "success", "fatal", "retryable",
        "retryable", "success", "fatal", "fatal",
    ]
    assert evaluate(rules.request_outcome("s", "p"), schema, rows) == want
    assert evaluate(rules.retryable_status("s"), "s INT", [429, 500, 503, 599, 400, 403, 600]) == [True] * 4 + [False] * 3
    assert evaluate(rules.download_outcome("s"), "s INT", [200, None, 404, 429, 500]) == ["success", "success", "fatal", "retryable", "retryable"]


def test_quota_answer(evaluate):
    rows = [(200005, "请求超量"), (0, "请求超量，请明日再试"), (None, None), (0, "ok"), (200005, None)]
    assert evaluate(rules.over_quota("c", "m"), "c BIGINT, m STRING", rows) == [True, True, False, False, True]


def test_looks_like_html(evaluate):
    rows = [
        "<!DOCTYPE html>", " \n<html>", "text <p>", "x<pé", "<pre>", "<picture>", "a < b", "", None, "<DIV class=x>", "x <body>",
        "a" * 1997 + "<div>", "a" * 1990 + "<div>", IDEOGRAPHIC + "<body>", "<h1>", "<h7>", "<h10>",
    ]
    want = [True, True, True, True, True, False, False, False, None, True, False, False, True, True, True, False, False]
    got = evaluate(rules.looks_like_html("s"), "s STRING", rows)
    assert got == want


@pytest.mark.parametrize("known,known_t,t,want", [(False, 0, 1000, "create"), (True, 500, 0, "skip"), (True, 500, 1000, "update"), (True, 1000, 500, "skip"), (True, 1000, 1000, "skip"), (False, 0, 0, "create")])
def test_change_action(evaluate, known, known_t, t, want):
    action = rules.change_action(F.col("k"), F.col("kt"), F.col("t"))
    assert evaluate(action, "k BOOLEAN, kt BIGINT, t BIGINT", [(known, known_t, t)]) == [want]


def sequential_decode(text):
    """The three replacement passes written as loops."""

    def char(number):
        if number > 0x10FFFF:
            raise ValueError
        return "�" if number == 0 or 0xD800 <= number <= 0xDFFF else chr(number)

    last = {"&nbsp;": " ", "&#x20;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
    try:
        text = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: char(int(m[1], 16)), text)
        text = re.sub(r"&#([0-9]+);", lambda m: char(int(m[1])), text)
    except ValueError:
        return None
    return re.sub(r"&[a-zA-Z]+;|&#x[0-9a-fA-F]+;|&#[0-9]+;", lambda m: last.get(m[0], m[0]), text)


def test_decode_entities(evaluate):
    rows = [
        "a &amp; b", "&amp;lt;", "&#38;lt;", "&copy;&middot;", "&#x20;x&#160;y", "&#128512;&#x1F600;", "&#0;&#x0;", "&#x110000;",
        "&#1114112;", "&#99999999999999999999;", "&#x26;#38;", "&#38;#39;", "&amp;#39;", "&AMP;", "&#X41;", "&lt;&gt;&quot;&apos;&nbsp;",
        "&#xD800;", "&#000000000065;", "plain", "&", "&#;", "&#x;", "$1 \\ &amp; $0", "&#38;#x20;", "", html.escape("<a href='x'>&</a>"),
    ]
    assert evaluate(md.decode_entities("s"), "s STRING", rows) == [sequential_decode(r) for r in rows]


def test_style_tags_and_cleaning(evaluate):
    rows = ["a<br>b<BR />\nc<br/>", '<span style="x">t</span><font>u</font>', "<sub>k</sub><s>x</s><strong>y</strong>", "<u\n>z</u>"]
    want = ["a\nb\nc\n", "tu", "<sub>k</sub>x<strong>y</strong>", "z"]
    assert evaluate(md.strip_style_tags("s"), "s STRING", rows) == want
    rows = ["\n\na\n\n\n\nb &amp; <span>c</span>  ", "", "x\n\ny", "&#x110000;"]
    assert evaluate(md.clean_markdown("s"), "s STRING", rows) == ["a\n\nb & c", "", "x\n\ny", None]
    assert evaluate(md.paragraphs("s"), "s STRING", [" a \n\n\n b\nc \n\n  \n\nd", ""]) == ["a\n\nb\nc\n\nd", ""]


def test_bodies(evaluate):
    cols = [F.col("a"), F.col("b"), F.col("c")]
    schema = "a STRING, b STRING, c STRING"
    assert evaluate(md.article_body(*cols), schema, [("T", "u", " m ")]) == ["# T\n\n[原文链接](u)\n\nm"]
    rows = [("T", "u", " s "), ("T", "u", ""), ("T", "u", None), ("T", "u", " \n")]
    shown = ["s"] + ["正文抓取失败，仅保留链接。"] * 3
    assert evaluate(md.degraded_body(*cols), schema, rows) == [f"# T\n\n[原文链接](u)\n\n> {s}" for s in shown]
    stub = md.file_stub_body(F.col("a"), F.col("b"), F.col("c"))
    assert evaluate(stub, schema, [("T", "pdf", "f.pdf")]) == ["# T\n\n> 文件类型：PDF\n\n[f.pdf](f.pdf)\n"]
    rows = [("personal", "creator", "5"), ("shared", "", "0"), ("", None, ""), (None, "x", None)]
    assert evaluate(md.catalog_meta(*cols), schema, rows) == ["personal · creator · 5 篇", "shared · 0 篇", "", "x"]


def test_property_block(evaluate):
    schema = "t STRING, c STRING, s STRING, tags ARRAY<STRING>"
    block = md.property_block(F.col("t"), F.col("c"), F.col("s"), F.col("tags"))
    rows = [("测试", "2026-01-01", None, ["clippings"]), ('带"引号"\\', "", "https://e.com", []), ("x", None, "", None)]
    assert evaluate(block, schema, rows) == [
        'title: "测试"\ncreated: 2026-01-01\ntags:\n  - clippings',
        'title: "带\\"引号\\"\\\\"\nsource: "https://e.com"\ntags:\n  - clippings',
        'title: "x"\ntags:\n  - clippings',
    ]
    new = md.new_document(F.lit("title: x"), F.col("b"))
    assert evaluate(new, "b STRING", ["\n\n body \n"]) == ["---\ntitle: x\n---\n\nbody \n\n"]


def sequential_splice(content, body, block):
    lines = re.split(r"\r?\n", content)
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), -1) if lines[0].strip() == "---" else -1
    if end >= 0:
        return "\n".join(lines[: end + 1]) + "\n\n" + body.lstrip() + "\n"
    return f"---\n{block}\n---\n\n{body}\n"


def test_splice_body(evaluate):
    rows = [
        "---\na: 1\n---\n\nold", "---\r\na: 1\r\nb: 2\r\n--- \r\nold\r\n", "---\n---", " --- \nx\n\t---\t\ny", "---\nno end", "text",
        "", "---", "a\n---\nb\n---", "---\na: ---\n----\n---\nz\n---\n", "---\n\n\n---\n---\n",
    ]
    got = evaluate(md.splice_body("s", F.lit("\n new"), F.lit("t: 1")), "s STRING", rows)
    assert got == [sequential_splice(r, "\n new", "t: 1") for r in rows]
    has = evaluate(md.has_block("s"), "s STRING", rows)
    assert has == [not w.startswith("---\nt: 1\n") for w in got]


def test_merge_properties(evaluate):
    merge = md.merge_properties(F.col("s"), F.lit("T"), F.lit("2024-01-01"), F.col("u"))
    rows = [
        ('---\ntitle: "mine"\nother: 1\n---\nB', "u"),
        ("---\ntitle: \ntags: []\nima_doc_id: 5\nsynced_at: x\n---\n\nB", None),
        ("---\ntitle: ''\nsource: keep\nnested:\n  a: 1\n  b: 2\ntags:\n  - q\nima_kb_id:\n  - 1\n---", "u"),
        ("no block", "u"),
        ("---\n---\nB", ""),
        ("---\r\ntitle: x\r\ncreated: 2020-01-01\r\ntags: null\r\n---\r\nB", None),
        ("---\n# note\ntitle: x\ncreated: y\ntags: [a]\n---\nB", None),
    ]
    tags = "tags:\n  - clippings"
    assert evaluate(merge, "s STRING, u STRING", rows) == [
        f'---\ntitle: "mine"\nother: 1\ncreated: 2024-01-01\nsource: "u"\n{tags}\n---\nB',
        f'---\ntitle: "T"\n{tags}\ncreated: 2024-01-01\n---\n\nB',
        '---\ntitle: "T"\nsource: keep\nnested:\n  a: 1\n  b: 2\ntags:\n  - q\ncreated: 2024-01-01\n---',
        "no block",
        f'---\ntitle: "T"\ncreated: 2024-01-01\n{tags}\n---\nB',
        f"---\ntitle: x\ncreated: 2020-01-01\n{tags}\n---\r\nB",
        "---\n# note\ntitle: x\ncreated: y\ntags: [a]\n---\nB",
    ]


def test_summary_and_errors(evaluate):
    line = md.run_summary(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    assert evaluate(line, "x INT", [0]) == ["同步完成：新增 1 / 更新 2 / 跳过 3 / 失败 4"]
    text = md.error_text(F.col("m"), F.struct(F.lit(5).alias("code")))
    assert evaluate(text, "m STRING", ["boom", None]) == ["boom", '{"code":5}']
