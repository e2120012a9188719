"""The same questions in ANSI SQL for an independent database.

Each text states its rule anew (windows, recursion, regular expressions), sharing
only the derived input relations with the Spark side. Queries whose result SQL
cannot state (HTML to Markdown) have no entry and are tested by their properties.
"""

from __future__ import annotations

from .fixtures import check_cte

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS_PAREN = WS.replace("[", "[^)", 1)
# Fixed values, stated here again so that a slip in the tested tables shows.
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
RUN_DATE = "2024-06-01"
SYNCED_AT = "2024-06-01T00:00:00Z"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def number(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, '^{WS}*([+-]?\\d+)', 1) AS BIGINT)"


def seconds(x: str) -> str:
    n = number(x)
    return f"CASE WHEN {n} IS NULL OR {n} <= 0 THEN 0 WHEN {n} > 1000000000000 THEN {n} // 1000 ELSE {n} END"


def safe_name(x: str) -> str:
    marked = f"""regexp_replace(coalesce({x}, ''), '[/\\\\:*?"<>|]', '_', 'g')"""
    squeezed = trim(f"regexp_replace({marked}, '{WS}+', ' ', 'g')")
    dotless = f"regexp_replace({squeezed}, '^\\.+|\\.+$', '', 'g')"
    return f"coalesce(nullif({trim(f'substring({dotless}, 1, 120)')}, ''), 'untitled')"


def decode(x: str) -> str:
    for entity, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        x = f"replace({x}, '&{entity};', '{char}')"
    return x


def strip_style(x: str) -> str:
    broken = f"regexp_replace({x}, '(?i)<br{WS}*/?>\\n?', chr(10), 'g')"
    return f"regexp_replace({broken}, '(?i)</?(span|font|mark|s|u|strike)\\b[^>]*>', '', 'g')"


def clean(x: str) -> str:
    return trim(f"regexp_replace({decode(strip_style(x))}, '\\n{{3,}}', chr(10)||chr(10), 'g')")


def yaml_string(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


def url_ext(url: str, longest: int) -> str:
    path = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"lower(regexp_extract({path}, '\\.([a-zA-Z0-9]{{2,{longest}}})$', 1))"


def type_ext(content_type: str, table: dict[str, str]) -> str:
    bare = f"lower({trim(f'''split_part(coalesce({content_type}, ''), ';', 1)''')})"
    cases = " ".join(f"WHEN '{t}' THEN '{e}'" for t, e in table.items())
    return f"CASE {bare} {cases} ELSE '' END"


def file_ext(content_type: str, url: str) -> str:
    return f"coalesce(nullif({type_ext(content_type, FILE_CONTENT_TYPE_EXT)}, ''), nullif({url_ext(url, 5)}, ''), 'bin')"


def image_ext(content_type: str, url: str) -> str:
    from_url = f"lower(regexp_extract({url}, '\\.([a-zA-Z0-9]{{2,4}})($|\\?|#)', 1))"
    return f"coalesce(nullif({type_ext(content_type, IMAGE_CONTENT_TYPE_EXT)}, ''), nullif({from_url}, ''), 'png')"


def route(media_type: str, notebook: str, url: str) -> str:
    return (
        f"CASE WHEN coalesce({media_type} = 11, false) OR coalesce({notebook}, '') <> '' THEN 'note' "
        f"WHEN coalesce({url}, '') <> '' THEN 'url' ELSE 'none' END"
    )


def action(known: str, known_t: str, t: str) -> str:
    return (
        f"CASE WHEN NOT ({known}) THEN 'create' WHEN {t} = 0 THEN 'skip' "
        f"WHEN {t} > {known_t} THEN 'update' ELSE 'skip' END"
    )


def with_(names: str, *parts: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join([check_cte(*names.split()), *parts]) + " "


DECIDED = f"""decided AS (
    SELECT j.*, {action("known", "known_t", "t")} AS action,
           CASE WHEN NOT has_media THEN 'failed' WHEN {action("known", "known_t", "t")} = 'skip' THEN 'skipped'
                WHEN route = 'none' THEN 'failed' WHEN known THEN 'updated' ELSE 'created' END AS result
    FROM (SELECT i.*, m.media_id IS NOT NULL AS has_media, {seconds("m.update_time")} AS t,
                 {route("m.media_type", "m.notebook_id", "m.url")} AS route, x.doc_id IS NOT NULL AS known,
                 coalesce({number("x.update_time")}, 0) AS known_t, x.path AS index_path, x.update_time AS index_time
          FROM fx_items i LEFT JOIN fx_media m USING (media_id) LEFT JOIN fx_index x ON x.doc_id = i.media_id) j)"""
DECIDED_FROM = "fx_items fx_media fx_index"


def folded(index: bool, feed: str = "fx_items_dup") -> str:
    """The repeated feed decided in order, with the index or with an empty one."""
    join = "LEFT JOIN fx_index x USING (doc_id)" if index else ""
    known = "x.doc_id IS NOT NULL" if index else "false"
    known_t = f"coalesce({number('x.update_time')}, 0)" if index else "0"
    return f"""folded AS (
        SELECT doc_id, seq, t, ok, {action("known OR prior_ok", "greatest(known_t, coalesce(prior_t, 0), 0)", "t")} AS action
        FROM (SELECT f.doc_id, seq, t, ok, {known} AS known, {known_t} AS known_t,
                     coalesce(bool_or(ok) OVER before, false) AS prior_ok,
                     max(CASE WHEN ok THEN t END) OVER before AS prior_t
              FROM {feed} f {join}
              WINDOW before AS (PARTITION BY f.doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) p)"""


OUTCOME = """outcomes AS (
    SELECT *, CASE WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'retryable'
                   WHEN status >= 400 AND quota_body THEN 'quota' WHEN status >= 400 THEN 'fatal'
                   WHEN payload IS NULL THEN 'retryable' WHEN coalesce(code, -1) <> 0 THEN 'fatal'
                   ELSE 'success' END AS outcome
    FROM (SELECT *, CAST(json_extract_string(payload, '$.code') AS BIGINT) AS code,
                 json_extract_string(payload, '$.msg') AS msg,
                 coalesce(CAST(json_extract_string(payload, '$.code') AS BIGINT) = 200005, false)
                 OR coalesce(contains(json_extract_string(payload, '$.msg'), '请求超量'), false) AS quota_body
          FROM fx_requests) q)"""
RESOLVED = """resolved AS (
    SELECT request_id,
           coalesce(arg_min(outcome, attempt) FILTER (outcome <> 'retryable'), 'failed') AS resolution,
           coalesce(min(attempt) FILTER (outcome <> 'retryable'), max(attempt)) AS attempts_made
    FROM outcomes WHERE attempt <= 4 GROUP BY request_id)"""

PLACED = f"""folders AS (
    SELECT kb_id, media_id AS folder_id, parent_folder_id AS parent_id, {safe_name("title")} AS name, pos
    FROM fx_tree WHERE media_type = 99 OR starts_with(media_id, 'folder_')),
  levels(kb_id, folder_id, path, k) AS (
    SELECT kb_id, '', 'vault/' || kb_name, [{{'pos': CAST(kb_pos AS BIGINT), 'id': kb_id}}] FROM fx_kb WHERE in_scope
    UNION ALL
    SELECT f.kb_id, f.folder_id, l.path || '/' || f.name, list_append(l.k, {{'pos': f.pos, 'id': f.folder_id}})
    FROM folders f JOIN levels l ON f.kb_id = l.kb_id AND f.parent_id = l.folder_id),
  placed AS (
    SELECT i.kb_id, i.media_id, i.title, l.path AS parent_path, len(l.k) AS depth,
           list_append(l.k, {{'pos': i.pos, 'id': i.media_id}}) AS k
    FROM fx_tree i JOIN levels l ON i.kb_id = l.kb_id AND i.parent_folder_id = l.folder_id
    WHERE NOT (i.media_type = 99 OR starts_with(i.media_id, 'folder_')))"""


def placed(scope: str) -> str:
    return PLACED.replace("in_scope", scope)


def claims(source: str) -> str:
    """Names of ``source`` (seq, doc_id, parent, base) in an empty folder tree."""
    return f"""claimed AS (
        SELECT seq, doc_id, parent, CASE WHEN rn = 1 THEN base WHEN rk = 1 THEN base || '-' || substring(doc_id, 1, 8)
                                 ELSE base || '-' || doc_id END AS name
        FROM (SELECT *, row_number() OVER (PARTITION BY parent, base, substring(doc_id, 1, 8), rn > 1 ORDER BY seq) AS rk
              FROM (SELECT *, row_number() OVER (PARTITION BY parent, base ORDER BY seq) AS rn FROM {source}) a) b)"""


INDEX_ROW = "doc_id, path, kb_id, title, media_type, update_time, synced_at"
RUN = f"""feed AS (
    SELECT row_number() OVER (ORDER BY standalone, k) - 1 AS seq, *
    FROM (SELECT false AS standalone, k, kb_id, media_id AS doc_id, title, parent_path AS parent, NULL AS note_t FROM placed
          UNION ALL
          SELECT true, [{{'pos': CAST(docid AS BIGINT), 'id': 'note_' || docid}}], '', 'note_' || docid, title,
                 'vault/Notes', {seconds("modify_time")} FROM fx_notes) u),
  contents AS (
    SELECT doc_id, content FROM fx_contents UNION ALL SELECT 'note_' || docid, content FROM fx_notes),
  answered AS (
    SELECT f.seq, f.kb_id, f.doc_id, f.title, f.parent, standalone OR m.media_id IS NOT NULL AS has_media,
           coalesce(note_t, {seconds("m.update_time")}) AS t,
           CASE WHEN standalone THEN 'note' ELSE {route("m.media_type", "m.notebook_id", "m.url")} END AS route,
           coalesce(m.notebook_id, f.doc_id) AS content_key, m.url, x.doc_id IS NOT NULL AS known,
           coalesce({number("x.update_time")}, 0) AS known_t, x.path AS index_path, x.update_time AS index_time
    FROM feed f LEFT JOIN fx_media m ON NOT standalone AND m.media_id = f.doc_id
    LEFT JOIN fx_index x ON x.doc_id = f.doc_id),
  judged AS (
    SELECT a.*, {action("known", "known_t", "t")} AS action, d.status, c.doc_id IS NOT NULL AS has_content,
           CASE WHEN route = 'note' THEN c.doc_id IS NOT NULL
                WHEN route = 'url' THEN coalesce(d.status < 400, false) ELSE false END AS ready
    FROM answered a LEFT JOIN contents c ON route = 'note' AND c.doc_id = a.content_key
    LEFT JOIN fx_downloads d ON route = 'url' AND d.url = a.url),
  results AS (
    SELECT *, CASE WHEN NOT has_media THEN 'failed' WHEN action = 'skip' THEN 'skipped' WHEN NOT ready THEN 'failed'
                   WHEN action = 'create' THEN 'created' ELSE 'updated' END AS result,
           action = 'update' AND index_time <> '' AS in_place
    FROM judged),
  wanted AS (
    SELECT seq, doc_id, parent, {safe_name("title")} AS base FROM results
    WHERE result IN ('created', 'updated') AND NOT in_place),
  {claims("wanted")},
  done AS (
    SELECT r.*, CASE WHEN r.result IN ('created', 'updated') THEN
                CASE WHEN in_place THEN index_path ELSE c.parent || '/' || c.name || '.md' END END AS path,
           CASE WHEN NOT has_media THEN 'no answer landed'
                WHEN ready THEN NULL
                WHEN route = 'none' THEN '无 notebook_id 也无 url_info，无法获取内容'
                WHEN status IS NOT NULL THEN '下载失败 (' || status || ')'
                ELSE 'no answer landed' END AS error
    FROM results r LEFT JOIN claimed c USING (seq))"""


def stopped_run(stops: str) -> str:
    """A run whose walk through a base ends at the first of ``stops`` (kb_id, k, quota, title, error)."""
    first = f"""stops AS ({stops}),
      firsts AS (SELECT * FROM stops QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY k) = 1),
      halt AS (SELECT k AS halt_k FROM firsts WHERE quota ORDER BY k LIMIT 1),
      visited AS (
        SELECT p.* FROM placed p LEFT JOIN firsts f USING (kb_id) LEFT JOIN halt ON true
        WHERE (f.k IS NULL OR p.k < f.k) AND (halt_k IS NULL OR p.k < halt_k)),
      broken AS (SELECT title, error FROM firsts LEFT JOIN halt ON true WHERE NOT quota AND (halt_k IS NULL OR k < halt_k)), """
    return first + RUN.replace("AS note_t FROM placed", "AS note_t FROM visited").replace(
        "FROM fx_notes) u", "FROM fx_notes WHERE (SELECT count(*) FROM halt) = 0) u"
    )


OUTCOMES = "SELECT doc_id AS item, result, error, path FROM done UNION ALL SELECT title, 'failed', error, NULL FROM broken"
RUN_FROM = "fx_kb fx_tree fx_media fx_index fx_notes fx_contents fx_downloads"
COUNTS = """count(*) FILTER (result = 'created') AS created, count(*) FILTER (result = 'updated') AS updated,
    count(*) FILTER (result = 'skipped') AS skipped, count(*) FILTER (result = 'failed') AS failed"""
SUMMARY = "'同步完成：新增 ' || created || ' / 更新 ' || updated || ' / 跳过 ' || skipped || ' / 失败 ' || failed AS summary"

# ---- images --------------------------------------------------------------------------

MD_IMAGE = rf'!\[([^\]]*)\]\(({NOT_WS_PAREN}+)(?:{WS}+"[^"]*")?\)'
HTML_IMAGE = r'(?i)<img\b[^>]*\bsrc="([^"]+)"[^>]*>'


def refs(docs: str) -> str:
    return f"""refs AS (
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS INT) AS pos, url
        FROM (SELECT doc_id, url, min(p) AS first_pos
              FROM (SELECT doc_id, unnest(urls) AS url, generate_subscripts(urls, 1) AS p
                    FROM (SELECT doc_id, list_concat(regexp_extract_all(content, '{MD_IMAGE}', 2),
                                                     regexp_extract_all(content, '{HTML_IMAGE}', 1)) AS urls
                          FROM {docs}) a) b GROUP BY doc_id, url) c)"""


RESOLVED_REFS = f"""resolved_refs AS (
    SELECT r.doc_id, r.pos, r.url, starts_with(r.url, 'data:') OR b.url IS NOT NULL AS ok,
           CASE WHEN starts_with(r.url, 'data:') THEN 'png'
                WHEN b.url IS NOT NULL THEN {image_ext("b.content_type", "r.url")} END AS ext
    FROM refs r LEFT JOIN fx_image_blobs b USING (url))"""
STORED = """stored AS (
    SELECT doc_id, url, CAST(image_no AS INT) AS image_no,
           split_part(doc_id, '_', -1) || '-' || image_no || '.' || ext AS file_name
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS image_no FROM resolved_refs WHERE ok) s)"""
IMAGES = ", ".join([refs("fx_images"), RESOLVED_REFS, STORED])


def stored_name(url: str) -> str:
    return f"(SELECT max(file_name) FROM stored s WHERE s.doc_id = i.doc_id AND s.url = {url})"


# ---- article parts of a page ---------------------------------------------------------


def text_of(html: str) -> str:
    """Text of a fragment; browsers read these old entities without ``;`` too."""
    bare = f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        bare = f"regexp_replace({bare}, '{entity}', '{char}', 'g')"
    return bare


def page_parts(source: str, html: str) -> str:
    article = text_of(f"regexp_extract({html}, '(?s)<article>(.*?)</article>', 1)")
    div = text_of(f"""regexp_extract({html}, '(?s)<div class="ad">(.*?)</div>', 1)""")
    return f"""parts AS (
        SELECT *, CASE WHEN length(article_text) > 200 THEN 'article' WHEN length(div_text) > 0 THEN 'div' ELSE 'body' END AS selector,
               length(CASE WHEN length(article_text) > 200 THEN article_text ELSE div_text END) AS block_length
        FROM (SELECT *, {trim(article)} AS article_text, {trim(div)} AS div_text FROM {source}) p)"""


def block_merge() -> str:
    """Merged property block of the four document shapes of the relation."""
    added = 'created: 2024-06-01\\nsource: "https://example.com/x"\\n'.replace("\\n", "' || chr(10) || '")
    nl = "' || chr(10) || '"
    rest0 = "substring(content, length('---' || chr(10) || 'title: \"t\"' || chr(10) || 'mine: 1' || chr(10) || '---') + 1)"
    rest1 = "substring(content, length('---' || chr(13) || chr(10) || 'tags: []' || chr(13) || chr(10) || '--- ') + 1)"
    return f"""CASE CAST(doc_id AS BIGINT) % 4
        WHEN 0 THEN '---{nl}title: "t"{nl}mine: 1{nl}{added}tags:{nl}  - clippings{nl}---' || {rest0}
        WHEN 1 THEN '---{nl}tags:{nl}  - clippings{nl}title: "new title"{nl}{added}---' || {rest1}
        ELSE content END"""


ORACLES: dict[str, str] = {
    "sync_report": with_(DECIDED_FROM, DECIDED) + f"SELECT {COUNTS} FROM decided",
    "report_line": with_(DECIDED_FROM, DECIDED) + f"SELECT *, {SUMMARY} FROM (SELECT {COUNTS} FROM decided) c",
    "decide_action": with_(DECIDED_FROM, DECIDED) + "SELECT media_id, t, action, result FROM decided",
    "sync_fold": with_("fx_items_dup", folded(False)) + "SELECT doc_id, seq, t, action FROM folded",
    "sync_fold_indexed": with_("fx_items_dup fx_index", folded(True)) + "SELECT doc_id, seq, t, action FROM folded",
    "stream_fold": with_("fx_items_dup", folded(False)) + "SELECT doc_id, seq, t, action FROM folded",
    "stream_state": with_("fx_items_dup", folded(False))
    + """SELECT doc_id, 'vault/' || doc_id || '.md' AS path, CASE WHEN t > 0 THEN CAST(t AS VARCHAR) ELSE '' END AS update_time
         FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn
               FROM folded WHERE ok AND action <> 'skip') w WHERE rn = 1""",
    "stream_used_store": with_("fx_items_dup fx_index", folded(True))
    + """SELECT doc_id, path, update_time FROM fx_index
         WHERE doc_id NOT IN (SELECT doc_id FROM folded WHERE ok AND action <> 'skip')
         UNION ALL
         SELECT doc_id, 'vault/' || doc_id || '.md', CASE WHEN t > 0 THEN CAST(t AS VARCHAR) ELSE '' END
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn
               FROM folded WHERE ok AND action <> 'skip') w WHERE rn = 1""",
    "stream_seeded_state": with_("fx_items_dup fx_index", folded(True))
    + """SELECT doc_id, path, update_time FROM fx_index
         WHERE doc_id NOT IN (SELECT doc_id FROM folded WHERE ok AND action <> 'skip')
         UNION ALL
         SELECT doc_id, 'vault/' || doc_id || '.md', CASE WHEN t > 0 THEN CAST(t AS VARCHAR) ELSE '' END
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn
               FROM folded WHERE ok AND action <> 'skip') w WHERE rn = 1""",
    "stream_quota_resume": with_("fx_items_dup", folded(False)) + "SELECT doc_id, seq, t, action FROM folded",
    "vault_after_crash": with_("fx_items", """claimed AS (SELECT media_id, pos % 3 AS k FROM fx_items)""")
    + """SELECT 'vault/' || media_id || '.md' AS path, CASE WHEN k = 0 THEN 'second' WHEN k = 1 THEN 'first' ELSE 'before' END AS content
         FROM claimed""",
    "quota_cut": with_("fx_items fx_requests", OUTCOME, RESOLVED)
    + """SELECT media_id, -pos AS seq FROM fx_items
         WHERE -pos < coalesce((SELECT min(-i.pos) FROM fx_items i JOIN resolved r ON r.request_id = i.pos
                                WHERE resolution = 'quota'), 9223372036854775807)""",
    "error_list": with_(DECIDED_FROM, DECIDED)
    + """SELECT pos AS seq, title || ': ' || CASE WHEN has_media THEN 'no content source' ELSE 'no answer landed' END AS error_line
         FROM decided WHERE result = 'failed'""",
    "index_upsert": with_("fx_items_dup fx_index", folded(True))
    + f"""SELECT {INDEX_ROW} FROM fx_index
          WHERE doc_id NOT IN (SELECT doc_id FROM folded WHERE ok AND action <> 'skip')
          UNION ALL
          SELECT doc_id, 'vault/feed/' || doc_id || '.md', 'kb_0', 'event ' || seq, 0,
                 CASE WHEN t > 0 THEN CAST(t AS VARCHAR) ELSE '' END, '{SYNCED_AT}'
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn
                FROM folded WHERE ok AND action <> 'skip') w WHERE rn = 1""",
    "index_remove": with_("fx_index fx_media")
    + f"SELECT {INDEX_ROW} FROM fx_index WHERE doc_id NOT IN (SELECT media_id FROM fx_media WHERE notebook_id IS NOT NULL)",
    "index_lookup": with_("fx_index fx_media")
    + f"SELECT {INDEX_ROW} FROM fx_index WHERE doc_id IN (SELECT media_id FROM fx_media WHERE url IS NOT NULL)",
    "index_json_roundtrip": with_("fx_index") + f"SELECT {INDEX_ROW} FROM fx_index",
    "index_size": with_("fx_index")
    + """SELECT count(*) AS entries, (SELECT count(*) FROM documents WHERE trim(text, ' ') <> '') AS index_corrupt FROM fx_index""",
    "index_clear": with_(
        "fx_items",
        f"wanted AS (SELECT pos AS seq, media_id AS doc_id, parent_folder_id AS parent, {safe_name('title')} AS base FROM fx_items)",
        claims("wanted"),
        "taken AS (SELECT parent, name FROM claimed)",
        """second AS (SELECT w.*, base || '-' || substring(doc_id, 1, 8) AS short, base || '-' || doc_id AS long FROM wanted w)""",
        """named AS (SELECT s.*, CASE WHEN t.name IS NULL
                AND row_number() OVER (PARTITION BY s.parent, short ORDER BY seq) = 1 THEN short ELSE long END AS name
            FROM second s LEFT JOIN taken t ON t.parent = s.parent AND t.name = s.short)""",
    )
    + """SELECT n.doc_id, 'create' AS action, n.parent || '/' || n.name || '.md' AS path, t.name IS NOT NULL AS clash
         FROM named n LEFT JOIN taken t ON t.parent = n.parent AND t.name = n.name""",
    "paged_catalog": with_(
        "fx_pages20",
        "borders AS (SELECT listing_id, min(page_no) AS border FROM fx_pages20 WHERE is_end OR no_cursor GROUP BY listing_id)",
    )
    + """SELECT listing_id, page_no, pos, docid AS kb_id, 'base ' || docid AS kb_name FROM fx_pages20
         LEFT JOIN borders USING (listing_id) WHERE border IS NULL OR page_no <= border""",
    "paged_levels": """SELECT kb_id, folder_id, CAST(rn // 20 AS INT) AS page_no, CAST(rn % 20 AS INT) AS pos, media_id, 11 AS media_type
        FROM (SELECT 'kb_' || lang AS kb_id, source AS folder_id, 'doc_' || doc_id AS media_id,
                     row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS rn,
                     (count(*) OVER (PARTITION BY lang, source) - 1) // 20 AS last_page FROM documents) d
        WHERE rn // 20 <= greatest(last_page - 1, 0)""",
    "paged_notes": with_(
        "fx_pages20",
        "borders AS (SELECT listing_id, min(page_no) AS border FROM fx_pages20 WHERE is_end GROUP BY listing_id)",
        """heads AS (SELECT listing_id, page_no, CAST(coalesce(sum(n) OVER (PARTITION BY listing_id ORDER BY page_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset
            FROM (SELECT listing_id, page_no, count(*) AS n FROM fx_pages20 GROUP BY 1, 2) g)""",
    )
    + """SELECT listing_id, page_no, pos, page_offset, docid, 'note ' || docid AS title FROM fx_pages20
         JOIN heads USING (listing_id, page_no) LEFT JOIN borders USING (listing_id)
         WHERE (border IS NULL OR page_no <= border) AND pos % 7 <> 6""",
    "paged_by_cursor": with_(
        "fx_chain",
        "heads AS (SELECT DISTINCT listing_id, cursor, next_cursor, is_end FROM fx_chain)",
        """walk AS (
            SELECT listing_id, cursor, next_cursor, is_end, 0 AS page_no, [cursor] AS seen FROM heads WHERE cursor = ''
            UNION ALL
            SELECT h.listing_id, h.cursor, h.next_cursor, h.is_end, w.page_no + 1, list_append(w.seen, h.cursor)
            FROM walk w JOIN heads h ON h.listing_id = w.listing_id AND h.cursor = w.next_cursor
            WHERE NOT w.is_end AND w.next_cursor <> '' AND NOT list_contains(w.seen, h.cursor))""",
        """ends AS (SELECT listing_id, page_no + 1 AS pages,
                CASE WHEN is_end OR next_cursor = '' THEN 'complete' WHEN list_contains(seen, next_cursor) THEN 'loop' ELSE 'broken' END AS ending
            FROM walk QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY page_no DESC) = 1)""",
        recursive=True,
    )
    + """SELECT listing_id, CAST(w.page_no AS BIGINT) AS page_no, f.pos, f.docid AS kb_id, CAST(e.pages AS BIGINT) AS pages, e.ending
         FROM walk w JOIN fx_chain f USING (listing_id, cursor) JOIN ends e USING (listing_id)""",
    "note_offset_gaps": with_(
        "fx_pages20",
        """asked AS (SELECT listing_id, n, CASE WHEN k = 1 AND p > 0 THEN p * 20 - 3 WHEN k = 2 AND p > 1 THEN p * 20 + 5 ELSE p * 20 END AS o
            FROM (SELECT listing_id, page_no AS p, count(*) AS n, ascii(substr(listing_id, 4, 1)) % 3 AS k FROM fx_pages20 GROUP BY ALL) g)""",
        """reach AS (SELECT *, coalesce(max(o + n) OVER (PARTITION BY listing_id ORDER BY o
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM asked)""",
    )
    + """SELECT listing_id, CAST(o AS BIGINT) AS page_offset, CASE WHEN o > r THEN 'gap' ELSE 'overlap' END AS kind,
                CAST(least(o, r) AS BIGINT) AS from_entry, CAST(CASE WHEN o > r THEN o ELSE least(r, o + n) END AS BIGINT) AS until_entry
         FROM reach WHERE o <> r""",
    "paged_notes_at": with_(
        "fx_pages20",
        """raw AS (SELECT listing_id, page_no AS p, pos, docid, ascii(substr(listing_id, 4, 1)) % 3 AS k FROM fx_pages20)""",
        """placed AS (SELECT *, pos + CASE WHEN k = 1 AND p > 0 THEN p * 20 - 3 WHEN k = 2 AND p > 1 THEN p * 20 + 5 ELSE p * 20 END AS entry_no FROM raw)""",
        """last AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY listing_id, entry_no ORDER BY p DESC) = 1)""",
    )
    + """SELECT listing_id, CAST(entry_no AS BIGINT) AS entry_no, docid, 'note ' || docid AS title FROM last WHERE pos % 7 <> 6""",
    "classify_outcome": with_("fx_requests", OUTCOME)
    + """SELECT request_id, attempt, outcome, quota_body, status = 429 OR status BETWEEN 500 AND 599 AS retryable FROM outcomes""",
    "resolve_requests": with_("fx_requests", OUTCOME, RESOLVED)
    + """SELECT request_id, resolution, attempts_made,
                CAST(CASE attempts_made WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 3000 ELSE 7000 END AS BIGINT) AS waited_ms
         FROM resolved""",
    "stream_requests": with_("fx_requests", OUTCOME, RESOLVED)
    + """SELECT request_id, resolution, attempts_made,
                CAST(CASE attempts_made WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 3000 ELSE 7000 END AS BIGINT) AS waited_ms
         FROM resolved""",
    "request_errors": with_("fx_requests", OUTCOME)
    + """SELECT request_id, attempt, coalesce(msg, '{"status":' || status || '}') AS error FROM outcomes WHERE outcome <> 'success'""",
    "pacing_audit": """SELECT user_id AS client, count(*) AS requests,
            count(*) FILTER (epoch_us(ts) - before < 1000000000) AS too_close
        FROM (SELECT user_id, ts, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS before FROM events) e
        GROUP BY user_id""",
    "schedule_due": """WITH spans AS (SELECT user_id AS client, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM events GROUP BY user_id),
        settings AS (SELECT *, (client % 17) / 2.0 AS v, client % 3 AS u FROM spans),
        timed AS (SELECT *, u = 0 AND v < 5 AS clamped,
            CAST(CASE u WHEN 0 THEN CASE WHEN v < 5 THEN 5 ELSE floor(v) END * 60000 WHEN 1 THEN greatest(floor(v), 1) * 3600000
                 ELSE greatest(floor(v), 1) * 86400000 END AS BIGINT) AS interval_ms FROM settings)
        SELECT client, interval_ms, clamped, CAST(span // (interval_ms * 1000) AS BIGINT) AS due FROM timed""",
    "tree_paths": with_("fx_tree fx_kb", placed("true"), recursive=True)
    + """SELECT media_id, parent_path, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY k) - 1 AS seq FROM placed""",
    "folder_set": with_(
        "fx_tree fx_kb",
        placed("true"),
        """needed AS (SELECT DISTINCT array_to_string(list_slice(parts, 1, n), '/') AS folder
            FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n
                  FROM (SELECT DISTINCT string_split(parent_path, '/') AS parts FROM placed) a) b)""",
        recursive=True,
    )
    + """SELECT folder, CASE WHEN folder IN (SELECT 'vault/ASIA/N_' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
                                             WHERE r_name = 'ASIA') THEN 'blocked'
                             WHEN folder IN (SELECT 'vault/' || r_name FROM region) THEN 'exists' ELSE 'create' END AS state
         FROM needed""",
    "item_route": with_("fx_tree fx_media")
    + f"""SELECT i.media_id, i.media_type = 99 OR starts_with(i.media_id, 'folder_') AS is_folder,
                 coalesce(m.media_type = 11, false) OR coalesce(notebook_id, '') <> '' AS is_note,
                 {route("m.media_type", "m.notebook_id", "m.url")} AS route
          FROM fx_tree i LEFT JOIN fx_media m USING (media_id)""",
    "url_route": with_(
        "fx_fetched",
        "hosts AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM fx_fetched)",
        "newest AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rn FROM hosts)",
    )
    + """SELECT h.page_id, h.host AS url, n.page_id AS fetch_id,
                CASE WHEN n.status = 429 OR n.status >= 500 THEN 'retryable' WHEN n.status >= 400 THEN 'fatal' ELSE 'success' END
                    AS fetch_outcome,
                CASE WHEN lower(n.content_type) LIKE '%text/html%' AND n.text <> '' THEN 'article' ELSE 'file' END AS kind
         FROM hosts h JOIN newest n ON n.host = h.host AND n.rn = 1""",
    "scope_select": with_("fx_items fx_kb fx_notes")
    + """SELECT kb_id, kb_pos, media_id AS doc_id, title FROM fx_items JOIN fx_kb USING (kb_id) WHERE selected
         UNION ALL SELECT '', NULL, docid, title FROM fx_notes""",
    "kb_annotate": with_("fx_kb")
    + """SELECT kb_id, kb_name, base_type || CASE WHEN role_type <> '' THEN ' · ' || role_type ELSE '' END
                || ' · ' || content_count || ' 篇' AS meta, selected AS already_added FROM fx_kb""",
    "kb_selection": with_("fx_kb") + "SELECT kb_id, kb_name, kb_pos FROM fx_kb WHERE (selected OR kb_pos IN (2, 3)) AND kb_pos <> 1",
    "unique_names": with_(
        "fx_items",
        f"wanted AS (SELECT pos AS seq, media_id AS doc_id, parent_folder_id AS parent, {safe_name('title')} AS base FROM fx_items)",
        claims("wanted"),
    )
    + "SELECT doc_id, name, parent || '/' || name || '.md' AS path, false AS clash FROM claimed",
    "path_ownership": with_("fx_index")
    + """SELECT w.doc_id, w.path, x.doc_id AS owner_id, coalesce(x.doc_id = w.doc_id, false) AS owned
         FROM (SELECT 'doc_' || o_orderkey AS doc_id,
                      'vault/' || o_custkey || '/' || min(o_orderkey) OVER (PARTITION BY o_custkey) || '.md' AS path FROM orders) w
         LEFT JOIN fx_index x USING (path)""",
    "write_plan": with_(
        DECIDED_FROM,
        DECIDED,
        "written AS (SELECT *, action = 'update' AND index_time <> '' AS in_place FROM decided WHERE result IN ('created', 'updated'))",
        f"""wanted AS (SELECT pos AS seq, media_id AS doc_id, parent_folder_id AS parent, {safe_name('title')} AS base
            FROM written WHERE NOT in_place)""",
        claims("wanted"),
    )
    + """SELECT media_id AS doc_id, action, in_place,
                CASE WHEN in_place THEN index_path ELSE c.parent || '/' || c.name || '.md' END AS path
         FROM written LEFT JOIN claimed c ON c.seq = written.pos""",
    "sanitize_names": f"""SELECT doc_id, {safe_name("title")} AS file_name, substring('document_' || doc_id, 1, 8) AS id_prefix,
            'untitled-' || substring('document_' || doc_id, 1, 8) AS fallback,
            CAST(strlen(CASE WHEN title = '' THEN 'untitled-' || substring('document_' || doc_id, 1, 8) ELSE title END) AS INT) AS title_bytes
        FROM (SELECT doc_id, CASE WHEN source = 'src3' THEN '' ELSE text END AS title FROM documents) d""",
    "timestamps": with_("fx_media", f"timed AS (SELECT media_id, {seconds('update_time')} AS t FROM fx_media)")
    + """SELECT media_id, t, iso, iso AS iso_direct, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day
         FROM (SELECT *, CASE WHEN t = 0 THEN '' ELSE strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S') END AS iso FROM timed) s""",
    "attachment_dirs": """SELECT c_custkey,
        CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal <= 5000 THEN 'vault/' || c_name || '/attachments'
             ELSE 'media/' || c_mktsegment END AS image_dir,
        c_mktsegment <> 'BUILDING' AND c_acctbal <= 5000 AS fell_back
    FROM customer""",
    "file_ext": with_(
        "fx_fetched fx_media",
        """both_kinds AS (SELECT 'page_' || page_id AS id, content_type, url FROM fx_fetched
            UNION ALL SELECT media_id, '', coalesce(url, 'no url') FROM fx_media)""",
    )
    + f"SELECT id, {file_ext('content_type', 'url')} AS ext, {image_ext('content_type', 'url')} AS image_ext FROM both_kinds",
    "file_store": with_(
        "fx_fetched",
        f"""writes AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || '/f' || length(url) || '.' || {file_ext('content_type', 'url')} AS path,
                text FROM fx_fetched WHERE status < 400)""",
    )
    + """SELECT path, text AS body FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id DESC) AS rn FROM writes) w
         WHERE rn = 1 UNION ALL SELECT 'old/' || c_name, c_mktsegment FROM customer""",
    "file_sink": with_(
        "fx_fetched",
        f"""writes AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || '/f' || length(url) || '.' || {file_ext('content_type', 'url')} AS path,
                text FROM fx_fetched WHERE status < 400)""",
    )
    + """SELECT path, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id DESC) AS rn FROM writes) w
         WHERE rn = 1 AND text <> '' UNION ALL SELECT 'old/' || c_name, md5(c_mktsegment) FROM customer""",
    "file_download": with_("fx_fetched", f"typed AS (SELECT *, {file_ext('content_type', 'url')} AS ext FROM fx_fetched WHERE status < 400)")
    + f"""SELECT url, 'files/f' || page_id || '.' || ext AS file_path, ext,
                 '# File ' || page_id || chr(10) || chr(10) || '> 文件类型：' || upper(ext) || chr(10) || chr(10)
                 || '[f' || page_id || '.' || ext || '](f' || page_id || '.' || ext || ')' || chr(10) AS stub FROM typed""",
    "frontmatter_build": f"""SELECT doc_id, '---' || chr(10) || 'title: ' || {yaml_string("'He said \"' || source || '\" \\ done'")} || chr(10)
            || CASE WHEN lang <> 'fr' THEN 'created: {RUN_DATE}' || chr(10) ELSE '' END
            || CASE WHEN lang = 'en' THEN 'source: "https://example.com/' || doc_id || '"' || chr(10) ELSE '' END
            || 'tags:' || CASE WHEN lang = 'de' THEN chr(10) || '  - a' || chr(10) || '  - b' ELSE chr(10) || '  - clippings' END
            || chr(10) || '---' || chr(10) || chr(10) || {ltrim("text")} || chr(10) AS content
        FROM documents""",
    "frontmatter_merge": with_("fx_docs_md") + f"SELECT doc_id, {block_merge()} AS content FROM fx_docs_md",
    "body_splice": with_("fx_docs_md")
    + """SELECT doc_id, CAST(doc_id AS BIGINT) % 4 IN (0, 1) AS has_block,
                CASE CAST(doc_id AS BIGINT) % 4
                    WHEN 0 THEN '---' || chr(10) || 'title: "t"' || chr(10) || 'mine: 1' || chr(10) || '---' || chr(10) || chr(10) || 'Body of ' || doc_id || chr(10)
                    WHEN 1 THEN '---' || chr(10) || 'tags: []' || chr(10) || '--- ' || chr(10) || chr(10) || 'Body of ' || doc_id || chr(10)
                    ELSE '---' || chr(10) || 'title: "doc ' || doc_id || '"' || chr(10) || 'created: 2024-06-01' || chr(10) || 'tags:' || chr(10)
                         || '  - clippings' || chr(10) || '---' || chr(10) || chr(10) || chr(10) || '  Body of ' || doc_id || chr(10) END AS content
         FROM fx_docs_md""",
    "text_clean": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "page_clean": with_("fx_fetched") + f"SELECT page_id, {strip_style('text')} AS stripped, {clean('text')} AS cleaned FROM fx_fetched",
    "paragraphs": with_(
        "fx_docs_md",
        "both_kinds AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents UNION ALL SELECT 'md_' || doc_id, content FROM fx_docs_md)",
    )
    + f"""SELECT id, array_to_string(list_filter(list_transform(string_split_regex(content, '\\n{{2,}}'),
                 lambda p: {trim("p")}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM both_kinds""",
    "looks_like_html": with_(
        "fx_fetched",
        "both_kinds AS (SELECT 'doc_' || doc_id AS id, text FROM documents UNION ALL SELECT 'page_' || page_id, text FROM fx_fetched)",
    )
    + f"""SELECT id, regexp_matches(lower(substring(text, 1, 2000)), '^{WS}*<(!doctype|html|body|div|p|article|section|table|ul|ol|h[1-6])\\b')
              OR regexp_matches(lower(substring(text, 1, 2000)),
                 '<(div|p|article|section|table|tbody|thead|tr|td|th|ul|ol|li|h[1-6]|pre|blockquote)\\b') AS is_html FROM both_kinds""",
    "note_bodies": with_("fx_notes")
    + f"""SELECT docid AS doc_id, CASE WHEN {trim("content")} = '' THEN '' ELSE {clean("content")} END AS body,
                 0 AS downloaded, 0 AS failed FROM fx_notes""",
    "article_route": with_(
        "fx_fetched",
        "routed AS (SELECT * FROM fx_fetched WHERE lower(content_type) LIKE '%text/html%' AND text <> '')",
        page_parts("routed", "text"),
    )
    + f"""SELECT page_id, selector, CAST(block_length AS INT) AS block_length, CAST(block_length AS INT) AS clean_length,
                 block_length < 80 AS degraded,
                 CASE WHEN block_length < 80 THEN '# Page ' || page_id || chr(10) || chr(10) || '[原文链接](' || url || ')'
                      || chr(10) || chr(10) || '> 正文抓取失败，仅保留链接。' END AS degraded_body
          FROM parts""",
    "lazy_images": """SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || '/i/' || page_id || '.png' AS first_image
        FROM pages""",
    "page_meta": "SELECT page_id, 'Sum &lt; ' || page_id AS summary, '' AS missing FROM pages",
    "image_refs": with_("fx_images", refs("fx_images")) + "SELECT doc_id, pos, url FROM refs",
    "image_join": with_("fx_images fx_image_blobs", IMAGES) + "SELECT doc_id, pos, url, ok, ext FROM resolved_refs",
    "image_names": with_("fx_images fx_image_blobs", IMAGES) + "SELECT doc_id, url, image_no, file_name FROM stored",
    "image_rewrite": with_(
        "fx_images fx_image_blobs",
        IMAGES,
        "numbered AS (SELECT *, CAST(split_part(doc_id, '_', 3) AS BIGINT) AS n FROM fx_images)",
        f"""named AS (SELECT i.*, {stored_name("'https://img.example.com/' || (n // 3) || '.jpg'")} AS first_file,
                {stored_name("'data:image/png;base64,aGk='")} AS data_file,
                {stored_name("'https://img.example.com/' || ((n + 1) // 3)")} AS last_file FROM numbered i)""",
        "counts AS (SELECT doc_id, count(*) FILTER (ok) AS downloaded, count(*) FILTER (NOT ok) AS failed FROM resolved_refs GROUP BY doc_id)",
    )
    + """SELECT doc_id, CAST(downloaded AS INT) AS downloaded, CAST(failed AS INT) AS failed,
                replace(replace(replace(replace(content,
                    '![a' || n || '](https://img.example.com/' || (n // 3) || '.jpg)',
                    coalesce('![[' || first_file || '|a' || n || ']]', '![a' || n || '](https://img.example.com/' || (n // 3) || '.jpg)')),
                    '![](https://img.example.com/' || (n // 3) || '.jpg)',
                    coalesce('![[' || first_file || ']]', '![](https://img.example.com/' || (n // 3) || '.jpg)')),
                    '<img class="z" src="data:image/png;base64,aGk=">', '![[' || data_file || ']]'),
                    '<img src="https://img.example.com/' || ((n + 1) // 3) || '">',
                    coalesce('![[' || last_file || ']]', '<img src="https://img.example.com/' || ((n + 1) // 3) || '">')) AS content
         FROM named JOIN counts USING (doc_id)""",
    "data_uris": """SELECT doc_id, lang <> 'fr' AS ok,
            CASE WHEN lang <> 'fr' THEN CASE WHEN source = 'src1' THEN 'svg' ELSE 'jpg' END END AS ext,
            CASE WHEN lang <> 'fr' THEN md5(text) END AS digest FROM documents""",
    "attachments_new": with_(
        "fx_images fx_image_blobs",
        "langs AS (SELECT 'wiki_' || d.doc_id || '_' || lang AS doc_id, d.doc_id AS n, content FROM documents d "
        "JOIN fx_images i ON split_part(i.doc_id, '_', 3) = CAST(d.doc_id AS VARCHAR))",
        refs("langs"),
        RESOLVED_REFS,
        STORED,
        "files AS (SELECT 'shared/' || file_name AS path, s.doc_id, url, n FROM stored s JOIN langs USING (doc_id))",
    )
    + """SELECT path, doc_id, url, wanted - 1 AS collided
         FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, doc_id, url) AS rn, count(*) OVER (PARTITION BY path) AS wanted
               FROM files) f
         WHERE rn = 1 AND path NOT IN (SELECT 'shared/' || lang || '-2.png' FROM documents WHERE lang IS NOT NULL)""",
    "run_attachments": with_("fx_images fx_image_blobs", IMAGES)
    + """SELECT 'vault/Notes/attachments/' || file_name AS path, 'pic_' || doc_id AS doc_id,
                md5(CASE WHEN starts_with(url, 'data:') THEN 'hi' ELSE 'image ' || url END) AS digest FROM stored""",
    "run_report": with_(RUN_FROM, placed("selected"), RUN, recursive=True)
    + f"SELECT *, {SUMMARY} FROM (SELECT {COUNTS} FROM done) c",
    "run_failed_listing": with_(
        RUN_FROM, placed("selected"),
        stopped_run("""SELECT l.kb_id, l.k, l.kb_id = 'kb_3' AS quota, '知识库「' || kb_name || '」' AS title, 'HTTP 500 ' || t.title AS error
            FROM levels l JOIN fx_kb USING (kb_id) JOIN fx_tree t ON t.kb_id = l.kb_id AND t.media_id = l.folder_id
            WHERE l.folder_id LIKE 'folder_c%' AND TRY_CAST(substr(l.folder_id, 9) AS BIGINT) % 40 = 39 AND l.kb_id IN ('kb_1', 'kb_3')"""),
        recursive=True,
    ) + OUTCOMES,
    "run_blocked_folder": with_(
        RUN_FROM, placed("selected"),
        stopped_run("""SELECT l.kb_id, l.k, false AS quota, '知识库「' || kb_name || '」' AS title,
                '路径 ' || l.path || ' 已被文件占用，无法创建文件夹' AS error
            FROM levels l JOIN fx_kb USING (kb_id)
            WHERE l.path IN (SELECT 'vault/' || r_name || '/N_' || n_name || '/BUILDING'
                             FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 1)"""),
        recursive=True,
    ) + OUTCOMES,
    "run_from_pages": with_(RUN_FROM, placed("selected"), RUN, recursive=True)
    + f"SELECT *, {SUMMARY} FROM (SELECT {COUNTS} FROM done) c",
    "run_twice": with_(RUN_FROM, placed("selected"), RUN, recursive=True)
    + f"""SELECT *, {SUMMARY} FROM (SELECT CAST(0 AS BIGINT) AS created, CAST(0 AS BIGINT) AS updated,
            count(*) FILTER (result <> 'failed') AS skipped, count(*) FILTER (result = 'failed') AS failed FROM done) c""",
    "run_results": with_(RUN_FROM, placed("selected"), RUN, recursive=True)
    + "SELECT seq, doc_id, route, action, result, error, path FROM done",
    "run_index": with_(RUN_FROM, placed("selected"), RUN, recursive=True)
    + f"""SELECT {INDEX_ROW} FROM fx_index WHERE doc_id NOT IN (SELECT doc_id FROM done WHERE path IS NOT NULL)
          UNION ALL
          SELECT doc_id, path, kb_id, CASE WHEN title = '' THEN 'untitled-' || substring(doc_id, 1, 8) ELSE title END, 0,
                 CASE WHEN t > 0 THEN CAST(t AS VARCHAR) ELSE '' END, '{SYNCED_AT}' FROM done WHERE path IS NOT NULL""",
    "run_new_texts": with_(
        RUN_FROM, placed("selected"), RUN,
        f"""texts AS (
            SELECT d.path, d.doc_id, CASE WHEN title = '' THEN 'untitled-' || substring(d.doc_id, 1, 8) ELSE title END AS title, '' AS source,
                   {ltrim(clean("coalesce(c.content, '')"))} AS body
            FROM done d JOIN contents c ON c.doc_id = d.content_key WHERE result = 'created' AND route = 'note'
            UNION ALL
            SELECT path, doc_id, CASE WHEN title = '' THEN 'untitled-' || substring(doc_id, 1, 8) ELSE title END, url,
                   '# ' || title || chr(10) || chr(10) || '> 文件类型：' || upper(ext) || chr(10) || chr(10) || '[' || name || '](' || name || ')' || chr(10)
            FROM (SELECT d.*, ext, regexp_replace(split_part(path, '/', -1), '\\.md$', '') || '.' || ext AS name
                  FROM done d JOIN (SELECT url, {file_ext('content_type', 'url')} AS ext FROM fx_downloads
                                    WHERE NOT (lower(content_type) LIKE '%text/html%' AND text <> '')) f USING (url)
                  WHERE result = 'created' AND route = 'url') n)""",
        recursive=True,
    )
    + f"""SELECT path, doc_id, '---' || chr(10) || 'title: ' || {yaml_string("title")} || chr(10) || 'created: {RUN_DATE}' || chr(10)
                 || CASE WHEN source <> '' THEN 'source: ' || {yaml_string("source")} || chr(10) ELSE '' END
                 || 'tags:' || chr(10) || '  - clippings' || chr(10) || '---' || chr(10) || chr(10) || body || chr(10) AS content
          FROM texts""",
    "notes_sync": with_(
        "fx_notes fx_index",
        f"""decided AS (SELECT n.*, CAST(docid AS BIGINT) AS seq, 'doc_' || docid AS doc_id,
                {action("x.doc_id IS NOT NULL", f"coalesce({number('x.update_time')}, 0)", f"({seconds('modify_time')})")} AS action
            FROM fx_notes n LEFT JOIN fx_index x ON x.doc_id = 'doc_' || docid)""",
        f"wanted AS (SELECT seq, doc_id, 'vault/Notes' AS parent, {safe_name('title')} AS base FROM decided WHERE action <> 'skip')",
        claims("wanted"),
    )
    + f"""SELECT d.doc_id, action, c.parent || '/' || c.name || '.md' AS path,
                 CASE WHEN c.name IS NOT NULL THEN '---' || chr(10) || 'title: ' || {yaml_string("title")} || chr(10)
                      || 'created: {RUN_DATE}' || chr(10) || 'tags:' || chr(10) || '  - clippings' || chr(10) || '---' || chr(10)
                      || chr(10) || {ltrim(clean("content"))} || chr(10) END AS content
          FROM decided d LEFT JOIN claimed c USING (seq)""",
    "kb_probe": with_("fx_tree")
    + """SELECT kb_id, media_type, count(*) AS items, count(*) FILTER (parent_folder_id = '') AS first_level
         FROM fx_tree GROUP BY kb_id, media_type""",
    "media_answers": with_("fx_media") + "SELECT media_id, media_type, notebook_id, url, update_time FROM fx_media",
    "export_url": with_("fx_media")
    + """SELECT media_id, CASE WHEN update_time IS NOT NULL THEN url || '?export=1' END AS export_url,
                coalesce(CASE WHEN update_time IS NOT NULL THEN url || '?export=1' END, url) AS best_url FROM fx_media""",
}

# cleaning a text and embedding its images do not touch each other's places
ORACLES["note_images"] = f"SELECT doc_id, downloaded, failed, {clean('content')} AS body FROM ({ORACLES['image_rewrite']}) r"
