"""Input relations derived from the given tables.

The listings, responses and states a sync reads do not occur in the given tables
as such, so they are derived from them with SQL that Spark and the checking
database read alike. ``{name}`` stands for a table, ``EPOCH(x)`` for whole seconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_ITEM_TYPE = "CASE o_orderkey%4 WHEN 0 THEN 11 WHEN 2 THEN 1 ELSE 6 END"

FX: dict[str, str] = {
    "fx_kb": """
        SELECT concat('kb_', r_regionkey) AS kb_id, r_name AS kb_name, r_regionkey AS kb_pos,
               CASE WHEN r_regionkey%2=0 THEN 'personal' ELSE 'shared' END AS base_type,
               CASE WHEN r_regionkey=0 THEN 'creator' ELSE '' END AS role_type,
               concat('', (r_regionkey+1)*5) AS content_count, r_regionkey<>2 AS selected
        FROM {region}""",
    "fx_items": f"""
        SELECT concat('kb_',n_regionkey) AS kb_id, concat('doc_',o_orderkey) AS media_id,
               concat('folder_c',o_custkey) AS parent_folder_id,
               concat(' ',o_orderpriority, CASE WHEN o_orderkey%7=0 THEN '?' ELSE '' END) AS title,
               {_ITEM_TYPE} AS media_type, CAST(o_orderkey AS BIGINT) AS pos
        FROM {{orders}} JOIN {{customer}} ON o_custkey=c_custkey JOIN {{nation}} ON c_nationkey=n_nationkey""",
    "fx_tree": """
        SELECT concat('kb_',n_regionkey) AS kb_id, concat('folder_n',n_nationkey) AS media_id, '' AS parent_folder_id,
               concat('N/',n_name) AS title, 99 AS media_type, CAST(n_nationkey AS BIGINT) AS pos
        FROM {nation}
        UNION ALL
        SELECT concat('kb_',n_regionkey), concat('folder_n',n_nationkey,'_',c_mktsegment),
               concat('folder_n',n_nationkey), c_mktsegment, 99,
               CAST(length(c_mktsegment) AS BIGINT)*100 + CAST(ascii(substring(c_mktsegment,1,1)) AS BIGINT)
        FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}) c JOIN {nation} ON c_nationkey=n_nationkey
        UNION ALL
        SELECT concat('kb_',n_regionkey), concat('folder_c',c_custkey),
               concat('folder_n',n_nationkey,'_',c_mktsegment), c_name, 99, CAST(c_custkey AS BIGINT)
        FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey
        UNION ALL
        SELECT kb_id, media_id, parent_folder_id, title, media_type, pos FROM ({fx_items}) items""",
    "fx_media": f"""
        SELECT concat('doc_',o_orderkey) AS media_id, {_ITEM_TYPE} AS media_type,
               CASE WHEN o_orderkey%4=0 THEN concat('nb_',o_orderkey) END AS notebook_id,
               CASE WHEN o_orderkey%4 IN (1,2)
                    THEN concat('https://h',o_custkey%10,'.example.com/f/',o_orderkey,'.PDF') END AS url,
               CASE WHEN o_orderkey%5=0 THEN NULL WHEN o_orderkey%2=0 THEN concat('',EPOCH(o_orderdate))
                    ELSE concat('',EPOCH(o_orderdate)*1000) END AS update_time
        FROM {{orders}} WHERE o_orderkey%50<>49""",
    "fx_index": """
        SELECT concat('doc_',o_orderkey) AS doc_id, concat('vault/',o_custkey,'/',o_orderkey,'.md') AS path,
               concat('kb_',o_custkey%5) AS kb_id, o_orderpriority AS title, 0 AS media_type,
               CASE WHEN o_orderkey%9=1 THEN concat('',EPOCH(o_orderdate)-86400)
                    WHEN o_orderkey%9=2 THEN concat('',EPOCH(o_orderdate))
                    WHEN o_orderkey%9=4 THEN concat('',EPOCH(o_orderdate)+86400) ELSE '' END AS update_time,
               '2024-01-01T00:00:00Z' AS synced_at
        FROM {orders} WHERE o_orderkey%3<>0""",
    "fx_items_dup": """
        SELECT concat('doc_',user_id) AS doc_id, event_id AS seq,
               CASE WHEN event_id%11=0 THEN 0 ELSE EPOCH(ts)-(event_id%7)*86400 END AS t,
               event_type<>'error' AS ok
        FROM {events}""",
    "fx_requests": """
        SELECT CAST(floor(event_id/5) AS BIGINT) AS request_id, CAST(event_id%5+1 AS INT) AS attempt,
               CASE event_type WHEN 'error' THEN CASE WHEN event_id%2=0 THEN 503 ELSE 429 END
                    WHEN 'view' THEN 403 WHEN 'purchase' THEN 200 WHEN 'signup' THEN 200 ELSE 500 END AS status,
               CASE event_type WHEN 'view' THEN CASE WHEN event_id%3=0 THEN '{{"code":200005,"msg":"quota"}}'
                                                     ELSE '{{"code":1,"msg":"denied"}}' END
                    WHEN 'purchase' THEN '{{"code":0,"msg":"ok"}}'
                    WHEN 'signup' THEN '{{"code":200005,"msg":"late"}}' ELSE NULL END AS payload, ts
        FROM {events}""",
    "fx_notes": """
        SELECT concat('',d.doc_id) AS docid,
               CASE WHEN d.text='' THEN '' ELSE concat(d.source,' "',d.lang,'" ',d.n_chars%1000) END AS title, concat('',m.s*1000) AS modify_time,
               d.source AS folder_name, d.text AS content
        FROM {documents} d
        JOIN (SELECT user_id, EPOCH(max(ts)) AS s FROM {events} GROUP BY user_id) m ON m.user_id=d.doc_id%15""",
    "fx_pages20": """
        SELECT listing_id, page_no, docid, pos, page_no>=last_page-listing_no%3 AS is_end,
               page_no>=last_page-listing_no%2 AS no_cursor
        FROM (SELECT source AS listing_id, CAST(floor((n-1)/20) AS INT) AS last_page,
                     CAST(length(source)+ascii(substring(source,4,1)) AS INT) AS listing_no,
                     concat('',doc_id) AS docid, CAST(floor((rn-1)/20) AS INT) AS page_no,
                     CAST((rn-1)%20 AS INT) AS pos
              FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
                           count(*) OVER (PARTITION BY source) AS n
                    FROM {documents}) a) b""",
    "fx_chain": """
        SELECT listing_id, page_no, pos, docid,
               CASE WHEN page_no=0 THEN '' ELSE md5(concat(listing_id,'#',page_no)) END AS cursor,
               CASE WHEN page_no=last_page AND listing_no%4=1 THEN md5(concat(listing_id,'#1'))
                    WHEN page_no=last_page-1 AND listing_no%4=2 THEN md5(concat(listing_id,'#lost'))
                    WHEN page_no=last_page THEN '' ELSE md5(concat(listing_id,'#',page_no+1)) END AS next_cursor,
               page_no=last_page-2 AND listing_no%4=3 AS is_end
        FROM (SELECT source AS listing_id, CAST(floor((n-1)/4) AS INT) AS last_page,
                     CAST(length(source)+ascii(substring(source,4,1))+ascii(substring(source,5,1)) AS INT) AS listing_no,
                     concat('',doc_id) AS docid, CAST(floor((rn-1)/4) AS INT) AS page_no, CAST((rn-1)%4 AS INT) AS pos
              FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
                           count(*) OVER (PARTITION BY source) AS n
                    FROM {documents}) a) b""",
    "fx_fetched": """
        SELECT page_id, url, CASE page_id%20 WHEN 7 THEN 404 WHEN 13 THEN 503 ELSE 200 END AS status,
               CASE page_id%6 WHEN 5 THEN 'application/pdf' WHEN 4 THEN 'application/octet-stream'
                    ELSE 'Text/HTML; charset=utf-8' END AS content_type,
               CASE WHEN page_id%9=8 THEN '' ELSE html END AS text
        FROM {pages}""",
    "fx_images": """
        SELECT concat('wiki_',doc_id%3,'_',doc_id) AS doc_id,
               concat('![a',doc_id,'](https://img.example.com/',CAST(floor(doc_id/3) AS BIGINT),'.jpg) x ![](https://img.example.com/',
                      CAST(floor(doc_id/3) AS BIGINT),'.jpg) ![b](/rel/',doc_id%7,
                      '.gif?v=1) <img class="z" src="data:image/png;base64,aGk="> <img src="https://img.example.com/',
                      CAST(floor((doc_id+1)/3) AS BIGINT),'">', chr(10), text) AS content
        FROM {documents}""",
    "fx_image_blobs": """
        SELECT concat('https://img.example.com/',i,CASE WHEN i%2=0 THEN '.jpg' ELSE '' END) AS url,
               CASE WHEN i%4=0 THEN 'image/webp' ELSE '' END AS content_type
        FROM (SELECT DISTINCT CAST(floor(doc_id/3) AS BIGINT) AS i FROM {documents}) q WHERE i%5<>0""",
    "fx_docs_md": """
        SELECT concat('',doc_id) AS doc_id,
               CASE doc_id%4
                    WHEN 0 THEN concat('---',chr(10),'title: "t"',chr(10),'mine: 1',chr(10),'---',chr(10),chr(10),text)
                    WHEN 1 THEN concat('---',chr(13),chr(10),'tags: []',chr(13),chr(10),'--- ',chr(13),chr(10),text)
                    WHEN 2 THEN concat('---',chr(10),text)
                    ELSE concat(text,chr(10),chr(10),chr(10),chr(10),'  tail  ',chr(10)) END AS content
        FROM {documents}""",
}

# Answers a whole run needs beside the listings: a note text or a fetched page where
# the customer number finds one, otherwise nothing or a file.
FX["fx_contents"] = """
        SELECT concat('nb_',o_orderkey) AS doc_id, d.text AS content
        FROM {orders} JOIN {documents} d ON d.doc_id=o_custkey WHERE o_orderkey%4=0"""
FX["fx_downloads"] = """
        SELECT concat('https://h',o_custkey%10,'.example.com/f/',o_orderkey,'.PDF') AS url,
               CASE o_orderpriority WHEN '1-URGENT' THEN 404 WHEN '2-HIGH' THEN 503 ELSE 200 END AS status,
               CASE WHEN p.page_id IS NOT NULL THEN 'Text/HTML; charset=utf-8'
                    WHEN o_orderstatus='F' THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type,
               coalesce(p.html, '') AS text
        FROM {orders} LEFT JOIN {pages} p ON p.page_id=o_custkey WHERE o_orderkey%4 IN (1,2)"""

# The same rows for Spark: a remainder of 15 meets 29 users at most, so these are sent to the
# documents and no text is moved to them.
_SPARK = {
    "fx_notes": [
        ("SELECT concat('',d.doc_id)", "SELECT /*+ BROADCAST(m) */ concat('',d.doc_id)"),
        ("FROM {events} GROUP BY", "FROM {events} WHERE user_id BETWEEN -14 AND 14 GROUP BY"),
    ]
}


def _spelled_out(name: str, table_of, epoch: str, changes: list[tuple[str, str]] = []) -> str:
    names = {t: table_of(t) for t in TABLES}
    names["fx_items"] = ""
    body = FX[name]
    for old, new in changes:
        body = body.replace(old, new)
    if "{fx_items}" in body:
        names["fx_items"] = _spelled_out("fx_items", table_of, epoch)
    return _with_epoch(body.format(**names), epoch)


def _with_epoch(sql: str, template: str) -> str:
    """Replace ``EPOCH(x)``, where x may hold one level of parentheses."""
    return re.sub(r"EPOCH\(((?:[^()]|\([^()]*\))*)\)", lambda m: template.format(m.group(1)), sql)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived relation as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spelled_out(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", "unix_timestamp({0})", _SPARK.get(name, []))
    return spark.sql(sql)


def check_cte(*names: str) -> str:
    """The derived relations as the ``WITH`` list of a checking query."""
    parts = [
        f"{name} AS ({_spelled_out(name, lambda t: t, 'CAST(floor(epoch({0})) AS BIGINT)')})" for name in names
    ]
    return ", ".join(parts)
