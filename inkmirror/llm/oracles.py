"""SQL twins of the text operators that SQL can express, for an independent database."""

from __future__ import annotations

from .licenses import TEMPLATES

# crc32 of a short ASCII text: its bytes by eight shifts each
CRC32 = """xor(4294967295::UBIGINT, list_reduce(
  list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT),
  lambda state, byte: list_reduce(range(8), lambda r, bit: xor(r >> 1, 3988292384::UBIGINT * (r & 1)), xor(state, byte)),
  4294967295::UBIGINT))"""


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CRC = CRC32.format("CAST(doc_id AS VARCHAR)")

OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS width
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf,
               CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS claimed
        FROM documents)
), low AS (
  SELECT tree, 0 AS level, place, width, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 16, (width + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM low WHERE width > 1 GROUP BY tree, level, width, place // 16
), high AS (
  SELECT 0 AS level, tree AS place, (SELECT count(DISTINCT tree) FROM leaves) AS width, h FROM low WHERE width = 1
  UNION ALL
  SELECT level + 1, place // 16, (width + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM high WHERE width > 1 GROUP BY level, width, place // 16
), climb AS (
  SELECT tree, place AS leaf_place, 0 AS level, place, width, claimed AS fold, '' AS proof FROM leaves
  UNION ALL
  SELECT p.tree, p.leaf_place, p.level + 1, p.place // 16, (p.width + 15) // 16,
         sha256(string_agg(CASE WHEN n.place = p.place THEN p.fold ELSE n.h END, '' ORDER BY n.place)),
         p.proof || string_agg(CASE WHEN n.place = p.place THEN '' ELSE n.h END, '' ORDER BY n.place)
  FROM climb p JOIN low n ON n.tree = p.tree AND n.level = p.level AND n.place // 16 = p.place // 16
  WHERE p.width > 1 GROUP BY p.tree, p.leaf_place, p.level, p.place, p.width, p.proof
), summit AS (
  SELECT tree, leaf_place, 0 AS level, tree AS place, (SELECT count(DISTINCT tree) FROM leaves) AS width, fold, proof
  FROM climb WHERE width = 1
  UNION ALL
  SELECT p.tree, p.leaf_place, p.level + 1, p.place // 16, (p.width + 15) // 16,
         sha256(string_agg(CASE WHEN n.place = p.place THEN p.fold ELSE n.h END, '' ORDER BY n.place)),
         p.proof || string_agg(CASE WHEN n.place = p.place THEN '' ELSE n.h END, '' ORDER BY n.place)
  FROM summit p JOIN high n ON n.level = p.level AND n.place // 16 = p.place // 16
  WHERE p.width > 1 GROUP BY p.tree, p.leaf_place, p.level, p.place, p.width, p.proof
), root AS (SELECT h FROM high WHERE width = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.fold AS folded_root, f.fold = r.h AS verified
FROM leaves l JOIN summit f ON f.tree = l.tree AND f.leaf_place = l.place AND f.width = 1
JOIN low s ON s.tree = l.tree AND s.width = 1 CROSS JOIN root r
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11 = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents
), postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), weighted AS (
  SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM asked JOIN frequency USING (term) CROSS JOIN totals
), scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM weighted JOIN postings USING (term) JOIN lengths USING (doc_id) CROSS JOIN totals GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

_TEXTS = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(TEMPLATES))
_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH held AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
texts(template, label, text) AS (VALUES {_TEXTS}),
known AS (SELECT template, label, {_WORDS} AS w FROM texts),
mine AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS a FROM held),
grams AS (
  SELECT doc_id, pos, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM mine WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), theirs AS (
  SELECT template, label, len(w) AS size, i AS place, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c
  FROM known, unnest(range(len(w) - 2)) AS r(i)
), votes AS (
  SELECT doc_id, template, label, size, pos - place AS diagonal, pos, place FROM grams JOIN theirs USING (a, b, c)
), diagonals AS (
  SELECT doc_id, template, diagonal, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS former
  FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes)
), spans AS (
  SELECT doc_id, template, diagonal,
         sum(CASE WHEN former IS NULL OR diagonal - former > 4 THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM diagonals
), merged AS (
  SELECT doc_id, template, label, size, span, min(pos) AS first, max(pos) + 2 AS last, count(DISTINCT place + k) AS covered
  FROM votes JOIN spans USING (doc_id, template, diagonal), unnest([0, 1, 2]) AS u(k) GROUP BY ALL
), verified AS (
  SELECT * FROM merged WHERE (covered >= 0.75 * size OR covered >= 40) AND covered >= 0.75 * (last - first + 1)
), opened AS (
  SELECT *, CASE WHEN first > coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY first, last, template
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS opens
  FROM verified
), islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY first, last, template ROWS UNBOUNDED PRECEDING) AS island FROM opened),
best AS (
  SELECT *, rank() OVER (PARTITION BY doc_id, island ORDER BY covered DESC, size) AS place FROM islands
), found AS (
  SELECT doc_id, list_distinct(list(label)) AS more, max(covered / size) AS score FROM best WHERE place = 1 GROUP BY doc_id
), phrases AS (
  SELECT doc_id, pos, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache'
    WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label
  FROM grams
), based AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS base
  FROM phrases WHERE label IS NOT NULL GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END, coalesce(score, 0.0))::DOUBLE AS score
FROM held LEFT JOIN based USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES = {"op13_license_scan": OP13, "op11_ranked_search": OP11, "op12_merkle_manifest": OP12}
