"""DuckDB SQL for the rows of the queries that SQL can express."""

from reviewlens.llm.chat import CONTROLS, END, TEXT, TURN

ORACLES: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["op5_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), ''))
         AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.key = f.key
GROUP BY doc_id
"""

_WORDS = rf"""
words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(
          translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
)"""

ORACLES["op9_decontamination"] = rf"""
WITH {_WORDS}, item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM item_words
        WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
lists AS (
  SELECT doc_id, list(word ORDER BY pos) AS w FROM words GROUP BY doc_id
), places AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM lists, sizes)
), hits AS (
  SELECT doc_id, k, places.size, item_id FROM places JOIN windows USING (size, phrase)
), hit_words AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS pos
  FROM (SELECT DISTINCT doc_id, k, size FROM hits)
), by_doc AS (
  SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id
), by_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN lists USING (doc_id) LEFT JOIN by_doc USING (doc_id)
LEFT JOIN by_item USING (doc_id)
"""

ORACLES["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS to_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.to_id = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
       min(to_id) AS component_id, e.vec_id = min(to_id) AS kept
FROM embeddings e JOIN reach USING (vec_id) GROUP BY e.vec_id
"""

ORACLES["op2_minhash_dedup"] = rf"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM lists
        WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS to_id FROM lists
  UNION
  SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.to_id = ways.a
)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, min(to_id) AS component_id,
       l.doc_id = min(to_id) AS kept
FROM lists l JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id)
GROUP BY l.doc_id, n
"""

ORACLES["op4_substring_dedup"] = rf"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, md5(array_to_string(w[k : k + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM lists WHERE len(w) >= 13)
), hits AS (
  SELECT doc_id, k
  FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS least FROM windows)
  WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM hits
), words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM lists
)
SELECT l.doc_id, len(any_value(w)) AS n_words, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE g.pos IS NULL), ''))
         AS kept_sha256
FROM lists l LEFT JOIN words USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = words.pos
GROUP BY l.doc_id
"""


def _escaped_length(column: str) -> str:
    """Code points of a text after escaping: one more for each backslash and control string."""
    counts = [
        f"(length({column}) - length(replace({column}, '{c}', ''))) / {len(c)}" for c in ["\\", *CONTROLS]
    ]
    return f"length({column}) + CAST({' + '.join(counts)} AS BIGINT)"


ORACLES["op10_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                         FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(TEXT) + len(END) + 1} + {_escaped_length('role')}
           + {_escaped_length('text')})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
