"""The same results as DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op3_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '\### Assistant: </turn> ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS own (turn, role)
), escaped AS (
  SELECT *,
    length(replace(replace(role, '\', '\b'), '<', '\l')) AS role_chars,
    length(replace(replace(text, '\', '\b'), '<', '\l')) AS text_chars,
    coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS opens
  FROM said
)
SELECT
  conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(6 + text_chars + CASE WHEN opens THEN 13 + role_chars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM escaped
GROUP BY conv_id
"""

# The measures of one document, its id being row_number, so that repeated ids stay apart.
_MEASURED = rf"""
numbered AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    {WORDS.format('text')} AS words
  FROM documents
), lines AS (
  SELECT r, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM (
    SELECT r, line, count(*) AS n
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
  ) GROUP BY r
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM numbered)
), repeated AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT r, unnest(range(i, i + 5)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
  ) GROUP BY r
), measured AS (
  SELECT d.r, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM numbered d LEFT JOIN lines l ON d.r = l.r LEFT JOIN repeated p ON d.r = p.r
)"""

ORACLE["op4_host_rules"] = rf"""
WITH {_MEASURED}, failures AS (
  SELECT host, rule, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS f FROM (
    SELECT host, unnest(['short', 'repeats', 'lines', 'symbols']) AS rule,
      unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words,
              100 * n_dup_lines > 50 * n_words, 100 * n_symbols > 200 * n_words]) AS failed
    FROM measured
  ) GROUP BY host, rule
), moments AS (
  SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(f) / sum(n) AS mean,
    sum(f * f / n) AS squares, sum(n * n) AS sizes
  FROM failures GROUP BY rule
), priors AS (
  SELECT rule, mean, greatest(mean * (1 - mean) / greatest(
      (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean))
      / greatest(docs - sizes / docs - (hosts - 1), 1.0), 1e-6) - 1, 1.0) AS strength
  FROM moments
), rates AS (
  SELECT host, n, strength, (f + mean * strength) / (n + strength) AS rate
  FROM failures JOIN priors USING (rule)
), bad AS (
  SELECT DISTINCT host FROM rates
  WHERE rate - 3.0 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND host NOT IN (SELECT host FROM bad) AS kept
FROM measured
"""

ORACLE["op11_exact_dedup"] = r"""
WITH normalised AS (
  SELECT row_number() OVER () AS r, doc_id,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER ids AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER ids = 1 AS kept,
  text_sha256
FROM normalised
WINDOW ids AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r)
"""

_TERMS = r"""unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

ORACLE["op12_lexical_search"] = rf"""
WITH asked AS (
  SELECT r, item_id, term, count(*) AS times
  FROM (SELECT r, item_id, {_TERMS} FROM (SELECT row_number() OVER () AS r, * FROM benchmark))
  GROUP BY r, item_id, term
), found AS (
  SELECT r, doc_id, term, count(*) AS tf
  FROM (SELECT r, doc_id, {_TERMS} FROM (SELECT row_number() OVER () AS r, * FROM documents))
  GROUP BY r, doc_id, term
), sizes AS (
  SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY r
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM found, totals WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
  SELECT a.r AS item, a.item_id, f.r, f.doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l)))) AS BIGINT) AS score
  FROM asked a JOIN found f USING (term) JOIN weights USING (term) JOIN sizes s ON s.r = f.r, totals
  GROUP BY a.r, a.item_id, f.r, f.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 10
"""

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The CRC-32 is that of
# the polynomial 0xEDB88320, its table made by rule. A repair is compared by cost, then audit, which determine its text.
ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(
      list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 20 AS kind
  FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS copies (copy)
  WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged
), marked AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), inserted (state, between_state, letters, given) AS (
  VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []),
    (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
    (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])
), edited (between_state, next_state, letter, initial, given) AS (
  VALUES (0, 0, 'D', '', ''), (1, 1, 'D', '', ''), (2, 2, 'D', '', ''), (3, 3, 'D', '', ''),
    (0, 1, 'K', 's', ''), (0, 2, 'K', 'u', ''), (1, 2, 'K', 'u', ''), (3, 2, 'K', 'u', ''), (2, 3, 'K', 'a', ''),
    (0, 2, 'R', 'u', 'user'), (1, 2, 'R', 'u', 'user'), (3, 2, 'R', 'u', 'user'), (2, 3, 'R', 'a', 'assistant')
), best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state,
    {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])} AS way
  FROM conversations
  UNION ALL
  SELECT b.conv_id, m.i, next_state, min({
    'cost': CAST(way.cost + 2 * length(letters)
      + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
      + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS BIGINT),
    'audit': way.audit || letters || letter,
    'said': list_concat(way.said, n.given, CASE letter WHEN 'D' THEN CAST([] AS VARCHAR[])
      WHEN 'K' THEN [m.role || ':' || text] ELSE [e.given || ':' || text] END)})
  FROM best b
  JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1
  JOIN inserted n ON n.state = b.state
  JOIN edited e ON e.between_state = n.between_state
    AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
    AND (letter = 'D' OR (letter = 'K') = (e.initial = m.initial))
  GROUP BY b.conv_id, m.i, next_state
), counted AS (
  SELECT conv_id, count(*) AS rows,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), ended AS (
  SELECT b.conv_id, min({'cost': CAST(way.cost + 2 * length(letters) AS BIGINT), 'audit': way.audit || letters,
    'said': list_concat(way.said, given)}) AS way
  FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
  JOIN inserted n ON n.state = b.state AND between_state IN (0, 3)
  WHERE i = coalesce(c.rows, 0) GROUP BY b.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit,
  sha256(array_to_string(way.said, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
