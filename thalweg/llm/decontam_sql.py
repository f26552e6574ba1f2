"""The SQL of op9_decontaminate: the same templates by patterns without look-around, all windows compared word by word."""

from . import decontam as d

_TAGS = f"'{d.NUMBER}', '{d.NAME}', '{d.UNIT}'"
_UNIT = rf"([0-9]){d.SPACE}*((?i:{d.UNITS}))([^\p{{L}}]|$)"


def _twice(text: str, pattern: str, by: str) -> str:
    """Matches that end where the next one begins hide it, so every second one of a run is left to the second time."""
    return f"regexp_replace(regexp_replace({text}, '{pattern}', '{by}', 'g'), '{pattern}', '{by}', 'g')"


def _words(text: str) -> str:
    joined = _twice(_twice(text, _UNIT, rf"\1 {d.UNIT}\2 \3"), "([0-9])[.,:/]([0-9])", rf"\1{d.JOINT}\2")
    tagged = f"regexp_replace({joined}, '([0-9][0-9{d.JOINT}]*)', ' {d.NUMBER}\\1 ', 'g')"
    return f"list_filter(string_split_regex({tagged}, '[^\\p{{L}}\\p{{Nd}}{d.NUMBER}-{d.JOINT}]+'), lambda w: w <> '')"


def _readings(table: str, key: str) -> str:
    """(reading, key, tagged): the words of each reading, values behind their tags."""
    named = f"list_transform(words, lambda w: CASE WHEN regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}') THEN concat('{d.NAME}', lower(w)) ELSE lower(w) END)"
    return f"""
  SELECT {d.NAMES} AS reading, {key}, {named} AS tagged FROM (SELECT {key}, {_words("coalesce(text, '')")} AS words FROM {table} WHERE {key} IS NOT NULL)
  UNION ALL SELECT {d.LOWER}, {key}, list_transform(words, lambda w: lower(w)) FROM (SELECT {key}, {_words("coalesce(text, '')")} AS words FROM {table} WHERE {key} IS NOT NULL)
  UNION ALL SELECT {d.PLAIN}, {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '') FROM {table} WHERE {key} IS NOT NULL"""


def _windows(source: str, key: str, k: str) -> str:
    """(reading, k, key, at, words, vals) of the readings' windows of k words."""
    fits = f"k > 0 AND len(tagged) >= k AND (reading <> {d.PLAIN} OR k >= {d.PLAIN_WORDS} OR len(tagged) = k)"
    return f"""
  SELECT reading, k, {key}, i AS at, list_slice(template, i, i + k - 1) AS words, list_slice(tagged, i, i + k - 1) AS vals
  FROM (SELECT reading, k, {key}, tagged, unnest(generate_series(1, len(tagged) - k + 1)) AS i,
               list_transform(tagged, lambda w: CASE WHEN left(w, 1) IN ({_TAGS}) THEN left(w, 1) ELSE w END) AS template
        FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM {source}) WHERE {fits})"""


OP9_SQL = f"""
WITH own AS (SELECT * FROM ({_windows(f"({_readings('benchmark', 'item_id')})", "item_id", f"CASE WHEN reading = {d.PLAIN} THEN len(tagged) ELSE least({d.WINDOW}, len(tagged)) END")})
  WHERE CASE WHEN reading = {d.PLAIN} THEN len(list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}'))) > 0 ELSE len(list_filter(words, lambda w: w NOT IN ({_TAGS}))) >= {d.LITERALS} AND k >= {d.PLAIN_WORDS} END),
items AS (SELECT * FROM own WHERE reading <> {d.PLAIN} OR item_id NOT IN (SELECT item_id FROM own WHERE reading <> {d.PLAIN})),
docs AS (SELECT * FROM ({_windows(f"(SELECT * FROM ({_readings('documents', 'doc_id')}) JOIN (SELECT DISTINCT reading, k AS asked FROM items) USING (reading))", "doc_id", "asked")})),
matched AS (SELECT reading, doc_id, item_id, b.at AS q, a.at - b.at AS off, b.vals AS asked, a.vals AS found FROM docs a JOIN items b USING (reading, k, words)),
sizes AS (SELECT reading, item_id, count(*) AS n_windows FROM items GROUP BY 1, 2),
whole AS (SELECT reading, doc_id, item_id, n_windows, count(DISTINCT q) AS n_matched FROM matched JOIN sizes USING (reading, item_id) GROUP BY 1, 2, 3, 4),
best AS (
  SELECT reading, doc_id, item_id, off FROM (SELECT reading, doc_id, item_id, off, count(DISTINCT q) AS n FROM matched GROUP BY 1, 2, 3, 4)
  QUALIFY row_number() OVER (PARTITION BY reading, doc_id, item_id ORDER BY n DESC, off) = 1),
slots AS (
  SELECT DISTINCT reading, doc_id, item_id, asked, found
  FROM (SELECT reading, doc_id, item_id, unnest(asked) AS asked, unnest(found) AS found FROM matched JOIN best USING (reading, doc_id, item_id, off))
  WHERE reading <> {d.PLAIN} AND left(asked, 1) IN ({_TAGS})),
judged AS (SELECT reading, doc_id, item_id, count(DISTINCT asked) AS n_slots, count(*) AS n_values, bool_and(asked = found) AS verbatim FROM slots GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_matched AS BIGINT) AS n_matched, n_matched / n_windows AS similarity,
       CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, coalesce(verbatim, true) AS verbatim
FROM whole LEFT JOIN judged USING (reading, doc_id, item_id)
WHERE n_matched / n_windows >= {d.SIMILARITY} AND coalesce(n_slots = n_values, true)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY reading) = 1
"""
