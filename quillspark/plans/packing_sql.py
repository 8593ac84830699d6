"""SQL twins of segment packing: sentences, oversized units and the greedy fold, the folds as recursive queries over units."""

from __future__ import annotations

from quillspark.functions import text
from quillspark.operators import packing as P

_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_PROTECT = "(^|[^A-Za-z0-9_])(" + "|".join(text.ABBREVIATIONS) + r")\."


def sentences(column: str) -> str:
    """F8: the list of a text's sentences."""
    return f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({column}, '{_PROTECT}', '\\1\\2' || chr(57344), 'g'),
'([.!?])\\s+([A-Z"“''‘—])', '\\1' || chr(57345) || '\\2', 'g'), chr(57344), '.', 'g'), chr(57345)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"""


def units(source: str, key: str) -> str:
    """CTEs after ``source`` (key, text): F9's ``unit`` (key, u, piece, w), the units of each text in order. Names begin with the source's."""
    s, most = source, P.HARD_MOST
    return f"""
{s}_sized AS (SELECT {key}, text, {_WORDS.format('text')} AS w FROM {source}),
{s}_clause AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS c, clause, {_WORDS.format('clause')} AS w FROM (
  SELECT {key}, unnest(range(len(parts))) AS i, trim(unnest(parts)) AS clause FROM (SELECT {key}, string_split(regexp_replace(text, '([,;:—–])\\s+', '\\1' || chr(57346), 'g'), chr(57346)) AS parts FROM {s}_sized WHERE w > {most})) WHERE clause <> ''),
{s}_fold AS (  -- clause by clause: the unit it falls in, words held after it, the first unit behind it
  SELECT {key}, 0::BIGINT AS c, 0::BIGINT AS held, 0::BIGINT AS u, 0::BIGINT AS next FROM {s}_sized WHERE w > {most}
  UNION ALL
  SELECT f.{key}, x.c, CASE WHEN x.w > {most} THEN 0 WHEN f.held > 0 AND f.held + x.w > {most} THEN x.w ELSE f.held + x.w END,
    CASE WHEN f.held > 0 AND f.held + x.w <= {most} THEN f.u ELSE f.next END,
    CASE WHEN x.w > {most} THEN f.next + (x.w + {most - 1}) // {most} WHEN f.held > 0 AND f.held + x.w <= {most} THEN f.next ELSE f.next + 1 END
  FROM {s}_fold f JOIN {s}_clause x ON x.{key} = f.{key} AND x.c = f.c + 1),
{s}_placed AS (SELECT x.*, f.u FROM {s}_clause x JOIN {s}_fold f USING ({key}, c)),
{s}_unit AS (
  SELECT {key}, 0::BIGINT AS u, text AS piece FROM {s}_sized WHERE w <= {most}
  UNION ALL SELECT {key}, u, string_agg(clause, ' ' ORDER BY c) FROM {s}_placed WHERE w <= {most} GROUP BY {key}, u
  UNION ALL SELECT {key}, u + k, array_to_string(list_filter(regexp_split_to_array(clause, '\\s+'), lambda t: t <> '')[k * {most} + 1 : (k + 1) * {most}], ' ')
    FROM (SELECT *, unnest(range((w + {most - 1}) // {most})) AS k FROM {s}_placed WHERE w > {most}))"""


def segments(blocks: str) -> str:
    """CTEs after ``blocks`` (ch, b, kind, line): WN17's ``seg`` (ch, segment_index, raw_text, n_words, is_scene_break)."""
    short, keep = P.SHORT_DIALOGUE, P.KEEP_DIALOGUE
    return f"""
seen AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t, lead(kind) OVER (PARTITION BY ch ORDER BY b) AS next_kind, {_WORDS.format("lead(coalesce(line, '')) OVER (PARTITION BY ch ORDER BY b)")} AS next_w FROM {blocks}),
alone AS (SELECT ch, b, 0::BIGINT AS s, 0::BIGINT AS u, t AS piece, CASE WHEN regexp_full_match(t, '(\\*\\s*){{3,}}|---|___') THEN 'break' ELSE 'heading' END AS what FROM seen WHERE t <> '' AND (regexp_full_match(t, '(\\*\\s*){{3,}}|---|___') OR kind = 'heading')),
said AS (SELECT ch, b, kind, next_kind, next_w, {sentences("t")} AS list FROM seen WHERE t <> '' AND NOT regexp_full_match(t, '(\\*\\s*){{3,}}|---|___') AND kind <> 'heading'),
one AS (SELECT row_number() OVER () AS id, ch, b, s, text FROM (SELECT ch, b, unnest(range(len(list))) AS s, unnest(list) AS text FROM said)),
{units("one", "id")},
line_up AS (
  SELECT ch, b, s, u, piece, {_WORDS.format("piece")} AS w, kind AS what, next_kind, next_w FROM one_unit JOIN one USING (id) JOIN said USING (ch, b)
  UNION ALL SELECT ch, b, s, u, piece, {_WORDS.format("piece")}, what, NULL, NULL FROM alone),
numbered_units AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY b, s, u) AS n, row_number() OVER (PARTITION BY ch, b ORDER BY s DESC, u DESC) = 1 AS ends FROM line_up),
pack AS (
  SELECT ch, 0::BIGINT AS n, 0::BIGINT AS cur, true AS lead, false AS flush_before, false AS flush_after FROM (SELECT DISTINCT ch FROM numbered_units)
  UNION ALL
  SELECT ch, n, CASE WHEN flush_after THEN 0 ELSE total END, lead AND NOT flushed AND NOT (flush_after AND what <> 'heading'), flushed, flush_after FROM (
    SELECT *, CASE WHEN what = 'break' THEN false WHEN what = 'heading' OR w >= {P.HARD_MOST} THEN true
      WHEN ends AND NOT coalesce(next_kind = 'dialogue' AND next_w < {keep} AND total + next_w <= CASE WHEN lead AND NOT flushed THEN {P.LEAD_IN} ELSE {P.MOST} END, false)
        THEN total >= CASE WHEN lead AND NOT flushed THEN {P.LEAD_IN} ELSE {P.TARGET} END ELSE false END AS flush_after FROM (
      SELECT *, CASE WHEN what = 'break' THEN 0 ELSE w + CASE WHEN flushed THEN 0 ELSE cur END END AS total FROM (
        SELECT x.*, p.cur, p.lead, p.cur > 0 AND (x.what IN ('break', 'heading') OR (NOT (x.what = 'dialogue' AND x.w < {short})
          AND ((p.cur + x.w > CASE WHEN p.lead THEN {P.LEAD_IN} ELSE {P.MOST} END AND p.cur >= CASE WHEN p.lead THEN 1 ELSE {P.LEAST} END) OR x.w >= {P.HARD_MOST}))) AS flushed
        FROM pack p JOIN numbered_units x ON x.ch = p.ch AND x.n = p.n + 1)))),
marked AS (SELECT x.ch, x.n, x.piece, x.what, p.flush_before, coalesce(lag(p.flush_after) OVER o, false) AS after_flush, coalesce(lead(p.flush_before AND x.what = 'break') OVER o, false) AS breaks FROM numbered_units x JOIN pack p USING (ch, n) WINDOW o AS (PARTITION BY x.ch ORDER BY x.n)),
grouped AS (SELECT *, 1 + sum(CAST((flush_before AND what <> 'break') OR after_flush OR held_break AS INTEGER)) OVER (PARTITION BY ch ORDER BY n) AS g FROM (
  SELECT *, coalesce(lag(breaks) OVER (PARTITION BY ch ORDER BY n), false) AS held_break FROM marked WHERE what <> 'break')),
seg AS (SELECT ch, CAST(row_number() OVER (PARTITION BY ch ORDER BY g) AS INTEGER) AS segment_index, raw_text, CAST({_WORDS.format("raw_text")} AS BIGINT) AS n_words, is_scene_break FROM (
  SELECT ch, g, string_agg(piece, ' ' ORDER BY n) AS raw_text, bool_or(breaks) AS is_scene_break FROM grouped GROUP BY ch, g))"""
