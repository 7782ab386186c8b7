"""DuckDB SQL of the queries on conversations, licence texts and sales."""

from __future__ import annotations

# DuckDB has no crc32: a table of 256 remainders made by rule, and a fold over the characters' codes (ASCII only).
_CRC_TABLE = """
crc_table AS (
  SELECT list(CAST(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS BIGINT) ORDER BY i) AS t
  FROM range(256) AS r(i))
"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295)"


# A way is its cost in nine digits and its audit, so the least text is the cheapest way and of equal costs the first in ASCII order.
def _edit(way: str, cost: str, letter: str) -> str:
    return f"(lpad(CAST(CAST(substr({way}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}')"


_NEVER = "'999999000'"
_OPEN_USER = f"least(u, {_edit('z', '2', 'I')}, {_edit('s', '2', 'I')}, {_edit('a', '2', 'I')})"


def _emitted(source: str, initial: str) -> str:
    return f"CASE WHEN gone THEN {_NEVER} WHEN initial = '{initial}' THEN {_edit(source, 'cut', 'K')} ELSE {_edit(source, 'cut + 2', 'R')} END"


OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE d <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
flagged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY c ORDER BY place) || initial AS pair
  FROM placed),
turns AS (SELECT c, place, initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM flagged),
fold(c, place, z, s, u, a) AS (
  SELECT c, CAST(0 AS BIGINT), '000000000', {_NEVER}, {_NEVER}, {_NEVER} FROM ids
  UNION ALL
  SELECT c, place, {_edit('z', '3', 'D')},
         least({_edit('s', '3', 'D')}, CASE WHEN NOT gone AND initial = 's' THEN {_edit('z', 'cut', 'K')} ELSE {_NEVER} END),
         least({_edit('u', '3', 'D')}, {_emitted('least(z, s, a)', 'u')}),
         least({_edit('a', '3', 'D')}, {_emitted('u', 'a')})
  FROM (SELECT c, place, initial, gone, cut, z, s, u, least(a, {_edit('u', '2', 'I')}) AS a
        FROM (SELECT f.c, t.place, t.initial, t.gone, t.cut, z, s, {_OPEN_USER} AS u, a
              FROM fold f JOIN turns t ON t.c = f.c AND t.place = f.place + 1))),
ends AS (
  SELECT c, least(z, a, {_edit(_OPEN_USER, '2', 'I')}) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY place DESC) AS back FROM fold) WHERE back = 1),
letters AS (
  SELECT c, k, substr(best, CAST(9 + k AS INTEGER), 1) AS letter
  FROM (SELECT c, best, unnest(range(1, length(best) - 8)) AS k FROM ends)),
counted AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY c ORDER BY k) AS used,
         count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY c ORDER BY k) AS written
  FROM letters),
joined AS (
  SELECT x.c, k, letter, written, p.role, p.text, p.initial,
         max(CASE WHEN letter = 'K' AND written = 1 AND p.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.c) AS led
  FROM counted x LEFT JOIN placed p ON p.c = x.c AND p.place = used AND letter <> 'I' WHERE letter <> 'D'),
made AS (
  SELECT c, string_agg((CASE WHEN letter = 'K' THEN role WHEN (written - led) % 2 = 1 THEN 'user' ELSE 'assistant' END)
                       || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS repaired
  FROM joined GROUP BY c),
sums AS (
  SELECT c, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flagged GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(substr(best, 1, 9) AS BIGINT) AS cost,
       substr(best, 10) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids JOIN ends USING (c) LEFT JOIN sums USING (c) LEFT JOIN made USING (c)
"""


# Cents and unit prices of the data are positive, so integer division is a floor.
OP13 = rf"""
WITH {_CRC_TABLE},
l AS (
  SELECT sale_id, line_no, item_id AS line_item_id, (2 * a + quantity) // (2 * quantity) AS u,
         {_crc("CAST(sale_id AS VARCHAR) || ',' || coalesce(CAST(line_no AS VARCHAR), '') || ',' || CAST(item_id AS VARCHAR)")} AS crc
  FROM (SELECT *, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a FROM sale_lines
        WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL), crc_table),
i AS (SELECT row_number() OVER () AS k, item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
pairs AS (
  SELECT k, item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc
  FROM i JOIN l ON u BETWEEN p - greatest(50, p) AND p + greatest(50, p)
  WHERE line_item_id <> item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))),
sums AS (SELECT k, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS lines_crc FROM pairs GROUP BY k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM pairs QUALIFY rank <= 10)
SELECT i.item_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, gap, u, sale_id, CAST(line_no AS BIGINT) AS line_no, line_item_id,
       coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN sums USING (k) LEFT JOIN ranked USING (k)
"""
