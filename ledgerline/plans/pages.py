"""Pages, glyphs and printed rows made from the star tables, as SQL for both engines, and DuckDB's way to the results of the operators on them."""

from __future__ import annotations

from ..functions import tables as t
from ..operators import layout as x
from ..operators import lines
from .invoices import ORDERED, duck

# --- a table of three columns a page: one row an item ------------------------------

CELLS = f"""SELECT doc_id, 1 AS page_no, pos, k, text, x0, CAST(x0 + 6 * length(text) AS DOUBLE) AS x1, CAST(12 * pos + k AS DOUBLE) AS top, CAST(12 * pos + k + 8 AS DOUBLE) AS bottom FROM (
  SELECT doc_id, pos, 0 AS k, concat('P', CAST(part AS VARCHAR(20))) AS text, CAST(20 + part % 3 * 2 AS DOUBLE) AS x0 FROM ({ORDERED}) a
  UNION ALL SELECT doc_id, pos, 1 AS k, CAST(CAST(q AS INT) AS VARCHAR(20)) AS text, CAST(150 + part % 5 * 3 AS DOUBLE) AS x0 FROM ({ORDERED}) b
  UNION ALL SELECT doc_id, pos, 2 AS k, CAST(supp AS VARCHAR(20)) AS text, CAST(CASE WHEN part % 7 = 0 THEN 190 ELSE 300 + supp % 4 * 2 END AS DOUBLE) AS x0 FROM ({ORDERED}) c) d"""

#: Boundaries: an anchor is the least edge beyond the last anchor's band.
def _boundaries(cells: str, width: float) -> str:
    return f"""w AS MATERIALIZED (SELECT *, lead(x0) OVER line AS nxt, lag(x1) OVER line AS prev FROM ({cells}) cells WINDOW line AS (PARTITION BY doc_id, pos ORDER BY x0, x1)),
edges AS MATERIALIZED (SELECT doc_id, unnest([(x1 + nxt) / 2, nxt - {width}]) AS x FROM w WHERE nxt - x1 >= {width * x.GAP_WIDTHS}),
anchors AS (SELECT doc_id, min(x) AS a FROM edges GROUP BY doc_id UNION ALL SELECT anchors.doc_id, min(x) FROM anchors JOIN edges ON edges.doc_id = anchors.doc_id AND x > a + {2 * width} GROUP BY anchors.doc_id),
lines AS (SELECT doc_id, count(DISTINCT pos) AS n FROM w GROUP BY doc_id),
found AS (SELECT doc_id, list(DISTINCT mid ORDER BY mid) AS boundaries FROM (SELECT doc_id, round(avg(x), 1) AS mid, count(*) AS hits, any_value(n) AS n FROM anchors JOIN edges USING (doc_id) JOIN lines USING (doc_id) WHERE x BETWEEN a AND a + {2 * width} GROUP BY doc_id, a) bands
  WHERE hits >= greatest({x.RECUR_LEAST}, floor(n * {x.RECUR_SHARE})) GROUP BY doc_id)"""


def _drawn(width: float) -> str:
    """Lines of words set in columns. A word's column is the greatest of all starts before it moved on by what is written since: a running maximum instead of a fold."""
    return f"""placed AS (SELECT w.*, coalesce(x0 - prev >= {width * x.MARK_WIDTHS} AND len(list_filter(boundaries, lambda b: b BETWEEN prev AND x0)) > 0, false) AS mark, CAST(round_even(x0 / {width}, 0) AS BIGINT) AS col, coalesce(sum(length(text) + 1) OVER (PARTITION BY w.doc_id, pos ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM w LEFT JOIN found USING (doc_id)),
spots AS (SELECT *, moved + max(col - moved) OVER (PARTITION BY doc_id, pos ORDER BY x0, x1) AS start FROM placed),
gaps AS (SELECT *, coalesce(lag(start + length(text)) OVER (PARTITION BY doc_id, pos ORDER BY x0, x1), 0) AS used FROM spots),
drawn AS (SELECT doc_id, pos, string_agg(CASE WHEN mark AND (used + start) // 2 < start THEN repeat(' ', CAST((used + start) // 2 - used AS BIGINT)) || '{t.COLUMN_MARK}' || repeat(' ', CAST(start - (used + start) // 2 - 1 AS BIGINT)) ELSE repeat(' ', CAST(start - used AS BIGINT)) END || text, '' ORDER BY x0, x1) AS line FROM gaps GROUP BY doc_id, pos)"""


_PAGE_TEXT = """SELECT doc_id, md5('=================================== PAGE 1 OF 1 (' || doc_id || ') ===================================' || chr(10) || string_agg(rtrim(line), chr(10) ORDER BY pos)) AS h FROM drawn GROUP BY doc_id"""
BOUNDARIES_SQL = f"WITH RECURSIVE {_boundaries(duck(CELLS), x.CHAR_WIDTH)} SELECT doc_id, CAST(1 AS INTEGER) AS page_no, coalesce(array_to_string(list_transform(boundaries, lambda b: CAST(b AS VARCHAR)), ','), '') AS boundaries FROM lines LEFT JOIN found USING (doc_id)"
CANVAS_SQL = f"WITH RECURSIVE {_boundaries(duck(CELLS), x.CHAR_WIDTH)},\n{_drawn(x.CHAR_WIDTH)}\n{_PAGE_TEXT}"

# --- glyphs: some printed twice, some with a blank inside -----------------------------

GLYPHS = f"""SELECT doc_id, 1 AS page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, kind, i) AS INT) AS seq, CASE WHEN kind = 2 THEN ' ' ELSE substring(word, i, 1) END AS text, top, CAST(top + 8 AS DOUBLE) AS bottom, x0, CAST(CASE WHEN kind = 2 THEN x0 + 3 ELSE x0 + 5 END AS DOUBLE) AS x1 FROM (
  SELECT doc_id, pos, kind, i, word, CAST(pos * 12 + CASE WHEN kind = 1 THEN 0.5 + part % 4 ELSE 0 END AS DOUBLE) AS top, CAST(20 + 6 * i + CASE WHEN kind = 1 THEN 0.75 WHEN kind = 2 THEN 1.5 ELSE 0 END AS DOUBLE) AS x0
  FROM (SELECT doc_id, pos, part, concat('PART', CAST(part % 100 AS VARCHAR(20))) AS word FROM ({ORDERED}) o) w
  CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2) kinds CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) places
  WHERE i <= length(word) AND (kind = 0 OR (kind = 1 AND part % 2 = 0) OR (kind = 2 AND part % 3 = 0 AND i % 2 = 0))) g"""

#: One step a glyph of every page, with the last glyphs that stayed.
GLYPHS_SQL = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top, x0, seq) AS n, text = ' ' AS blank FROM ({duck(GLYPHS)}) glyphs),
walk AS (
  SELECT doc_id, n, true AS stays, [struct_pack(blank := blank, top := top, bottom := bottom, x0 := x0)] AS kept FROM g WHERE n = 1
  UNION ALL SELECT doc_id, n, NOT near, CASE WHEN near THEN kept ELSE list_append(kept, struct_pack(blank := blank, top := top, bottom := bottom, x0 := x0))[-{x.LOOK_BACK}:] END FROM (
    SELECT g.*, walk.kept, len(list_filter(walk.kept, lambda k: k.blank = g.blank AND abs(k.x0 - g.x0) <= {x.SAME_X} AND abs(k.top - g.top) <= greatest({x.SAME_X}, least(k.bottom - k.top, g.bottom - g.top) * {x.SAME_TOP_SHARE}))) > 0 AS near FROM walk JOIN g ON g.doc_id = walk.doc_id AND g.n = walk.n + 1) z),
single AS MATERIALIZED (SELECT g.*, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.n) AS place FROM g JOIN walk USING (doc_id, n) WHERE stays)
SELECT doc_id, count(*) AS n, string_agg(text, '' ORDER BY place) AS text FROM single s WHERE NOT (blank AND EXISTS (SELECT 1 FROM single o WHERE o.doc_id = s.doc_id AND NOT o.blank AND abs(o.place - s.place) <= {x.LOOK_BACK} AND abs(o.top - s.top) <= greatest(1.0, {x.SAME_TOP_SHARE} * (o.bottom - o.top)) AND least(s.x1, o.x1) - greatest(s.x0, o.x0) >= {x.INSIDE_SHARE} * (s.x1 - s.x0))) GROUP BY doc_id"""

#: The words of CELLS as glyphs, five points wide and one apart; whole lines printed twice, spaces on letters.
CELL_GLYPHS = f"""SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, k, kind, i) AS INT) AS seq, CASE WHEN kind = 2 THEN ' ' ELSE substring(text, i, 1) END AS text,
  CAST(top + CASE WHEN kind = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS top, CAST(top + 8 AS DOUBLE) AS bottom, CAST(x0 + 6 * (i - 1) + CASE WHEN kind = 1 THEN 0.5 WHEN kind = 2 THEN 1 ELSE 0 END AS DOUBLE) AS x0, CAST(x0 + 6 * (i - 1) + CASE WHEN kind = 1 THEN 5.5 WHEN kind = 2 THEN 4 ELSE 5 END AS DOUBLE) AS x1
  FROM ({CELLS}) c CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2) kinds CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10) places
  WHERE i <= length(text) AND (kind = 0 OR (kind = 1 AND (doc_id + pos) % 2 = 0) OR (kind = 2 AND pos % 3 = 0 AND i = 2))"""


def _single(glyphs: str) -> str:
    """Glyphs without doubles (`single`) and without spaces on letters (`shown`): one step a glyph of every page, with the last glyphs that stayed."""
    steps = GLYPHS_SQL[GLYPHS_SQL.index("g AS MATERIALIZED") :].replace(duck(GLYPHS), glyphs)
    steps, shown = steps[: steps.index("SELECT doc_id, count(*) AS n, string_agg")], steps[steps.index("FROM single s WHERE") : steps.rindex(" GROUP BY doc_id")]
    return f"{steps.rstrip()}, shown AS MATERIALIZED (SELECT s.* {shown})"


#: Words where letters follow each other, lines where tops do: islands, and not a walk with running means.
GLYPH_WORDS = f"""WITH RECURSIVE {_single(duck(CELL_GLYPHS))},
rows_ AS (SELECT *, sum(CASE WHEN falls THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY top, x0, seq) AS pos FROM (SELECT *, coalesce(top - lag(top) OVER (PARTITION BY doc_id ORDER BY top, x0, seq) > 3, true) AS falls FROM shown) f),
starts AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY x0) AS word FROM (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, pos ORDER BY x0) > {x.WORD_REACH}, true) AS apart FROM rows_) a)
SELECT doc_id, 1 AS page_no, pos, string_agg(text, '' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1 FROM starts GROUP BY doc_id, pos, word"""
GLYPH_CANVAS_SQL = f"WITH RECURSIVE cell_words AS MATERIALIZED ({GLYPH_WORDS}),\n{_boundaries('SELECT * FROM cell_words', 5.0)},\n{_drawn(5.0)}\n{_PAGE_TEXT}"

# --- ruled lines that run off a page ---------------------------------------------------

RULED = f"SELECT doc_id, 1 AS page_no, CASE WHEN part % 3 = 0 THEN 40 ELSE 0 END AS x1, CAST(part % 780 AS INT) AS y1, CAST(CASE WHEN part % 4 = 0 THEN 599 ELSE 300 + part % 100 END AS INT) AS x2, CAST(part % 780 + CASE WHEN part % 5 = 0 THEN 6 ELSE 0 END AS INT) AS y2, 600 AS width, 800 AS height FROM ({ORDERED}) o"
CLIPPED_SQL = f"""WITH s AS (SELECT *, row_number() OVER () AS line, degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) AS angle, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS size FROM ({duck(RULED)}) r),
main AS (SELECT doc_id, arg_max(bin, struct_pack(total := round(total, 6), low := -bin)) AS bin FROM (SELECT doc_id, round_even(angle, 0) AS bin, sum(size) AS total FROM s GROUP BY ALL) b GROUP BY doc_id),
ends AS (SELECT doc_id, line, unnest([struct_pack(x := x1, y := y1), struct_pack(x := x2, y := y2)]) AS e FROM s JOIN main USING (doc_id) WHERE round_even(angle, 0) = bin AND abs(angle) <= {x.PARALLEL}),
hits AS (SELECT doc_id, line, CASE WHEN e.x <= 3 THEN 'left' WHEN e.x >= 597 THEN 'right' END AS edge, avg(e.y) AS y FROM ends GROUP BY ALL),
apart AS (SELECT doc_id, edge, y - lag(y) OVER (PARTITION BY doc_id, edge ORDER BY y) AS step FROM hits WHERE edge IS NOT NULL)
SELECT doc_id, CAST(1 AS INTEGER) AS page_no, string_agg(edge, ',' ORDER BY edge) AS edges FROM (SELECT doc_id, edge FROM apart GROUP BY doc_id, edge HAVING count(*) FILTER (WHERE step IS NULL OR step > {x.LINE_GAP}) >= {x.EDGE_LINES}) z GROUP BY doc_id"""

# --- repeats of a bundle -----------------------------------------------------------------

BUNDLE = f"SELECT doc_id, pos, CASE WHEN part % 3 = 0 THEN 'STEEL VALVE BODY' WHEN part % 3 = 1 THEN 'QUARTZ LAMP' ELSE 'HYDRAULIC PUMP' END AS product_description, CAST(5 + part % 2 * 2 AS DOUBLE) AS quantity, CAST(2 AS DOUBLE) AS unit_price, CAST(10 + part % 2 * 4 AS DOUBLE) AS line_total FROM ({ORDERED}) o"
BUNDLE_TOTALS = f"SELECT doc_id, CAST(sum(line_total) - CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 10 WHEN doc_id % 4 = 2 THEN 24 ELSE 7 END AS DOUBLE) AS total FROM ({BUNDLE}) b GROUP BY doc_id"
BUNDLE_SQL = f"""WITH b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, product_description, quantity, line_total ORDER BY pos) > 1 AS twin, sum(line_total) OVER (PARTITION BY doc_id) AS whole FROM ({duck(BUNDLE)}) x),
docs AS (SELECT doc_id, whole, total, list(struct_pack(pos := pos, amount := line_total) ORDER BY pos) AS twins FROM b JOIN ({duck(BUNDLE_TOTALS)}) t USING (doc_id) WHERE twin AND total > 0 AND abs(whole - total) > 0.05 GROUP BY doc_id, whole, total),
sets AS (SELECT *, list_filter(range(0, len(twins)), lambda i: (m >> i) & 1 = 1) AS members FROM (SELECT *, unnest(range(1, 1 << len(twins))) AS m FROM docs) z),
best AS (SELECT doc_id, arg_min(list_transform(members, lambda i: twins[i + 1].pos), struct_pack(n := len(members), at := members)) AS gone FROM sets WHERE abs(whole - list_sum(list_transform(members, lambda i: twins[i + 1].amount)) - total) <= 0.05 GROUP BY doc_id)
SELECT b.doc_id, pos FROM b LEFT JOIN best USING (doc_id) WHERE gone IS NULL OR NOT list_contains(gone, pos)"""

# --- printed rows and what was made of them -----------------------------------------------

_PRINTED_ROW = "concat(CAST(pos AS VARCHAR(9)), ' │ PN-', CAST(part AS VARCHAR(20)), '-', CAST(pos AS VARCHAR(9)), ' │ ', CASE WHEN part % 2 = 0 THEN '8481 80 90' ELSE '84818090' END, CASE WHEN part % 5 = 2 THEN ' 8481809010 8481.80.90' ELSE '' END, ' │ ', CAST(CAST(q AS INT) AS VARCHAR(9)), ' │ ', CAST(p AS VARCHAR(20)), ' │ ', CAST(CAST(q * p AS DECIMAL(18,2)) AS VARCHAR(20)), CASE WHEN part % 3 = 0 THEN concat(' │ ', CAST(CAST(q * p AS DECIMAL(18,2)) AS VARCHAR(20))) ELSE '' END)"
#: Items as a model gave them: short, fused and ten-digit codes, shifted prices, wrong amounts, charges.
READ = f"""SELECT doc_id, pos, part, q, p, CAST(q * p AS DECIMAL(18,2)) AS amount, {_PRINTED_ROW} AS printed, concat('PN-', CAST(part AS VARCHAR(20)), '-', CAST(pos AS VARCHAR(9))) AS part_number, CASE WHEN part % 47 = 0 THEN 'Freight charges' ELSE 'VALVE' END AS product_description,
  CASE WHEN part % 5 = 0 THEN '16' WHEN part % 5 = 1 THEN '160 84818090' WHEN part % 5 = 2 THEN '8481809010' WHEN part % 5 = 3 THEN '84818090' ELSE '' END AS hsn_code, CAST(q AS VARCHAR(30)) AS quantity,
  CAST(CASE WHEN part % 7 = 0 THEN CAST(q * p AS DECIMAL(18,2)) ELSE p END AS VARCHAR(30)) AS unit_price,
  CAST(CASE WHEN part % 7 = 0 THEN CAST(q * CAST(q * p AS DECIMAL(18,2)) AS DECIMAL(18,2)) WHEN part % 7 = 1 THEN CAST(CAST(q * p AS DECIMAL(18,2)) + 5 AS DECIMAL(18,2)) ELSE CAST(q * p AS DECIMAL(18,2)) END AS VARCHAR(30)) AS line_total FROM ({ORDERED}) o"""
REPAIRS_SQL = f"""WITH r AS MATERIALIZED (SELECT * FROM ({duck(READ)}) x),
texts AS (SELECT doc_id, string_agg(printed, chr(10) ORDER BY pos) || chr(10) || 'TOTAL' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'FREIGHT CHARGES │ 100.00' ELSE '' END AS text FROM r GROUP BY doc_id),
k AS (SELECT r.* EXCLUDE (quantity), text, CAST(unit_price AS DECIMAL(18,2)) AS up, CAST(line_total AS DECIMAL(18,2)) AS lt, list_transform(regexp_extract_all(printed, '\\d+\\.\\d{{2}}(?:$| )'), lambda v: CAST(trim(v) AS DECIMAL(18,2))) AS money, list_transform(regexp_extract_all(regexp_replace(text, '\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}', '8481.80', 'g'), '\\d[\\d,]*(?:\\.\\d+)?'), lambda v: TRY_CAST(v AS DECIMAL(18,6))) AS numbers
  FROM r JOIN texts USING (doc_id) WHERE NOT (product_description = 'Freight charges' AND regexp_matches(text, '(?m)^FREIGHT CHARGES'))),
h AS (SELECT *, CASE WHEN part % 5 = 1 AND contains(text, '84818090') THEN 'fused' WHEN part % 5 = 0 THEN 'row' WHEN part % 5 = 2 THEN 'home' END AS hsn_note FROM k),
s AS (SELECT *, list_contains(money, up) AND list_contains(money, lt) AND abs(q * up - lt) <= 0.01 AS fine, list_filter(list_distinct(money), lambda v: len(list_filter(money, lambda o: o = v)) > 1 AND (CAST(q AS INT) = 1 OR list_contains(money, CAST(v / q AS DECIMAL(18,2)))) AND CAST(CAST(v / q AS DECIMAL(18,2)) * q AS DECIMAL(18,2)) = v) AS twice FROM h),
n AS (SELECT *, CASE WHEN NOT fine AND len(twice) = 1 THEN CAST(twice[1] / q AS DECIMAL(18,2)) ELSE up END AS up2, CASE WHEN NOT fine AND len(twice) = 1 THEN twice[1] ELSE lt END AS lt2 FROM s),
m AS (SELECT *, CAST(q * up2 AS DECIMAL(18,2)) AS due, abs(CAST(q * up2 AS DECIMAL(18,2)) - lt2) > 0.01 AND NOT list_contains(numbers, CAST(lt2 AS DECIMAL(18,6))) AND list_contains(numbers, CAST(CAST(q * up2 AS DECIMAL(18,2)) AS DECIMAL(18,6))) AS lost FROM n)
SELECT doc_id, pos, CASE hsn_note WHEN 'fused' THEN '84818090' WHEN 'row' THEN CASE WHEN part % 2 = 0 THEN '8481 80 90' ELSE '84818090' END WHEN 'home' THEN '8481.80.90' ELSE hsn_code END AS hsn_code, hsn_note, up2 AS unit_price, CASE WHEN lost THEN due ELSE lt2 END AS line_total, CASE WHEN up2 <> up OR lt2 <> lt THEN 'shifted' END AS price_note, CASE WHEN lost THEN 'unprinted' END AS amount_note FROM m"""

# --- headers and what their text says --------------------------------------------------------

HEADS = f"""SELECT doc_id, CAST(total AS VARCHAR(40)) AS invoice_total, '50' AS net_realisable_amount, 'USD' AS currency, CASE WHEN doc_id % 6 IN (2, 3) THEN NULL ELSE '9' END AS total_packages, 'DE' AS country_of_origin, CASE WHEN doc_id % 3 = 0 THEN 'DE' ELSE 'US' END AS country_of_destination, CASE WHEN doc_id % 5 = 0 THEN 'Oslo' ELSE 'Pune, India' END AS supplier_address,
  concat('lead', chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('Net Realisable', chr(10)) ELSE '' END, CASE WHEN doc_id % 6 = 0 THEN concat('TOTAL 7 ', CAST(qty AS VARCHAR(20))) WHEN doc_id % 6 = 1 THEN concat('Total: ', CAST(qty AS VARCHAR(20))) WHEN doc_id % 6 = 2 THEN 'in 3 cartons' WHEN doc_id % 6 = 3 THEN '2 boxes, 3 boxes' WHEN doc_id % 6 = 4 THEN concat('FOB VALUE (INR) ', CAST(total AS VARCHAR(40))) ELSE concat('FOB value: ', CAST(total AS VARCHAR(40))) END) AS invoice_text
FROM (SELECT doc_id, CAST(sum(q) AS INT) AS qty, CAST(sum(CAST(q * p AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM ({ORDERED}) o GROUP BY doc_id) s"""
HEAD_ITEMS = f"SELECT doc_id, pos, CAST(q AS DOUBLE) AS quantity, CAST(CASE WHEN doc_id % 2 = 0 THEN q * p ELSE q * p * 2 END AS DOUBLE) AS line_total FROM ({ORDERED}) o"
HEADS_SQL = f"""WITH h AS (SELECT *, TRY_CAST(invoice_total AS DOUBLE) AS total FROM ({duck(HEADS)}) x JOIN (SELECT doc_id, sum(quantity) AS qty, sum(line_total) AS whole FROM ({duck(HEAD_ITEMS)}) i GROUP BY doc_id) s USING (doc_id)),
n AS (SELECT *, CASE WHEN regexp_matches(lower(invoice_text), 'net realis|net charge|realisable') THEN net_realisable_amount END AS net, regexp_extract(lower(invoice_text), 'fob value[^\\n]*?([\\d,]+\\.?\\d*)$', 1) AS fob, list_filter(string_split(invoice_text, chr(10)), lambda l: regexp_matches(l, '(?i)^\\s*TOTAL\\b')) AS totals,
  list_distinct(list_transform(regexp_extract_all(invoice_text, '(\\d+) (?:cartons|boxes)', 1), lambda v: CAST(v AS DOUBLE))) AS cartons FROM h),
p AS (SELECT *, list_transform(totals, lambda l: list_transform(regexp_extract_all(l, '\\d+(?:\\.\\d+)?'), lambda v: CAST(v AS DOUBLE))) AS rows FROM n),
q AS (SELECT *, list_filter(rows, lambda r: list_contains(r, qty)) AS holding FROM p),
c AS (SELECT *, CASE WHEN len(holding) > 0 THEN list_filter(holding, lambda r: list_position(r, qty) > 1)[1][1] ELSE TRY_CAST(total_packages AS DOUBLE) END AS packs FROM q)
SELECT doc_id, CASE WHEN coalesce(fob, '') <> '' AND abs(total - CAST(replace(fob, ',', '') AS DOUBLE)) <= greatest(1.0, 0.01 * CAST(replace(fob, ',', '') AS DOUBLE)) AND (regexp_matches(lower(invoice_text), '\\binr\\b') OR abs(whole - total) > greatest(1.0, total * 0.01)) THEN net ELSE invoice_total END AS invoice_total, net AS net_realisable_amount,
  CASE WHEN (packs IS NULL OR packs = qty) AND len(list_filter(cartons, lambda v: v > 0 AND v < qty)) = 1 THEN list_filter(cartons, lambda v: v > 0 AND v < qty)[1] ELSE packs END AS total_packages, CASE WHEN contains(lower(supplier_address), 'india') AND country_of_origin = country_of_destination THEN 'IN' ELSE country_of_origin END AS country_of_origin FROM c"""

# --- template columns ------------------------------------------------------------------------

_ROWS = ", ".join(f"('{sheet}', {i}, '{name}')" for sheet, names in ((t.EXPORT_SHEET, t.ITEM_COLUMNS), (t.IMPORT_SHEET, t.BOE_COLUMNS)) for i, name in enumerate(names))
_STRINGS = ", ".join(f"'{c}'" for c in t.ALWAYS_STRING)
_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in t.ABBREVIATIONS.items()) + "}"
#: Names like a template's, by part: words of all kinds, with and without hints, and names that are texts always.
TEMPLATE_NAMES = """SELECT p_brand AS sheet, CAST(p_partkey AS INT) AS pos, CASE WHEN p_partkey % 14 = 0 THEN concat(replace(p_name, ' ', '_'), '_Qty') WHEN p_partkey % 14 = 1 THEN concat(upper(p_name), ' Desc') WHEN p_partkey % 14 = 2 THEN concat('Itm_', p_name, '_Amt') WHEN p_partkey % 14 = 3 THEN concat(p_type, '_Mfd Date')
  WHEN p_partkey % 14 = 4 THEN concat(p_name, '_per') WHEN p_partkey % 14 = 5 THEN 'Item_Ser_No' WHEN p_partkey % 14 = 6 THEN 'SL No' WHEN p_partkey % 14 = 7 THEN 'item_Cess' WHEN p_partkey % 14 = 8 THEN 'CESS Per' WHEN p_partkey % 14 = 9 THEN concat('Val ', p_name)
  WHEN p_partkey % 14 = 10 THEN concat('__', p_name, '__Regn_No') WHEN p_partkey % 14 = 11 THEN 'ItmIGSTPer' WHEN p_partkey % 14 = 12 THEN concat('Item_Rate_', p_type) ELSE p_name END AS name FROM {part}"""
TEMPLATE_SQL = f"""SELECT sheet, CAST(pos AS INTEGER) AS pos, name, CASE WHEN lower(name) IN ({_STRINGS}) OR contains(lower(name), 'date') THEN 'string' WHEN regexp_matches(lower(name), '{"|".join(t.NUMBER_HINTS)}') THEN 'number' ELSE 'string' END AS type,
  array_to_string(list_transform(list_filter(string_split(replace(name, '_', ' '), ' '), lambda w: w <> ''), lambda w: coalesce({_WORDS}[lower(w)], upper(w[1]) || lower(w[2:]))), ' ') AS alias, replace(lower(name), ' ', '_') IN ({", ".join(f"'{c}'" for c in t.LINK_COLUMNS)}) AS is_link FROM (SELECT * FROM (VALUES {_ROWS}) v(sheet, pos, name) UNION ALL SELECT * FROM ({duck(TEMPLATE_NAMES)}) w)"""

# --- parties, routes and phrases put into texts ----------------------------------------------

_FILL = "repeat('x ', CAST(doc_id % 500 AS INT))"
#: Leads that turn on columns, references, stops, distances and the order of labels, before the documents' own texts.
ADDRESSED = f"""SELECT doc_id, concat(
  CASE WHEN floor(doc_id / 16) % 5 = 0 THEN concat('Shipping  Bill', chr(10), 'MEIS ') WHEN floor(doc_id / 16) % 5 = 1 THEN 'into bond egm swcs ' WHEN floor(doc_id / 16) % 5 = 2 THEN concat('BCD,', chr(10), 'cvd ') ELSE '' END, chr(10),
  CASE WHEN doc_id % 16 = 0 THEN 'Buyer: ACME, Pune, India' WHEN doc_id % 16 = 1 THEN concat('Exporter: ', {_FILL}, 'India') WHEN doc_id % 16 = 2 THEN concat('Seller: HYVE │ Buyer: FOO', chr(10), 'London │ Pune, India')
    WHEN doc_id % 16 = 3 THEN 'Buyers Order No: 5 India' WHEN doc_id % 16 = 4 THEN 'FCA Seller Premises India' WHEN doc_id % 16 = 5 THEN concat('Ship From: Changzhou To India', CASE WHEN floor(doc_id / 16) % 2 = 0 THEN ' India' ELSE '' END)
    WHEN doc_id % 16 = 6 THEN concat('Consignee: Acme Hungary', chr(10), 'Country of Origin of Goods: India') WHEN doc_id % 16 = 7 THEN concat('Country of Origin Country of Final Destination', chr(10), 'India   │  Republic of Korea')
    WHEN doc_id % 16 = 8 THEN concat('Port of import: France', chr(10), 'port of  export: India') WHEN doc_id % 16 = 9 THEN concat('Country of origin: Germanys ', repeat('y', CAST(doc_id % 200 AS INT)), ' India')
    WHEN doc_id % 16 = 10 THEN 'Final destination: indiana, India' WHEN doc_id % 16 = 11 THEN concat('Sold-To │ Bank', chr(10), 'Pune │ India', CASE WHEN floor(doc_id / 16) % 2 = 0 THEN concat(chr(10), 'India') ELSE '' END)
    WHEN doc_id % 16 = 12 THEN concat('Shipper: A, India', chr(10), 'Receiver: B, India') WHEN doc_id % 16 = 13 THEN concat('Country of origin Final destination', chr(10), 'India and Germany')
    WHEN doc_id % 16 = 14 THEN concat('Bill  to', chr(10), 'x │ India', chr(10), 'Manufacturer - Berlin') ELSE '' END, chr(10), text) AS text FROM {{documents}}"""


def _regex(words: str) -> str:
    return words.replace("'", "''")


LABEL_GAP = r"[\s\-]+"
_COUNTRY = r"\b(" + "|".join(t.COUNTRIES) + r")\b"
_LABEL_ROWS = ", ".join(f"('{side}', '{label}', '{LABEL_GAP.join(label.split())}')" for side, labels in (("buyer", t.BUYER_LABELS), ("supplier", t.SUPPLIER_LABELS)) for label in labels)
_ROUTE_ROWS = f"('route', 'origin', '{t.ORIGIN_LABEL}'), ('route', 'target', '{t.DESTINATION_LABEL}')"
#: The texts of windows, cut by columns, and searched: no places of marks but those of labels.
_SIGNALS = rf"""d AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM ({duck(ADDRESSED)}) z),
pats(side, label, pat) AS (VALUES {_LABEL_ROWS}, {_ROUTE_ROWS}),
hits AS (SELECT doc_id, low, side, label, string_split_regex(low, pat) AS gaps, regexp_extract_all(low, pat) AS said FROM d, pats WHERE contains(low, 'india') AND regexp_matches(low, pat)),
spots AS MATERIALIZED (SELECT doc_id, low, side, label, s, s + length(said[i]) AS e FROM (SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM hits) y) x),
parties AS MATERIALIZED (SELECT * FROM spots WHERE side <> 'route' AND NOT regexp_matches(substr(low, e + 1, {t.REFERENCE_CHARS}), '^{_regex(t.REFERENCE_FIELD)}') AND NOT regexp_matches(regexp_extract(substr(low, 1, s), '[^\n│]*$'), '[a-z]{{2,}}')),
reach AS (SELECT * EXCLUDE (nxt), least(e + {t.NEAR_CHARS}, nxt) AS stop FROM (SELECT p.doc_id, p.low, p.side, p.label, p.s, p.e, min(o.s) FILTER (WHERE (o.side = 'route' AND o.s >= p.e) OR (o.side <> 'route' AND o.s > p.e)) AS nxt
  FROM parties p LEFT JOIN (SELECT doc_id, side, s FROM parties UNION ALL SELECT doc_id, side, s FROM spots WHERE side = 'route') o ON o.doc_id = p.doc_id AND o.side <> p.side GROUP BY p.doc_id, p.low, p.side, p.label, p.s, p.e) g),
windows AS (SELECT *, string_split(substr(low, e + 1, stop - e), chr(10)) AS lines, len(string_split(regexp_extract(substr(low, 1, e), '[^\n]*$'), '│')) AS col FROM reach),
near AS (SELECT DISTINCT doc_id, side, label FROM windows WHERE regexp_matches(regexp_replace(lines[1] || chr(10) || array_to_string(list_transform(lines[2:], lambda l: CASE WHEN contains(l, '│') THEN coalesce(string_split(l, '│')[col], '') ELSE l END), chr(10)), '\bto\s{{0,4}}india\b', '#', 'g'), '\bindia\b')),
homes AS (SELECT doc_id, count(*) FILTER (WHERE side = 'buyer') AS buyer_home, count(*) FILTER (WHERE side = 'supplier') AS supplier_home FROM near GROUP BY doc_id),
ends AS (SELECT doc_id, any_value(low) AS low, min(s) FILTER (WHERE label = 'origin') AS os, arg_min(e, s) FILTER (WHERE label = 'origin') AS oe, min(s) FILTER (WHERE label = 'target') AS ts, arg_min(e, s) FILTER (WHERE label = 'target') AS te FROM spots WHERE side = 'route' GROUP BY doc_id),
direct AS (SELECT *, regexp_extract(substr(low, oe + 1, CASE WHEN ts IS NULL THEN {t.SINGLE_LABEL_CHARS} WHEN ts > oe THEN ts - oe ELSE length(low) END), '{_COUNTRY}', 1) AS a,
  regexp_extract(substr(low, te + 1, CASE WHEN os IS NULL THEN {t.SINGLE_LABEL_CHARS} WHEN os > te THEN os - te ELSE length(low) END), '{_COUNTRY}', 1) AS b, CASE WHEN os IS NOT NULL AND ts IS NOT NULL THEN substr(low, least(os, ts) + 1) ELSE '' END AS rest FROM ends),
paired AS (SELECT *, regexp_extract_all(rest, '{_COUNTRY}', 1) AS two, trim(regexp_replace(trim(replace(trim(regexp_extract(rest, '(?s)^.*?{_COUNTRY}(.*?){_COUNTRY}', 2), chr(32) || chr(10)), '│', ''), chr(32) || chr(10)), '{_regex(t.FORMAL_PREFIX)}', ''), chr(32) || chr(10)) AS gap FROM direct),
routes AS (SELECT doc_id, coalesce(CASE WHEN p THEN CASE WHEN os <= ts THEN two[1] ELSE two[2] END ELSE a END = '{t.HOME}', false) AS origin_home, coalesce(CASE WHEN p THEN CASE WHEN os <= ts THEN two[2] ELSE two[1] END ELSE b END = '{t.HOME}', false) AS destination_home FROM (SELECT *, rest <> '' AND (a = '' OR b = '') AND len(two) >= 2 AND gap = '' AS p FROM paired) q),
signals AS MATERIALIZED (SELECT doc_id, low, coalesce(origin_home, false) AS origin_home, coalesce(destination_home, false) AS destination_home, CAST(coalesce(buyer_home, 0) AS INTEGER) AS buyer_home, CAST(coalesce(supplier_home, 0) AS INTEGER) AS supplier_home FROM d LEFT JOIN homes USING (doc_id) LEFT JOIN routes USING (doc_id))"""
PARTY_SQL = f"WITH {_SIGNALS} SELECT doc_id, origin_home, destination_home, buyer_home, supplier_home FROM signals"


def phrase_points(phrases, points: int) -> str:
    wide = [r"\s+".join(p.split()) if " " in p else rf"\b{p}\b" for p in phrases]
    return " + ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {points} ELSE 0 END" for p in wide)


SHIPMENT_SQL = f"""WITH {_SIGNALS},
k AS (SELECT *, {phrase_points(t.EXPORT_STRONG, t.STRONG_POINTS)} + {phrase_points(t.EXPORT_WEAK, t.WEAK_POINTS)} AS ek, {phrase_points(t.IMPORT_STRONG, t.STRONG_POINTS)} + {phrase_points(t.IMPORT_WEAK, t.WEAK_POINTS)} AS ik FROM signals),
s AS (SELECT *, origin_home AND NOT destination_home AS o1, destination_home AND NOT origin_home AS o2, buyer_home > 0 AND supplier_home = 0 AS p2, supplier_home > 0 AND buyer_home = 0 AS p1 FROM k),
n AS (SELECT *, ek + {t.STRONG_POINTS} * (o1::INT + p1::INT) AS es, ik + {t.STRONG_POINTS} * (o2::INT + p2::INT) AS ims, ek > 0 OR ik > 0 AS kw, o1 OR o2 OR p1 OR p2 AS st FROM s)
SELECT doc_id, CASE WHEN es - ims >= {t.MARGIN} THEN 'export' WHEN ims - es >= {t.MARGIN} THEN 'import' ELSE 'unknown' END AS shipment_type, CAST(es AS INTEGER) AS export_score, CAST(ims AS INTEGER) AS import_score, CASE WHEN kw AND st THEN 'both' WHEN kw THEN 'keyword' WHEN st THEN 'structural' ELSE 'none' END AS signal FROM n"""

# --- names that are nearly the same ----------------------------------------------------------

#: Part names of a size, misread on one side: letters for digits, missing letters, words turned or added.
NAMES = f"""SELECT p_partkey AS part, p_size AS size, upper(p_name) AS name,
  CASE WHEN p_partkey % 6 = 0 THEN concat(substring(upper(p_name), 1, 3), substring(upper(p_name), 5, 40)) WHEN p_partkey % 6 = 1 THEN replace(replace(upper(p_name), 'O', '0'), 'I', '1') WHEN p_partkey % 6 = 2 THEN concat(upper(p_name), ' TYPE ', CAST(p_partkey % 10 AS VARCHAR(9)))
    WHEN p_partkey % 6 = 3 THEN concat('* ', p_brand, ' / ', p_type, ' / ', upper(p_name)) WHEN p_partkey % 6 = 4 THEN concat(p_type, ', ', upper(p_name), ' ', p_brand) ELSE lower(p_name) END AS misread
FROM {{part}}"""

_PLAIN = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"
_LONGEST = "list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: {'k': k, 'i': -i}))), lambda s: contains(b, substr(a, -s.i, s.k))))"
#: Matching blocks by recursion: the longest common piece, the first one of these, then what is left and right of it.
NAMES_SQL = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT part, size, {_PLAIN.format('name')} AS name, {_PLAIN.format('misread')} AS misread FROM ({duck(NAMES)}) z),
texts AS MATERIALIZED (SELECT DISTINCT l.name AS x, r.misread AS y FROM n l JOIN n r USING (size) WHERE l.name <> '' AND r.misread <> ''),
words AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT unnest(string_split(x, ' ')) AS u, y FROM texts) p, (SELECT DISTINCT y AS y2, unnest(string_split(y, ' ')) AS v FROM texts) q WHERE p.y = q.y2 UNION SELECT DISTINCT v, u FROM (SELECT unnest(string_split(x, ' ')) AS u, y FROM texts) p, (SELECT DISTINCT y AS y2, unnest(string_split(y, ' ')) AS v FROM texts) q WHERE p.y = q.y2),
met AS MATERIALIZED (SELECT x, y FROM texts UNION SELECT u, v FROM words),
blocks AS (
  SELECT x, y, x AS a, y AS b, {_LONGEST.replace('a,', 'x,').replace('(a)', '(x)').replace('contains(b', 'contains(y')} AS best FROM met
  UNION ALL SELECT x, y, a, b, {_LONGEST} FROM (
    SELECT x, y, unnest([substr(a, 1, -best.i - 1), substr(a, -best.i + best.k)]) AS a, unnest([substr(b, 1, instr(b, substr(a, -best.i, best.k)) - 1), substr(b, instr(b, substr(a, -best.i, best.k)) + best.k)]) AS b FROM blocks WHERE best IS NOT NULL) s WHERE a <> '' AND b <> ''),
ratios AS MATERIALIZED (SELECT x, y, 2.0::DOUBLE * sum(coalesce(best.k, 0)) / (length(x) + length(y)) AS r FROM blocks GROUP BY x, y),
of_words AS (SELECT x AS u, y AS v FROM ratios WHERE r >= 0.8),
sides AS (SELECT x, y, CASE WHEN len(string_split(x, ' ')) <= len(string_split(y, ' ')) THEN string_split(x, ' ') ELSE string_split(y, ' ') END AS few, CASE WHEN len(string_split(x, ' ')) <= len(string_split(y, ' ')) THEN string_split(y, ' ') ELSE string_split(x, ' ') END AS many FROM texts),
near AS (SELECT x, y, few_n, count(DISTINCT i) AS shared FROM (SELECT x, y, i, few_n, few[i] AS w, unnest(many) AS v FROM (SELECT *, len(few) AS few_n, unnest(range(1, len(few) + 1)) AS i FROM sides) f) g JOIN of_words ON u = w AND of_words.v = g.v GROUP BY x, y, few_n),
like_texts AS MATERIALIZED (SELECT x, y, greatest(r, CASE WHEN shared >= 2 THEN shared::DOUBLE / few_n ELSE 0 END) AS likeness FROM texts JOIN ratios USING (x, y) LEFT JOIN near USING (x, y))
SELECT size, l.part AS part, r.part AS other, CASE WHEN likeness >= 0.85 THEN 'same' ELSE 'like' END AS kind FROM n l JOIN n r USING (size) JOIN like_texts ON x = l.name AND y = r.misread WHERE likeness >= 0.6"""


# --- ruled lines as ink ------------------------------------------------------------------------

_PLACES = "SELECT p_partkey AS i FROM {part} WHERE p_partkey < 160"
#: Ten parts make a page: of each a line, flat or up, some tilted, some with a gap, some pixels missing, some twice as thick.
INK = f"""SELECT DISTINCT doc_id, page_no, CAST(CASE WHEN k % 3 = 0 THEN across ELSE i END AS INT) AS x, CAST(CASE WHEN k % 3 = 0 THEN i ELSE across END AS INT) AS y FROM (
  SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, 1 AS page_no, p_partkey AS k, i, floor(p_partkey % 10 * 37 + p_size + i * (p_partkey % 5 - 2) * 0.008 + thick) AS across
  FROM {{part}} JOIN ({_PLACES}) places ON i < 90 + p_size JOIN (SELECT 0 AS thick UNION ALL SELECT 1) t ON thick = 0 OR p_partkey % 4 = 0
  WHERE NOT (p_partkey % 6 = 1 AND i BETWEEN 40 AND 52) AND (i + p_partkey) % 11 <> 0) z"""
INK_TILTS, INK_LEAST = range(-8, 9), 60
_SLOPES = ", ".join(f"({k}, CAST({v!r} AS DOUBLE))" for k, v in lines.slopes(INK_TILTS).items())
HOUGH_SQL = f"""WITH p AS (SELECT doc_id, page_no, 'flat' AS axis, x AS a, y AS c FROM ({duck(INK)}) q UNION ALL SELECT doc_id, page_no, 'up', y, x FROM ({duck(INK)}) r),
v AS (SELECT doc_id, page_no, axis, tilt, CAST(c - floor(s * a + 0.5) AS INTEGER) AS level, count(*) AS votes FROM p, (VALUES {_SLOPES}) t(tilt, s) GROUP BY ALL HAVING count(*) >= {INK_LEAST}),
b AS (SELECT doc_id, page_no, axis, arg_max(tilt, struct_pack(v := votes, low := -tilt)) AS tilt FROM v GROUP BY ALL),
l AS (SELECT v.* FROM v JOIN b USING (doc_id, page_no, axis, tilt))
SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.axis = l.axis AND abs(o.level - l.level) <= {lines.APART} AND (o.votes > l.votes OR (o.votes = l.votes AND o.level < l.level)))"""


# --- readings that get better, or worse, by attempts ---------------------------------------------

_TRUE = "CAST(q * p AS DECIMAL(18,2))"


def reading(attempt: str) -> str:
    """Amounts as an attempt reads them: fewer are wrong each time, but those of some documents are worse the second time."""
    off = f"CASE WHEN part % (4 * {attempt}) = 0 THEN 7 ELSE 0 END + CASE WHEN {attempt} = 2 AND doc_id % 5 = 0 THEN 50 ELSE 0 END"
    return f"CAST({_TRUE} + {off} AS DECIMAL(18,2))"


def read_items(attempt: int) -> str:
    return f"SELECT doc_id, pos, q AS quantity, p AS unit_price, {reading(str(attempt))} AS line_total FROM ({ORDERED}) o"


READ_TOTALS = f"SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sum({_TRUE}) END AS DECIMAL(28,6)) AS total FROM ({ORDERED}) o GROUP BY doc_id"
_SUM_GAP = "abs(total - list_sum({}))"
ROUNDS_SQL = f"""WITH RECURSIVE base AS MATERIALIZED (
  SELECT doc_id, any_value(total) AS total, list(struct_pack(q := q, p := p, part := part) ORDER BY pos) AS its FROM ({duck(ORDERED)}) o JOIN ({duck(READ_TOTALS)}) t USING (doc_id) GROUP BY doc_id),
loop AS (
  SELECT doc_id, 1 AS attempt, list_transform(its, lambda i: {reading('1').replace('part', 'i.part').replace('q * p', 'i.q * i.p')}) AS a FROM base
  UNION ALL SELECT doc_id, attempt + 1, CASE WHEN total IS NULL OR {_SUM_GAP.format('b')} <= {_SUM_GAP.format('a')} THEN b ELSE a END FROM (
    SELECT doc_id, total, attempt, a, list_transform(its, lambda i: {reading('(attempt + 1)').replace('part', 'i.part').replace('q * p', 'i.q * i.p')}) AS b FROM loop JOIN base USING (doc_id)
    WHERE attempt < 3 AND len(list_filter(list_zip(its, a), lambda z: abs(CAST(z[1].q * z[1].p AS DECIMAL(18,2)) - z[2]) > 0.05)) > 0) n)
SELECT doc_id, attempt AS attempts, CASE WHEN len(list_filter(list_zip(its, a), lambda z: abs(CAST(z[1].q * z[1].p AS DECIMAL(18,2)) - z[2]) > 0.05)) = 0 THEN 'validated' ELSE 'validation_failed' END AS status, CAST(list_sum(a) AS DECIMAL(28,2)) AS amount
FROM (SELECT doc_id, max(attempt) AS attempt, arg_max(a, attempt) AS a FROM loop GROUP BY doc_id) f JOIN base USING (doc_id)"""


# --- suppliers with formats of their own ------------------------------------------------------

#: A format for each customer's number, and some that any name with two digits fits only by its end.
FORMATS = """SELECT concat('(?i)^SUPPLIER#', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'), '$') AS supplier, '^SI[0-9]{{6}}$' AS valid, '^[S5][I1l]([0-9]{{6}})$' AS misread, CASE WHEN c_custkey % 2 = 0 THEN 'SI' ELSE 'SX' END AS prefix FROM {customer}"""
SUPPLIED = """SELECT s_suppkey AS doc_id, s_name AS supplier_name, concat(CASE WHEN s_suppkey % 4 = 0 THEN 'SI' WHEN s_suppkey % 4 = 1 THEN '51' WHEN s_suppkey % 4 = 2 THEN '5l' ELSE 'Q-' END, lpad(CAST(s_suppkey AS VARCHAR(20)), 6, '0'), CASE WHEN s_suppkey % 5 = 0 THEN ' / 5I000777' ELSE '' END) AS invoice_number,
  concat('no. ', CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE lpad(CAST(s_suppkey AS VARCHAR(20)), 6, '0') END, ' 000777') AS invoice_text FROM {supplier}"""
SUPPLIED_SQL = f"""WITH s AS (SELECT s.*, string_split(invoice_number, ' / ') AS parts, f.prefix FROM ({duck(SUPPLIED)}) s LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'SI' ELSE 'SX' END AS prefix FROM customer) f ON k = CAST(substr(supplier_name, 10) AS BIGINT)),
n AS (SELECT doc_id, invoice_number AS was, CASE WHEN prefix IS NULL THEN invoice_number ELSE array_to_string(list_transform(parts, lambda p: CASE WHEN NOT regexp_matches(p, '^SI[0-9]{{6}}$') AND regexp_matches(p, '^[S5][I1l][0-9]{{6}}$') AND contains(invoice_text, p[3:]) THEN prefix || p[3:] ELSE p END), ' / ') END AS invoice_number FROM s)
SELECT doc_id, invoice_number, CASE WHEN invoice_number <> was THEN 'supplier_format' END AS number_note FROM n"""


# --- rules of the export sheet's domain --------------------------------------------------------

#: Rows that reach every branch: container numbers and blanks, codes of three kinds, claims, yes and no in all spellings, zero cess, states.
DOMAIN = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS pos, l_partkey % 1000 AS n,
  CASE WHEN l_partkey % 5 = 0 THEN concat('Valve ', CAST(l_suppkey AS VARCHAR(20)), ' 84818090A TAPS') WHEN l_partkey % 5 = 1 THEN '84818090A TAPS' ELSE 'Valve' END AS Item_Desc,
  CASE WHEN l_partkey % 6 = 0 THEN concat('msc', 'u', substring(CAST(1000000 + l_partkey AS VARCHAR(20)), 1, 7)) WHEN l_partkey % 6 = 1 THEN ' n/a ' WHEN l_partkey % 6 = 2 THEN '020-12345675' WHEN l_partkey % 6 = 3 THEN 'TGHX1234567' WHEN l_partkey % 6 = 4 THEN '' END AS ItmHawb,
  CASE WHEN l_suppkey % 8 = 0 THEN 'GNX200' WHEN l_suppkey % 8 = 1 THEN ' EU12' WHEN l_suppkey % 8 = 2 THEN 'AD Code 6550002' WHEN l_suppkey % 8 = 3 THEN '6550002-2900009' WHEN l_suppkey % 8 = 4 THEN '6550002' WHEN l_suppkey % 8 = 5 THEN '655000' WHEN l_suppkey % 8 = 6 THEN 'F1' END AS `FTA Code`,
  CASE WHEN l_linenumber % 2 = 0 THEN 'GNX100' END AS Item_End_Use, CASE WHEN l_partkey % 4 = 0 THEN ' nil' WHEN l_partkey % 4 = 1 THEN 'IN' WHEN l_partkey % 4 = 2 THEN '-' END AS Itm_Transit_Cntry, 'DE' AS Itm_Source_Cntry,
  CASE WHEN l_partkey % 11 = 0 THEN 'true' WHEN l_partkey % 11 = 1 THEN 'Yes' WHEN l_partkey % 11 = 2 THEN '1' WHEN l_partkey % 11 = 3 THEN 'yep' WHEN l_partkey % 11 = 4 THEN 'No' WHEN l_partkey % 11 = 5 THEN '0.0' WHEN l_partkey % 11 = 6 THEN 'maybe' WHEN l_partkey % 11 = 7 THEN 'NA' WHEN l_partkey % 11 = 8 THEN 'n' WHEN l_partkey % 11 = 9 THEN '' END AS item_Cess,
  CASE WHEN l_partkey % 7 = 0 THEN 'claimed under RoDTEP' WHEN l_partkey % 7 = 1 THEN 'meis' WHEN l_partkey % 7 = 2 THEN 'none' WHEN l_partkey % 7 = 3 THEN 'Y' WHEN l_partkey % 7 = 4 THEN 'no scheme' END AS Item_Reward,
  CASE WHEN l_partkey % 4 = 0 THEN '0' WHEN l_partkey % 4 = 1 THEN '0.0' WHEN l_partkey % 4 = 2 THEN '5' END AS `Cess Rate`,
  CASE WHEN l_suppkey % 6 = 0 THEN 'Gujarat (24)' WHEN l_suppkey % 6 = 1 THEN 'code 7, zone 12' WHEN l_suppkey % 6 = 2 THEN 'Delhi' WHEN l_suppkey % 6 = 3 THEN ' 27 ' WHEN l_suppkey % 6 = 4 THEN 'zone 123 (4)' END AS `State Code` FROM {lineitem}"""
_NA = "(" + ", ".join(f"'{x}'" for x in t.NA_LIKE) + ")"
DOMAIN_SQL = rf"""WITH d AS (SELECT * FROM ({duck(DOMAIN).replace(chr(96) + "FTA Code" + chr(96), "fta").replace(chr(96) + "Cess Rate" + chr(96), "cess").replace(chr(96) + "State Code" + chr(96), "state")}) z)
SELECT doc_id, pos, n, CASE WHEN regexp_matches(Item_Desc, '^.+\s+\d{{4,8}}[A-Z]\s+[A-Z]') THEN trim(regexp_extract(Item_Desc, '^(.*?)\s+\d{{4,8}}[A-Z]\s', 1)) ELSE Item_Desc END AS Item_Desc,
  CASE WHEN regexp_matches(upper(trim(ItmHawb)), '^[A-Z]{{3}}[UJZ]\d{{6,7}}$') OR upper(trim(ItmHawb)) IN {_NA} THEN '' ELSE coalesce(ItmHawb, '') END AS ItmHawb,
  CASE WHEN regexp_matches(trim(fta), '^(GNX|EU)') OR contains(upper(fta), 'AD CODE') OR regexp_matches(trim(fta), '^\d{{7,}}$|^\d{{6,8}}[- ]\d{{6,8}}$') THEN '' ELSE coalesce(fta, '') END AS fta,
  CASE WHEN coalesce(Item_End_Use, '') = '' AND regexp_matches(trim(fta), '^(GNX|EU)') THEN trim(fta) ELSE coalesce(Item_End_Use, '') END AS Item_End_Use,
  CASE WHEN upper(trim(Itm_Transit_Cntry)) IN {_NA} THEN '' ELSE coalesce(Itm_Transit_Cntry, '') END AS Itm_Transit_Cntry, Itm_Source_Cntry,
  CASE WHEN upper(trim(item_Cess)) IN ('TRUE', 'YES', '1', 'Y') OR upper(trim(item_Cess)) LIKE 'Y%' THEN 'Y' ELSE '' END AS item_Cess,
  CASE WHEN regexp_matches(upper(Item_Reward), 'RODTEP|MEIS|REWARD|CLAIM|SCHEME') OR upper(Item_Reward) = 'Y' THEN 'Y' ELSE '' END AS Item_Reward,
  CASE WHEN cess IN ('0', '0.0') THEN '' ELSE coalesce(cess, '') END AS cess,
  CASE WHEN state IS NULL THEN '' WHEN regexp_matches(state, '\(\d{{1,2}}\)') THEN regexp_extract(state, '\((\d{{1,2}})\)', 1) WHEN regexp_matches(state, '\b\d{{1,2}}\b') THEN regexp_extract(state, '\b(\d{{1,2}})\b', 1) ELSE trim(state) END AS state FROM d"""

# --- dates, codes and readings ------------------------------------------------------------------

#: The day of an order in all eight forms, some with blanks, some that are no date.
DATES = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN concat(y, '-', m, '-', d) WHEN o_orderkey % 11 = 1 THEN concat(d, '-', m, '-', y) WHEN o_orderkey % 11 = 2 THEN concat(d, '/', m, '/', y) WHEN o_orderkey % 11 = 3 THEN concat(m, '/', CAST(13 + o_orderkey % 15 AS VARCHAR(9)), '/', y)
  WHEN o_orderkey % 11 = 4 THEN concat(d, '-', mon, '-', y) WHEN o_orderkey % 11 = 5 THEN concat(' ', d, ' ', mon, ' ', y, ' ') WHEN o_orderkey % 11 = 6 THEN concat(d, '.', m, '.', y) WHEN o_orderkey % 11 = 7 THEN concat(y, '/', m, '/', d) WHEN o_orderkey % 11 = 8 THEN concat('31/2/', y) WHEN o_orderkey % 11 = 9 THEN concat(mon, ' ', d) END AS written
FROM (SELECT o_orderkey, CAST(1992 + o_custkey % 30 AS VARCHAR(9)) AS y, CAST(1 + o_orderkey % 12 AS VARCHAR(9)) AS m, CAST(1 + o_custkey % 28 AS VARCHAR(9)) AS d, substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(o_orderkey % 12 * 3 + 1 AS INT), 3) AS mon FROM {orders}) o"""
DATES_SQL = f"""SELECT doc_id, strftime(coalesce(try_strptime(w, '%Y-%m-%d'), try_strptime(w, '%d-%m-%Y'), try_strptime(w, '%d/%m/%Y'), try_strptime(w, '%m/%d/%Y'), try_strptime(w, '%d-%b-%Y'), try_strptime(w, '%d %b %Y'), try_strptime(w, '%d.%m.%Y'), try_strptime(w, '%Y/%m/%d')), '%Y-%m-%d') AS day FROM (SELECT doc_id, trim(written) AS w FROM ({duck(DATES)}) z) y"""

CODES = """SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 5 = 0 THEN concat('27abcde', CAST(1000 + s_suppkey % 9000 AS VARCHAR(9)), 'F1Z5') WHEN s_suppkey % 5 = 1 THEN concat('27 ABCDE', CAST(1000 + s_suppkey % 9000 AS VARCHAR(9)), 'F1Z5Q') WHEN s_suppkey % 5 = 2 THEN '27ABBCDE1234F1Z5' WHEN s_suppkey % 5 = 3 THEN '' END AS tax_id,
  CASE WHEN s_suppkey % 4 = 0 THEN '66555500000022--22990000000099' WHEN s_suppkey % 4 = 1 THEN '6550002-2900009' WHEN s_suppkey % 4 = 2 THEN '65500022900009' ELSE '112233' END AS ad_code, concat(s_name, CASE WHEN s_suppkey % 2 = 0 THEN ' 8481A TAPS' ELSE ' 848A' END) AS description FROM {supplier}"""
CODES_SQL = rf"""WITH c AS (SELECT *, replace(upper(trim(tax_id)), ' ', '') AS v, array_to_string([ad_code[i] FOR i IN range(1, length(ad_code) + 1, 2)], '') AS half FROM ({duck(CODES)}) z)
SELECT doc_id, CASE WHEN length(v) = 16 AND regexp_matches(v[:15], '{t.GSTIN}') THEN v[:15] ELSE v END AS tax_id, CASE WHEN length(replace(ad_code, '-', '')) <> 14 AND regexp_matches(half, '{t.AD_CODE}') AND length(replace(half, '-', '')) = 14 THEN half ELSE ad_code END AS ad_code,
  length(replace(half, '-', '')) = 14 OR length(replace(ad_code, '-', '')) = 14 AS ad_code_fits, CASE WHEN doc_id % 2 = 0 THEN replace(description, ' 8481A TAPS', '') ELSE description END AS description FROM c"""

#: Two readings of the same headers; some documents are in one of them only.
READINGS = """SELECT o_orderkey AS doc_id, concat('INV-', CAST(o_orderkey AS VARCHAR(20))) AS invoice_number, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'USD' END AS currency, CAST(o_custkey AS VARCHAR(20)) AS buyer_name FROM {orders} WHERE o_orderkey % 10 <> 1"""
READINGS_AGAIN = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('1NV-', CAST(o_orderkey AS VARCHAR(20))) ELSE concat('INV-', CAST(o_orderkey AS VARCHAR(20))) END AS invoice_number, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'USD' END AS currency, CAST(o_custkey AS VARCHAR(20)) AS buyer_name FROM {orders} WHERE o_orderkey % 10 <> 2"""
COMPARED = ("invoice_number", "currency", "buyer_name")
COMPARED_SQL = " UNION ALL ".join(f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, '{c}' AS field, a.{c} AS left_, b.{c} AS right_, a.{c} IS NOT DISTINCT FROM b.{c} AS same FROM ({duck(READINGS)}) a FULL JOIN ({duck(READINGS_AGAIN)}) b ON a.doc_id = b.doc_id" for c in COMPARED)
