"""Queries of documents: sheets, pages, records, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import scalars as S
from stockweave.operators import documents as D
from stockweave.operators import reconcile as R
from stockweave.sources.shared import stage

from .registry import query, sql_alignment, sql_fold, sql_trim

HEADER_KEY = rf"trim(regexp_replace({sql_fold('coalesce(value, ' + chr(39) * 2 + ')')}, '\s+', ' ', 'g'))"
EXACT3 = "'genel toplam', 'toplam adet', 'toplam miktar', 'stok miktari', 'quantity', 'grand total', 'overall total'"
SCORE = f"CASE WHEN k IN ({EXACT3}) OR contains(k, 'genel toplam') OR contains(k, 'toplam adet') OR contains(k, 'toplam miktar') THEN 3 WHEN k IN ('miktar', 'adet') THEN 2 WHEN k IN ('toplam', 'total') THEN 1 ELSE 0 END"
NAMED = "(contains(k, 'malzeme adi') OR contains(k, 'urun adi') OR contains(k, 'arac gerec') OR k IN ('malzeme', 'urun'))"


@query("header_key", f"SELECT document, row, col, {HEADER_KEY} AS key FROM {{sheet_cells}}")
def header_key(v):
    return v("sheet_cells").select("document", "row", "col", S.header_key(F.col("value")).alias("key"))


@query("alignment_key", f"SELECT document, row, col, {sql_alignment('value')} AS key FROM {{sheet_cells}}")
def alignment_key(v):
    return v("sheet_cells").select("document", "row", "col", S.alignment_key(F.col("value")).alias("key"))


@query("quantity_header_score", f"SELECT document, row, col, {SCORE} AS score FROM (SELECT *, {HEADER_KEY} AS k FROM {{sheet_cells}}) c")
def quantity_header_score(v):
    return v("sheet_cells").select("document", "row", "col", S.quantity_header_score(S.header_key(F.col("value"))).alias("score"))


@query("is_name_header", f"SELECT document, row, col, {NAMED} AS named FROM (SELECT *, {HEADER_KEY} AS k FROM {{sheet_cells}}) c")
def is_name_header(v):
    return v("sheet_cells").select("document", "row", "col", S.is_name_header(S.header_key(F.col("value"))).alias("named"))


CODED = " OR ".join(f"contains(t, '{p}')" for p in S.CODE_LABELS)


@query("has_code_label", rf"SELECT document, line_no, {CODED} OR regexp_matches(t, '\n\s*kod\s*([:|]|$)') AS coded FROM (SELECT *, {sql_fold('text')} AS t FROM {{page_lines}}) p")
def has_code_label(v):
    return v("page_lines").select("document", "line_no", S.has_code_label(F.col("text")).alias("coded"))


# ---- delimited text: the lines of documents ----

LINES = "lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d)"


def doc_lines(v):
    return v("documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("at", "text")).select("document", (F.col("at") + 1).alias("line_no"), "text")


@query("delimited_rows", rf"WITH {LINES}, kept AS (SELECT * FROM lines WHERE regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') <> ''), f AS (SELECT doc_id, arg_min(text, line_no) AS head, min(line_no) AS first FROM kept GROUP BY doc_id) SELECT k.doc_id AS document, k.line_no, k.text, CASE WHEN contains(f.head, ';') THEN ';' ELSE ',' END AS delimiter, k.line_no = f.first AS is_header FROM kept k JOIN f ON f.doc_id = k.doc_id")
def delimited_rows(v):
    return D.with_delimiter(doc_lines(v))


@query("split_delimited_cells", rf"WITH {LINES}, kept AS (SELECT * FROM lines WHERE regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') <> ''), f AS (SELECT doc_id, arg_min(text, line_no) AS head FROM kept GROUP BY doc_id) SELECT k.doc_id AS document, k.line_no, array_to_string(list_transform(string_split(k.text, CASE WHEN contains(f.head, ';') THEN ';' ELSE ',' END), lambda c: regexp_replace(c, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), '|') AS cells FROM kept k JOIN f ON f.doc_id = k.doc_id")
def split_delimited_cells(v):
    return D.with_delimiter(doc_lines(v)).select("document", "line_no", F.array_join(D.split_delimited_cells(F.col("text"), F.col("delimiter")), "|").alias("cells"))


@query("row_chunks", "WITH r AS (SELECT document, position, (row_number() OVER (PARTITION BY document ORDER BY position) - 1) // 3 + 1 AS chunk_index FROM {import_rows}) SELECT document, CAST(chunk_index AS INT) AS chunk_index, min(position) AS first_row, max(position) AS last_row, count(*) AS row_count FROM r GROUP BY document, chunk_index")
def row_chunks(v):
    return D.row_chunks(v("import_rows"), ["document"], "position", 3)


# ---- sheets ----

SHEET_ROWS = r"""
rows0 AS MATERIALIZED (SELECT document, sheet, row, list(coalesce(value, '') ORDER BY col) AS cells, string_agg(trim(value), ' | ' ORDER BY col) FILTER (WHERE trim(value) <> '') AS content, count(*) FILTER (WHERE trim(value) <> '') AS filled, arg_min(trim(value), col) FILTER (WHERE trim(value) <> '') AS first_cell FROM {sheet_cells} GROUP BY document, sheet, row),
sheet_rows AS MATERIALIZED (SELECT document, sheet, row, cells, content, filled >= 2 AND regexp_matches(first_cell, '^\d+([.,]\d+)?$') AS numbered FROM rows0 WHERE filled > 0)"""
SCANNED = "scanned AS (SELECT * FROM (SELECT *, row_number() OVER w AS nth, count(*) FILTER (WHERE numbered) OVER w AS records FROM sheet_rows WINDOW w AS (PARTITION BY document, sheet ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s WHERE nth <= 50 AND records = 0)"
# sheets of this view have their header in row 1, so its context is that row
HEADERS = f"""
cells AS (SELECT document, sheet, row, unnest(range(0, len(cells))) AS col, unnest(cells) AS value FROM scanned),
keyed AS MATERIALIZED (SELECT *, {HEADER_KEY} AS k FROM cells),
names AS (SELECT document, sheet, min((row, col)) AS n FROM keyed WHERE {NAMED} GROUP BY document, sheet),
scores AS (SELECT document, sheet, arg_max(col, ({SCORE}, -row, col)) AS quantity_col, arg_max(row, ({SCORE}, -row, col)) AS quantity_row FROM keyed WHERE {SCORE} > 0 GROUP BY document, sheet),
headers AS (SELECT n.document, n.sheet, n.n[2] AS name_col, s.quantity_col, greatest(n.n[1], s.quantity_row) AS header_row FROM names n JOIN scores s ON s.document = n.document AND s.sheet = n.sheet)"""
RECORDS = r"""
records AS (SELECT r.document, r.sheet, r.row AS source_row, concat('xlsx:', r.sheet, ':row:', CAST(r.row AS VARCHAR)) AS source_identity, r.content AS source_text, trim(r.cells[h.name_col + 1]) AS product_name, TRY_CAST(trim(r.cells[h.quantity_col + 1]) AS INT) AS quantity
  FROM sheet_rows r JOIN headers h ON h.document = r.document AND h.sheet = r.sheet WHERE r.row > h.header_row AND trim(r.cells[h.name_col + 1]) <> '' AND regexp_matches(trim(r.cells[h.quantity_col + 1]), '^\d+$') AND TRY_CAST(trim(r.cells[h.quantity_col + 1]) AS INT) > 0)"""


def sheet(v):
    return D.sheet_rows(v("sheet_cells"))


@query("sheet_rows", f"WITH {SHEET_ROWS} SELECT document, sheet, row, content, len(cells) AS cells, numbered FROM sheet_rows")
def sheet_rows(v):
    return sheet(v).select("document", "sheet", "row", "content", F.size("cells").cast("bigint").alias("cells"), "numbered")


@query("header_scan_limit", f"WITH {SHEET_ROWS}, {SCANNED} SELECT document, sheet, row FROM scanned")
def header_scan_limit(v):
    return D.header_scan_limit(sheet(v)).select("document", "sheet", "row")


@query("detect_header", f"WITH {SHEET_ROWS}, {SCANNED}, {HEADERS} SELECT h.document, h.sheet, h.name_col, h.quantity_col, h.header_row, r.content, true AS code_absent FROM headers h JOIN sheet_rows r ON r.document = h.document AND r.sheet = h.sheet AND r.row = h.header_row")
def detect_header(v):
    return D.detect_header(sheet(v))


@query("detect_varied_headers", rf"""WITH {SHEET_ROWS.replace("sheet_cells", "varied_sheets")}, {SCANNED}, {HEADERS},
placed AS (SELECT *, row_number() OVER (PARTITION BY document, sheet ORDER BY row) AS nth FROM sheet_rows),
firsts AS (SELECT document, sheet, min(nth) FILTER (WHERE numbered AND nth <= 5) AS first_number FROM placed GROUP BY document, sheet),
tops AS (SELECT document, sheet, max(nth) AS header_nth FROM headers JOIN placed USING (document, sheet) WHERE row <= header_row GROUP BY document, sheet),
facts AS (SELECT f.document, f.sheet, n.n[2] AS name_col, h.quantity_col, h.header_row, t.header_nth, f.first_number FROM firsts f LEFT JOIN names n USING (document, sheet) LEFT JOIN headers h USING (document, sheet) LEFT JOIN tops t USING (document, sheet)),
texts AS (SELECT f.*, (SELECT string_agg(p.content, chr(10) ORDER BY p.row) FROM placed p WHERE p.document = f.document AND p.sheet = f.sheet
  AND CASE WHEN header_row IS NOT NULL THEN p.row <= header_row AND p.nth > header_nth - 5 WHEN first_number IS NOT NULL THEN p.nth < first_number ELSE p.nth <= 3 END) AS content FROM facts f),
known AS (SELECT *, header_row IS NOT NULL OR (first_number IS NOT NULL AND content IS NOT NULL) AS trusted, {sql_fold('content')} AS t FROM texts)
SELECT document, sheet, CASE WHEN trusted THEN name_col END AS name_col, quantity_col, header_row, coalesce(content, '{D.NO_HEADER}') AS content, CASE WHEN trusted THEN NOT ({CODED} OR regexp_matches(t, '\n\s*kod\s*([:|]|$)')) ELSE false END AS code_absent FROM known""")
def detect_varied_headers(v):
    return D.detect_header(D.sheet_rows(v("varied_sheets")))


@query("table_records", f"WITH {SHEET_ROWS}, {SCANNED}, {HEADERS}, {RECORDS} SELECT document, sheet, source_row, source_identity, source_text, product_name, quantity FROM records")
def table_records(v):
    return D.cell_records(v("sheet_cells"))


@query("excel_chunks", f"""WITH {SHEET_ROWS}, {SCANNED}, {HEADERS}, {RECORDS},
chunked AS (SELECT r.*, (row_number() OVER (PARTITION BY r.document, r.sheet ORDER BY r.row) - 1) // 10 + 1 AS chunk_index, t.source_row IS NOT NULL AS trusted FROM sheet_rows r LEFT JOIN records t ON t.document = r.document AND t.sheet = r.sheet AND t.source_row = r.row)
SELECT document, sheet, CAST(chunk_index AS INT) AS chunk_index, min(row) AS first_row, max(row) AS last_row, count(*) AS row_count, CASE WHEN bool_or(trusted) THEN count(*) FILTER (WHERE trusted) ELSE count(*) FILTER (WHERE numbered) END AS candidate_count,
  coalesce(CASE WHEN bool_or(trusted) THEN string_agg(CAST(row AS VARCHAR), ',' ORDER BY row) FILTER (WHERE trusted) ELSE string_agg(CAST(row AS VARCHAR), ',' ORDER BY row) FILTER (WHERE numbered) END, '') AS record_rows FROM chunked GROUP BY document, sheet, chunk_index""")
def excel_chunks(v):
    r = sheet(v)
    c = D.excel_chunks(r, D.table_records(r, D.detect_header(r)))
    return c.withColumn("record_rows", F.array_join(F.col("record_rows").cast("array<string>"), ",")).withColumn("candidate_count", F.col("candidate_count").cast("bigint"))


@query("render_chunk_fragment", f"""WITH {SHEET_ROWS}, {SCANNED}, {HEADERS}, {RECORDS}
SELECT document AS chunk_id, 'SOURCE DOCUMENT: ' || document || chr(10) || 'SOURCE TYPE: XLSX' || chr(10) || 'WORKSHEET: EK-1' || chr(10) || 'CHUNK: 1' || chr(10) || 'SOURCE LOGICAL RECORD COUNT: ' || CAST(count(*) AS VARCHAR) || chr(10) || 'SOURCE ROWS: ' || CAST(min(source_row) AS VARCHAR) || '-' || CAST(max(source_row) AS VARCHAR) || chr(10) || chr(10) || '--- FRAGMENT START ---'
  || string_agg(chr(10) || 'RECORD ' || CAST(source_row AS VARCHAR) || ':' || chr(10) || 'SOURCE QUANTITY EVIDENCE: ' || CAST(quantity AS VARCHAR) || chr(10) || 'SOURCE PRODUCT CODE EVIDENCE: NONE (no explicit source code)' || chr(10) || 'SOURCE RECORD TEXT:' || chr(10) || source_text, chr(10) ORDER BY source_row) || chr(10) || '--- FRAGMENT END ---' AS fragment
FROM records GROUP BY document""")
def render_chunk_fragment(v):
    r = sheet(v)
    rec = D.table_records(r, D.detect_header(r)).select(F.col("document").alias("chunk_id"), F.col("source_row").alias("position"), F.col("source_row").alias("record_id"), "quantity", F.lit(None).cast("string").alias("code"), "source_text")
    chunks = rec.groupBy("chunk_id").agg(F.min("position").alias("first_row"), F.max("position").alias("last_row")).select("chunk_id", F.col("chunk_id").alias("document"), F.lit("XLSX").alias("source_type"), F.lit("EK-1").alias("place"), F.lit(1).alias("chunk_index"), "first_row", "last_row")
    return D.render_chunk_fragment(chunks, rec)


# ---- text blocks ----


def _walk(name: str, source: str, keys: str, glue: int, most: int) -> str:
    """Greedy packing of source (keys, i from 1, size) by length alone: keys, i, k, and filled, the length so far; what is empty before a text adds nothing."""
    ks = keys.split(", ")
    on = " AND ".join(f"o.{k} = w.{k}" for k in ks)
    own = ", ".join(f"o.{k}" for k in ks)
    full = f"w.filled > 0 AND w.filled + {glue} + o.size > {most}"
    return f"""{name} AS (SELECT {keys}, i, size AS filled, 0 AS k FROM {source} WHERE i = 1
  UNION ALL SELECT {own}, o.i, CASE WHEN w.filled > 0 AND NOT ({full}) THEN w.filled + {glue} + o.size ELSE o.size END, CASE WHEN {full} THEN w.k + 1 ELSE w.k END FROM {name} w JOIN {source} o ON {on} AND o.i = w.i + 1)"""


BLOCKS = "WITH RECURSIVE " + ", ".join([
    f"""paragraphs AS (SELECT document, unnest(range(len(ps))) AS para, unnest(ps) AS paragraph FROM (SELECT doc_id AS document, list_filter(list_transform(regexp_split_to_array({sql_trim("regexp_replace(text, '\\r\\n|\\r', chr(10), 'g')")}, '\\n\\s*\\n+'), lambda x: {sql_trim('x')}), lambda x: length(x) > 0) AS ps FROM {{documents}}) d)""",
    "text_lines AS (SELECT document, para, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT document, para, string_split(paragraph, chr(10)) AS ls FROM paragraphs WHERE length(paragraph) > 600) p)",
    "flagged AS (SELECT *, length(line) > 600 AS long, coalesce(lag(length(line) > 600) OVER (PARTITION BY document, para ORDER BY n), false) AS after_long FROM text_lines)",
    "placed_lines AS (SELECT *, sum(CASE WHEN long OR after_long THEN 1 ELSE 0 END) OVER (PARTITION BY document, para ORDER BY n) AS run FROM flagged)",
    f"""pieces AS (SELECT document, para, run, unnest(range(len(ps))) AS k, unnest(ps) AS block FROM (SELECT document, para, run, list_transform(regexp_extract_all(line, '(?s)(.{{1,600}}(?: |$)|.{{1,600}})\\s*', 1), lambda x: {sql_trim('x')}) AS ps FROM placed_lines WHERE long) c)""",
    "short_lines AS (SELECT document, para, run, line, length(line) AS size, row_number() OVER (PARTITION BY document, para, run ORDER BY n) AS i FROM placed_lines WHERE NOT long)",
    _walk("line_walk", "short_lines", "document, para, run", 1, 600),
    "packed_lines AS (SELECT l.document, l.para, l.run, w.k, string_agg(l.line, chr(10) ORDER BY l.i) AS block FROM short_lines l JOIN line_walk w ON w.document = l.document AND w.para = l.para AND w.run = l.run AND w.i = l.i WHERE w.filled > 0 GROUP BY l.document, l.para, l.run, w.k)",
    "every_block AS (SELECT document, para, 0 AS run, 0 AS k, paragraph AS block FROM paragraphs WHERE length(paragraph) <= 600 UNION ALL SELECT document, para, run, k, block FROM pieces UNION ALL SELECT document, para, run, k, block FROM packed_lines)",
    "blocks AS (SELECT document, row_number() OVER (PARTITION BY document ORDER BY para, run, k) AS position, block FROM every_block)",
])
CHUNKS = ", ".join([
    "sized AS (SELECT document, block, length(block) AS size, row_number() OVER (PARTITION BY document ORDER BY position) AS i FROM blocks)",
    _walk("block_walk", "sized", "document", 2, 2000),
])


@query("text_blocks", f"{BLOCKS} SELECT document, position, block FROM blocks")
def text_blocks(v):
    return D.text_blocks(v("documents").select(F.col("doc_id").alias("document"), "text"), 600)


@query("pack_blocks", f"{BLOCKS}, {CHUNKS} SELECT b.document, w.k + 1 AS chunk_index, string_agg(b.block, chr(10) || chr(10) ORDER BY b.i) AS content FROM sized b JOIN block_walk w ON w.document = b.document AND w.i = b.i WHERE w.filled > 0 GROUP BY b.document, w.k")
def pack_blocks(v):
    return D.pack_blocks(D.text_blocks(v("documents").select(F.col("doc_id").alias("document"), "text"), 600), 2000)


# ---- pages ----

LEADS = ["(contains(t, 'sira no') OR contains(t, 'sira numarasi'))", "(contains(t, 'urun adi') OR contains(t, 'malzeme adi') OR contains(t, 'urun / malzeme'))"]


def _families(families) -> str:
    return " + ".join("CASE WHEN " + " OR ".join(f"contains(t, '{p}')" for p in f) + " THEN 1 ELSE 0 END" for f in families)


IS_HEADER = f"(({LEADS[0]} OR {LEADS[1]}) AND CASE WHEN {LEADS[0]} THEN 1 ELSE 0 END + CASE WHEN {LEADS[1]} THEN 1 ELSE 0 END + {_families(D.HEADER_FAMILIES)} >= 3)"
IS_STRICT = f"({_families(D.STRICT_FAMILIES)} >= 3)"
MARK = r"^\s*(\d{1,4})\s*(?:[.)\-:|;]\s*|\s+)"
PAGE = rf"""
folded AS (SELECT *, {sql_fold('text')} AS t FROM {{page_lines}}),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '(?i)^\s*\d{{1,9}}\s*(?:adet|ad\.?|pcs?)\.?\s*$') AND NOT regexp_matches(text, '(?i)^\s*\d+(?:[.,]\d+)?\s*(?:v|w|a|mm|cm|ml|kg|g|m|metre|meter|volt|adet|pieces?|parça|parca|profil|profile)\b.*$') AND NOT {IS_HEADER} AND regexp_matches(text, '{MARK}.*\pL') THEN CAST(regexp_extract(text, '{MARK}', 1) AS INT) END AS number,
  regexp_matches(text, '(?i)^\s*(?:ürün|urun|malzeme|araç\s+gereç|arac\s+gerec|product|item)(?:\s+(?:adı|adi|name))?\s*[:|]\s*\S.*$') AS explicit, {IS_STRICT} AS strict,
  CASE WHEN regexp_matches(text, '{MARK}.*\pL') THEN nullif(regexp_extract(text, '(?i){MARK}.*?(?:[|;]\s*|\s+)(\d{{1,9}})(?:\s*(?:adet|ad\.?|pcs?))?\s*$', 1), '') END AS table_no,
  CASE WHEN regexp_matches(text, '{MARK}.*\pL') THEN CAST(regexp_extract(text, '{MARK}', 1) AS INT) END AS item_no FROM folded)"""
PAGE = PAGE.replace("{{page_lines}}", "{page_lines}").replace("{1,4}", "@14@").replace("{1,9}", "@19@")


def page_sql(rest: str, *steps: str) -> str:
    """PAGE and further steps; the counts in braces of the patterns are put in last, as braces name views."""
    return "WITH " + ", ".join([PAGE.strip(), *steps]) + " " + rest


def islands(source: str, number: str, where: str, name: str) -> str:
    return f"""{name}_d AS (SELECT DISTINCT document, page, CAST({number} AS INT) AS number FROM {source} WHERE {where}),
{name}_r AS (SELECT *, number - row_number() OVER (PARTITION BY document, page ORDER BY number) AS run FROM {name}_d),
{name} AS (SELECT document, page, number, min(number) OVER w AS run_start, count(*) OVER w AS run_length FROM {name}_r WINDOW w AS (PARTITION BY document, page, run) QUALIFY count(*) OVER w >= 3)"""


def page_query(name: str, sql: str):
    from .registry import ORACLES

    def deco(f):
        query(name, sql)(f)
        ORACLES[name] = ORACLES[name].replace("@14@", "{1,4}").replace("@19@", "{1,9}")
        return f

    return deco


@query("is_header_line", f"SELECT document, page, line_no, {IS_HEADER} AS header FROM (SELECT *, {sql_fold('text')} AS t FROM {{page_lines}}) p")
def is_header_line(v):
    return v("page_lines").select("document", "page", "line_no", D.is_header_line(F.col("text")).alias("header"))


@query("is_header_line_strict", f"SELECT document, page, line_no, {IS_STRICT} AS header FROM (SELECT *, {sql_fold('text')} AS t FROM {{page_lines}}) p")
def is_header_line_strict(v):
    return v("page_lines").select("document", "page", "line_no", D.is_header_line_strict(F.col("text")).alias("header"))


@page_query("numbered_lines", page_sql("SELECT document, page, line_no, number FROM marked"))
def numbered_lines(v):
    return D.numbered_lines(v("page_lines")).select("document", "page", "line_no", "number")


@page_query("consecutive_runs", page_sql("SELECT document, page, number, run_start, run_length FROM runs", islands("marked", "number", "number IS NOT NULL", "runs")))
def consecutive_runs(v):
    return D.consecutive_runs(D.numbered_lines(v("page_lines")).where("number IS NOT NULL"), ["document", "page"], "number")


@page_query("reliable_candidates", page_sql("""SELECT g.document, g.page, coalesce(r.n, 0) AS reliable, g.matched, g.header_lines, g.matched - coalesce(r.n, 0) AS outliers
FROM (SELECT document, page, count(DISTINCT CASE WHEN NOT strict THEN table_no END) AS matched, count(*) FILTER (WHERE strict) AS header_lines FROM marked WHERE table_no IS NOT NULL GROUP BY document, page) g
LEFT JOIN (SELECT document, page, count(*) AS n FROM runs GROUP BY document, page) r ON r.document = g.document AND r.page = g.page""", islands("marked", "table_no", "table_no IS NOT NULL AND NOT strict", "runs")))
def reliable_candidates(v):
    return D.reliable_candidates(v("page_lines"))


@page_query("approx_item_markers", page_sql(r"""SELECT g.document, g.page, greatest(coalesce(r.n, 0), g.bullets, g.labels) AS markers
FROM (SELECT document, page, count(*) FILTER (WHERE regexp_matches(text, '^\s*[-*•▪◦]\s+.*\pL')) AS bullets, count(*) FILTER (WHERE regexp_matches(text, '(?i)^\s*(?:ürün|urun|malzeme|product|item)\s+(?:adı|adi|name)\s*[:|]')) AS labels FROM marked GROUP BY document, page) g
LEFT JOIN (SELECT document, page, count(*) AS n FROM runs GROUP BY document, page) r ON r.document = g.document AND r.page = g.page""", islands("marked", "item_no", "item_no IS NOT NULL", "runs")))
def approx_item_markers(v):
    return D.approx_item_markers(v("page_lines"))


@page_query("page_ids_per_chunk", page_sql("""SELECT document, page, CAST(chunk_index AS INT) AS chunk_index, count(DISTINCT number) AS ids, min(number) AS first_id, max(number) AS last_id
FROM (SELECT m.document, m.page, (row_number() OVER (PARTITION BY m.document, m.page ORDER BY m.line_no) - 1) // 10 + 1 AS chunk_index, CAST(m.table_no AS INT) AS number, m.strict FROM marked m) c
WHERE number IS NOT NULL AND NOT strict AND EXISTS (SELECT 1 FROM runs r WHERE r.document = c.document AND r.page = c.page AND r.number = c.number) GROUP BY document, page, chunk_index""", islands("marked", "table_no", "table_no IS NOT NULL AND NOT strict", "runs")))
def page_ids_per_chunk(v):
    return D.page_ids_per_chunk(v("page_lines"))


STARTS = [
    islands("marked", "number", "number IS NOT NULL", "runs"),
    "counted AS (SELECT m.*, count(*) FILTER (WHERE explicit) OVER p AS explicit_count, count(number) OVER p AS numbered_count FROM marked m WINDOW p AS (PARTITION BY document, page))",
    r"""starts AS (SELECT c.*, coalesce((SELECT count(*) FROM runs r WHERE r.document = c.document AND r.page = c.page), 0) AS reliable_count,
  CASE WHEN explicit THEN 'EXPLICIT_LABEL' WHEN number IS NOT NULL AND (EXISTS (SELECT 1 FROM runs r WHERE r.document = c.document AND r.page = c.page AND r.number = c.number) OR (explicit_count >= 2 AND regexp_matches(text, '(?i)^\s*\d@14@\s*[.)\-:|;]\s*.*\|.*(?:toplam|miktar|quantity|qty)\s*[:|].*$'))) THEN 'NUMBERED' END AS start_kind FROM counted c)""",
]
SEGMENTS = [
    *STARTS,
    "placed AS (SELECT *, count(start_kind) OVER (PARTITION BY document, page ORDER BY line_no) AS ordinal, coalesce(bool_and(start_kind = 'NUMBERED') OVER (PARTITION BY document, page), false) AS all_numbered FROM starts)",
    r"ended AS (SELECT *, max(CASE WHEN start_kind IS NOT NULL OR NOT regexp_matches(text, '(?i)^\s*(?:(?:test\s+)?özet[i]?|(?:(?:genel|beklenen)\s+)?toplam)\s*[:：].*$') THEN line_no END) OVER (PARTITION BY document, page, ordinal) AS last_line FROM placed WHERE ordinal > 0)",
    "segments AS (SELECT document, page, CAST(ordinal AS BIGINT) AS ordinal, trim(string_agg(text, chr(10) ORDER BY line_no)) AS source_text, arg_min(text, line_no) AS first_line, max(start_kind) AS start_kind, CAST(CASE WHEN bool_and(all_numbered) THEN arg_min(number, line_no) ELSE ordinal END AS INT) AS record_id, max(explicit_count) AS explicit_count, max(reliable_count) AS reliable_count FROM ended WHERE line_no <= last_line GROUP BY document, page, ordinal)",
    r"""quantities AS (SELECT *, regexp_extract_all(source_text, '(?i)(?:talep\s+edilen\s+stok\s+miktar[ıi]|istenen\s+miktar|genel\s+toplam|toplam(?:\s+miktar)?|miktar|adet|quantity|qty)\s*[:|]?\s*(\d@19@)(?:\s*adet)?', 1) AS labelled FROM segments)""",
    rf"""anchored AS (SELECT *, coalesce(CASE WHEN len(labelled) > 0 THEN CAST(labelled[len(labelled)] AS INT) END, CASE WHEN regexp_matches(first_line, '{MARK}.*\pL') THEN TRY_CAST(nullif(regexp_extract(first_line, '(?i){MARK}.*?(?:[|;]\s*|\s+)(\d@19@)(?:\s*(?:adet|ad\.?|pcs?))?\s*$', 2), '') AS INT) END) AS quantity_anchor FROM quantities)""".replace("{1,4}", "@14@"),
]


@page_query("record_starts", page_sql("SELECT document, page, line_no, start_kind, explicit_count, reliable_count FROM starts", *STARTS))
def record_starts(v):
    return D.record_starts(v("page_lines")).select("document", "page", "line_no", "start_kind", "explicit_count", F.col("reliable_count").cast("bigint").alias("reliable_count"))


@page_query("segment_records", page_sql("SELECT document, page, ordinal, record_id, start_kind, source_text FROM segments", *SEGMENTS))
def segment_records(v):
    return D.segment_records(v("page_lines")).select("document", "page", "ordinal", "record_id", "start_kind", "source_text")


@page_query("quantity_anchor", page_sql("SELECT document, page, ordinal, quantity_anchor FROM anchored", *SEGMENTS))
def quantity_anchor(v):
    return D.segment_records(v("page_lines")).select("document", "page", "ordinal", "quantity_anchor")


def _pattern(p: str) -> str:
    return "(?i)" + p[p.index(")") + 1 :].replace("{1,4}", "@14@").replace("{1,9}", "@19@")


NAMES = [
    *SEGMENTS,
    rf"heads AS (SELECT *, {sql_trim('first_line')} AS line FROM anchored)",
    r"cores AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, '^\s*\d@14@', ''), '^[\x00-\x20]+', ''), '^[.)\-:|;]\s*', '') AS rest FROM heads)",
    rf"described AS (SELECT *, regexp_extract(rest, '(?is)^(.*?){_pattern(D.DESCRIPTION_START)[4:]}', 1) AS before, regexp_matches(rest, '{_pattern(D.DESCRIPTION_START)}') AS told FROM cores)",
    rf"""named AS (SELECT *, CASE WHEN start_kind = 'EXPLICIT_LABEL' THEN CASE WHEN regexp_matches(line, '[:|]') THEN nullif({sql_trim("regexp_extract(line, '(?s)^[^:|]*[:|](.*)$', 1)")}, '') END
  WHEN regexp_matches(line, '{MARK}.*\pL') THEN nullif({sql_trim("CASE WHEN contains(rest, '|') THEN split_part(rest, '|', 1) WHEN contains(rest, ' - ') THEN split_part(rest, ' - ', 1) WHEN told AND before <> '' THEN before END")}, '') END AS name_anchor FROM described)""".replace("{1,4}", "@14@"),
]
_NO_CODE = " OR ".join([*[f"{sql_fold('x')} = '{value}'" for value in D.NO_CODE_VALUES], *[f"contains({sql_fold('x')}, '{part}')" for part in D.NO_CODE_PARTS]])
CODES = [
    *NAMES,
    rf"coded AS (SELECT *, list_filter(list_transform(regexp_extract_all(source_text, '(?im){D.CODE_LABEL.removeprefix('(?iu)(?m)')}', 1), lambda x: {sql_trim('x')}), lambda x: NOT ({_NO_CODE})) AS codes FROM named)",
]


@page_query("name_anchor", page_sql("SELECT document, page, ordinal, name_anchor FROM named", *NAMES))
def name_anchor(v):
    return D.segment_records(v("page_lines")).select("document", "page", "ordinal", "name_anchor")


@page_query("code_anchor", page_sql("SELECT document, page, ordinal, codes[1] AS code_anchor, len(codes) = 0 AS code_absent FROM coded", *CODES))
def code_anchor(v):
    return D.segment_records(v("page_lines")).select("document", "page", "ordinal", "code_anchor", "code_absent")


@page_query("code_absent", page_sql("SELECT document, page, count(*) AS records, count(*) FILTER (WHERE len(codes) = 0) AS absent FROM coded GROUP BY document, page", *CODES))
def code_absent(v):
    """How many records of each page state no code."""
    r = D.segment_records(v("page_lines"))
    return r.groupBy("document", "page").agg(F.count("*").alias("records"), F.count_if(D.code_absent(F.col("source_text"))).alias("absent"))


@page_query("page_confidence", page_sql("""SELECT p.document, p.page, CASE WHEN r.n IS NULL THEN CASE WHEN greatest(p.numbered, p.explicit) > 0 THEN 'APPROXIMATE' ELSE 'UNKNOWN' END WHEN r.evident AND (p.reliable >= 3 OR p.explicit >= 2) THEN 'RELIABLE' ELSE 'APPROXIMATE' END AS confidence,
  CAST(coalesce(r.n, greatest(p.numbered, p.explicit)) AS BIGINT) AS markers, coalesce(r.kinds > 1, false) AS mixed
FROM (SELECT document, page, max(explicit_count) AS explicit, max(numbered_count) AS numbered, max(reliable_count) AS reliable FROM starts GROUP BY document, page) p
LEFT JOIN (SELECT document, page, count(*) AS n, bool_and(quantity_anchor IS NOT NULL) AS evident, count(DISTINCT start_kind) AS kinds FROM anchored GROUP BY document, page) r ON r.document = p.document AND r.page = p.page""", *SEGMENTS))
def page_confidence(v):
    return D.page_confidence(v("page_lines"))


@page_query("record_chunks", page_sql("SELECT document, page, CAST(chunk_index AS INT) AS chunk_index, min(record_id) AS first_record, max(record_id) AS last_record, count(*) AS record_count FROM (SELECT *, (row_number() OVER (PARTITION BY document, page ORDER BY ordinal) - 1) // 2 + 1 AS chunk_index FROM segments) s GROUP BY document, page, chunk_index", *SEGMENTS))
def record_chunks(v):
    return D.record_chunks(D.segment_records(v("page_lines")), 2)


def extracted_of(v):
    """What a model might answer for each record: some names and quantities moved."""
    columns = ["document", "ordinal", "record_id", "name_anchor", "quantity_anchor", "code_anchor", "code_absent"]
    rec = stage(D.segment_records(v("page_lines")).select(*columns), "records").withColumn("chunk_id", F.col("document")).withColumn("position", F.col("ordinal"))
    name = F.when(F.col("ordinal") % 3 == 0, F.concat(F.col("record_id").cast("string"), F.lit(". "), F.col("name_anchor"))).when(F.col("ordinal") % 5 == 0, "Bambaşka").otherwise(F.col("name_anchor"))
    out = rec.select("chunk_id", "position", name.alias("product_name"), F.when(F.col("ordinal") % 4 == 0, F.col("quantity_anchor") + 1).otherwise(F.col("quantity_anchor")).alias("quantity"), F.lit("UYDURMA").alias("product_code"))
    return rec, out


@page_query("suppress_invented_codes", page_sql("SELECT document AS chunk_id, ordinal AS position, codes[1] AS product_code FROM coded", *CODES))
def suppress_invented_codes(v):
    rec, out = extracted_of(v)
    chunks = rec.select("chunk_id").distinct().withColumn("code_absent", F.lit(True))
    return R.suppress_invented_codes(out, rec.select("chunk_id", "position", "code_anchor", "code_absent"), chunks)


def _fits(a: str, b: str) -> str:
    return f"coalesce({a} = {b} OR (length({a}) >= 4 AND contains({b}, {a})) OR (length({b}) >= 4 AND contains({a}, {b})), false)"


ALIGNED = [
    *NAMES,
    "answered AS (SELECT document, ordinal, record_id, name_anchor, quantity_anchor AS q, CASE WHEN ordinal % 4 = 0 THEN quantity_anchor + 1 ELSE quantity_anchor END AS quantity, CASE WHEN ordinal % 3 = 0 THEN CAST(record_id AS VARCHAR) || '. ' || name_anchor WHEN ordinal % 5 = 0 THEN 'Bambaşka' ELSE name_anchor END AS raw FROM named)",
    rf"shorn AS (SELECT *, nullif({sql_trim('raw')}, '') AS whole, regexp_replace(nullif({sql_trim('raw')}, ''), '^\s*' || CAST(record_id AS VARCHAR) || '\s*[.)\-:]?\s+', '') AS cut FROM answered)",
    f"spoken AS (SELECT *, CASE WHEN length(trim(cut)) > 0 THEN cut ELSE whole END AS name, {sql_alignment('name_anchor')} AS src FROM shorn)",
    f"heard AS (SELECT *, {sql_alignment('name')} AS heard, coalesce(src, {sql_alignment('name')}) AS final FROM spoken)",
    f"beside AS (SELECT h.document, h.ordinal, arg_min(r.record_id, r.ordinal) FILTER (WHERE {_fits('r.src', 'h.heard')}) AS other, bool_or(coalesce(r.q = h.quantity, false)) AS elsewhere FROM heard h JOIN heard r ON r.document = h.document AND r.ordinal <> h.ordinal GROUP BY h.document, h.ordinal)",
    "led AS (SELECT *, first_value(src) OVER (PARTITION BY document, final ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS led_by FROM heard)",
]


@page_query("align_pdf_records", page_sql(f"""SELECT l.document AS chunk_id, l.ordinal AS position, coalesce(l.name_anchor, l.name) AS product_name,
  CASE WHEN l.src IS NOT NULL AND NOT {_fits('l.src', 'l.heard')} THEN CASE WHEN b.other IS NOT NULL THEN 'fits record ' || CAST(b.other AS VARCHAR) ELSE 'name does not fit' END
    WHEN coalesce(b.elsewhere, false) AND coalesce(l.q <> l.quantity, false) THEN 'quantity of another record' WHEN l.final IS NOT NULL AND coalesce(l.led_by <> l.src, false) THEN 'one name for two records' END AS error
FROM led l LEFT JOIN beside b ON b.document = l.document AND b.ordinal = l.ordinal""", *ALIGNED))
def align_pdf_records(v):
    rec, out = extracted_of(v)
    return R.align_records(out, rec)
