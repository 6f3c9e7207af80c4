"""Queries of the import pipeline: validation, matching, consolidation, previews, confirmation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import scalars as S
from stockweave.operators import consolidate as K
from stockweave.operators import imports as I
from stockweave.operators import matching as M
from stockweave.operators import reconcile as R
from stockweave.sources.shared import stage

from .registry import query, sql_alignment, sql_canonical, sql_lower, sql_semantic, sql_trim

Q = "'"


def rows(v):
    """Import rows with the nested fields that operators read."""
    r = v("import_rows")
    ids = F.array("source_identity")
    names = F.when(F.col("position") % 3 == 0, F.create_map("source_identity", "product_name"))
    gap = F.when(F.col("quantity").isNull() & (F.col("position") % 2 == 0), F.array(F.concat(F.lit("gap-"), F.col("position").cast("string"))))
    return r.withColumns({
        "contributing_source_record_ids": ids, "authoritative_source_product_names": names, "preview_item_ids": F.array(F.concat(F.lit("item-"), F.col("position").cast("string"))),
        "resolved_source_record_id": F.lit(None).cast("string"), "resolved_source_record_ids": gap, "review_message": F.lit(None).cast("string"), "imported_quantity": F.when(F.col("position") % 53 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")),
    })


def gaps(v):
    r = v("import_rows").where("quantity IS NULL")
    pos = F.col("position")
    return r.select(F.concat(F.lit("gap-"), pos.cast("string")).alias("id"), F.when(pos % 3 == 0, "XLSX").when(pos % 3 == 1, "PDF").otherwise("CSV").alias("source_type"), F.when(pos % 5 != 0, F.col("document")).alias("worksheet_name"), F.col("row_number").alias("source_row_start"), (F.col("row_number") + pos % 2).cast("int").alias("source_row_end"), F.lit(1).alias("page_number"), F.col("row_number").alias("source_record_start"), (F.col("row_number") + pos % 2).cast("int").alias("source_record_end"), F.col("document"), F.col("row_number").alias("insertion_index"), pos.alias("gap_position"))


# ---- validation ----

ERRORS = f"""
SELECT position, concat_ws('; ',
  CASE WHEN n IS NULL THEN 'Ürün adı boş olamaz' WHEN length(n) > 255 THEN 'Ürün adı en fazla 255 karakter olabilir (alınan: ' || CAST(length(n) AS VARCHAR) || ')' END,
  CASE WHEN length(k) > 255 THEN 'Ürün kodu en fazla 255 karakter olabilir' END,
  CASE WHEN regexp_matches(k, '[\\x00-\\x1f]') THEN 'Ürün kodu satır sonu veya kontrol karakteri içeremez' END,
  CASE WHEN lower(regexp_replace(k, '\\s+', ' ', 'g')) = lower(regexp_replace(n, '\\s+', ' ', 'g')) THEN 'Ürün kodu, ürün adından kopyalanamaz' END,
  CASE WHEN quantity IS NULL THEN 'Geçersiz miktar: güvenilir bir miktar belirlenemedi' WHEN quantity <= 0 THEN 'Miktar 0''dan büyük olmalıdır (alınan: ' || CAST(quantity AS VARCHAR) || ')' END,
  CASE WHEN price < 0 THEN 'Fiyat 0''dan küçük olamaz' END) AS errors, review_required
FROM (SELECT *, nullif({sql_trim('product_name')}, '') AS n, nullif({sql_trim('product_code')}, '') AS k FROM {{import_rows}}) t"""


def with_errors(v):
    return rows(v).withColumn("e", S.structural_errors(F.col("product_name"), F.col("product_code"), F.col("quantity"), F.col("price")))


@query("structural_errors", f"SELECT position, errors FROM ({ERRORS}) e")
def structural_errors(v):
    return with_errors(v).select("position", F.array_join("e", "; ").alias("errors"))


@query("row_validity", f"SELECT position, errors = '' AND NOT review_required AS valid, nullif(errors, '') AS error_text FROM ({ERRORS}) e")
def row_validity(v):
    return with_errors(v).select("position", S.row_validity(F.col("e"), F.col("review_required")).alias("valid"), S.error_text(F.col("e")).alias("error_text"))


@query("coerce_price", "SELECT position, CAST(TRY_CAST(regexp_replace(replace(t, ',', '.'), '[^0-9.\\-]', '', 'g') AS DECIMAL(38, 18)) AS DOUBLE) AS price FROM (SELECT position, CASE WHEN position % 4 = 0 THEN 'yok' WHEN position % 3 = 0 THEN concat(CAST(quantity AS VARCHAR), ',50 TL') ELSE concat('₺ ', CAST(quantity AS VARCHAR)) END AS t FROM {import_rows} WHERE quantity IS NOT NULL) x")
def coerce_price(v):
    q = F.col("quantity").cast("string")
    t = F.when(F.col("position") % 4 == 0, "yok").when(F.col("position") % 3 == 0, F.concat(q, F.lit(",50 TL"))).otherwise(F.concat(F.lit("₺ "), q))
    return v("import_rows").where("quantity IS NOT NULL").select("position", S.coerce_price(t).cast("double").alias("price"))


@query("positive_int_cell", r"SELECT document, row, col, CASE WHEN regexp_matches(trim(value), '^[0-9]+$') THEN CASE WHEN TRY_CAST(trim(value) AS INT) > 0 THEN TRY_CAST(trim(value) AS INT) END END AS n FROM {sheet_cells}")
def positive_int_cell(v):
    return v("sheet_cells").select("document", "row", "col", S.positive_int_cell(F.col("value")).alias("n"))


RESPONSE_SQL = """
SELECT CAST(position AS STRING) AS chunk_id, CASE WHEN position % 10 = 0 THEN '' WHEN position % 10 = 1 THEN 'none' ELSE concat('```json [{"sourceRecordId":"', source_identity, '","productCode":"K-1","productName":"x","quantity":',
  CASE position % 5 WHEN 0 THEN 'null' WHEN 1 THEN concat('"', CAST(row_number AS STRING), ' bidon"') WHEN 2 THEN concat(CAST(row_number AS STRING), '.5') ELSE CAST(row_number AS STRING) END,
  ',"price":"', CAST(row_number AS STRING), ',25"}] ```') END AS response FROM {import_rows}"""


def responses(v):
    r = v("import_rows")
    text = RESPONSE_SQL.replace("[{", "[{{").replace("}]", "}}]").replace("{import_rows}", "{r}")
    return r.sparkSession.sql(text, r=r)


EXTRACTED = """
SELECT CAST(position AS VARCHAR) AS chunk_id, CASE WHEN position % 10 > 1 THEN source_identity END AS source_record_id, CASE WHEN position % 10 > 1 THEN 'K-1' END AS product_code,
  CASE WHEN position % 10 > 1 THEN CASE position % 5 WHEN 0 THEN NULL WHEN 2 THEN row_number + 1 ELSE row_number END END AS quantity, CASE WHEN position % 10 > 1 THEN row_number + 0.25 END AS price, position % 10 <= 1 AS malformed FROM {import_rows}"""


@query("extraction_json", f"SELECT chunk_id, source_record_id, product_code, CAST(quantity AS INT) AS quantity, CAST(price AS DOUBLE) AS price, malformed FROM ({EXTRACTED}) t")
def extraction_json(v):
    e = R.extraction_json(responses(v))
    return e.select("chunk_id", "source_record_id", "product_code", "quantity", F.col("price").cast("double").alias("price"), "malformed")


@query("coerce_quantity", f"SELECT chunk_id, CAST(quantity AS INT) AS quantity FROM ({EXTRACTED}) t WHERE NOT malformed")
def coerce_quantity(v):
    return R.extraction_json(responses(v)).where("NOT malformed").select("chunk_id", "quantity")


SUSPECT = "CASE position % 6 WHEN 0 THEN concat(product_name, ' 12V 5mm') WHEN 1 THEN concat(product_name, ' 100 ml şişe') WHEN 2 THEN concat(product_name, ' uygundur. a, b; c: d') WHEN 3 THEN 'Rulo 5 mm çap' ELSE product_name END"


def suspects(v):
    r = v("import_rows")
    return r.sparkSession.sql(f"SELECT position, document, {SUSPECT} AS product_name, CASE WHEN position % 7 = 0 THEN product_name WHEN position % 7 = 1 THEN 'Başka' END AS source_name, position % 7 = 0 AND position % 2 = 0 AS trusted_name FROM {{r}}", r=r)


def judged(v):
    named = suspects(v).select("position", "product_name", "source_name")
    return R.with_suspicion(named, {"rules": ("product_name", "source_name")}, composed=True).withColumn("s", S.suspicion(F.col("rules")))


def _re2(pattern: str) -> str:
    """A pattern of the domain as SQL text: the SQL engine knows no u flag, and its word boundary is ASCII."""
    bare = pattern[pattern.index(")") + 1 :]
    return "(?i)" + bare.replace(r"\b(?:", r"(?:^|[^\pL\pN_])(?:").replace(r")\b", r")(?:[^\pL\pN_]|$)").replace("'", "''")


_TERMS = " + ".join(f"CASE WHEN contains(low, '{t}') THEN 1 ELSE 0 END" for t in S.TECHNICAL_TERMS)
_RULES = [("m", "4", "mismatch"), ("lines", "2", "lines"), ("sentence", "3", "sentence"), ("terms >= 2", "2", "technical"), ("numbers >= 2", "4", "numbers"), ("dimension", "4", "dimension"), ("packaging", "4", "packaging"), ("full_sentence", "2", "full_sentence"), ("marks >= 3", "1", "punctuation")]
SUSPICION = rf"""WITH suspect AS (SELECT position, document, {SUSPECT} AS product_name, CASE WHEN position % 7 = 0 THEN product_name WHEN position % 7 = 1 THEN 'Başka' END AS source_name, position % 7 = 0 AND position % 2 = 0 AS trusted_name FROM {{import_rows}}),
cleaned AS (SELECT *, nullif({sql_trim('product_name')}, '') AS n, nullif({sql_trim('source_name')}, '') AS s FROM suspect),
felt AS (SELECT *, {sql_lower('n')} AS low, coalesce({sql_semantic('n')} <> {sql_semantic('s')}, false) AS m, len(list_filter(regexp_split_to_array(n, '\r\n|\r|\n'), lambda x: length(trim(x)) > 0)) >= 2 AS lines, regexp_matches(n, '{_re2(S.SENTENCE_PHRASE)}') AS sentence,
  len(regexp_extract_all(n, '{_re2(S.SPECIFICATION_NUMBER)}')) AS numbers, regexp_matches(n, '{_re2(S.DIMENSION_PHRASE)}') AS dimension, regexp_matches(n, '{_re2(S.PACKAGING_PHRASE)}') AS packaging, len(regexp_split_to_array(n, '\s+')) >= 12 AND regexp_matches(n, '[.!?]\s*$') AS full_sentence,
  length(n) - length(translate(n, ',;:.()', '')) AS marks FROM cleaned),
counted AS (SELECT *, {_TERMS} AS terms FROM felt),
judged AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE {' + '.join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for test, points, _ in _RULES)} + CASE WHEN terms = 1 THEN 1 ELSE 0 END + CASE WHEN numbers = 1 THEN 1 ELSE 0 END END AS score,
  CASE WHEN n IS NULL THEN '' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN {test} THEN '{S.SIGNALS[key]}' END" for test, _, key in _RULES)}], lambda x: x IS NOT NULL), '; ') END AS signals FROM counted),
doubted AS (SELECT *, n IS NOT NULL AND (m OR score >= 4) AS suspicious FROM judged)"""
MESSAGE = f"CASE WHEN contains(signals, '{S.SIGNALS['mismatch']}') THEN '{S.MISMATCH_MESSAGE}' ELSE '{S.TECHNICAL_MESSAGE}' END"


@query("name_suspicion", f"{SUSPICION} SELECT position, suspicious, score, signals FROM doubted")
def name_suspicion(v):
    return judged(v).select("position", "s.suspicious", "s.score", F.array_join("s.signals", "; ").alias("signals"))


@query("suspicion_message", f"{SUSPICION} SELECT position, {MESSAGE} AS message FROM doubted WHERE suspicious")
def suspicion_message(v):
    return judged(v).where("s.suspicious").select("position", S.suspicion_message(F.col("s.signals")).alias("message"))


@query("name_review_outcome", f"""{SUSPICION},
decided AS (SELECT *, CASE WHEN trusted_name AND s IS NOT NULL AND length(s) <= 255 THEN 'SOURCE' WHEN trusted_name AND s IS NOT NULL THEN 'SOURCE_TOO_LONG' WHEN position % 3 = 0 THEN 'CONFIRMED' WHEN position % 3 = 1 AND NOT coalesce({sql_semantic('s')} <> 'düzad', false) THEN 'CORRECTED' WHEN position % 3 = 1 THEN 'BAD_CORRECTION' ELSE 'REVIEW' END AS outcome FROM doubted WHERE suspicious),
told AS (SELECT *, CASE outcome WHEN 'SOURCE_TOO_LONG' THEN '{R.NAME_TOO_LONG}' WHEN 'BAD_CORRECTION' THEN '{R.BAD_CORRECTION}' WHEN 'REVIEW' THEN 'belirsiz' END AS review_message FROM decided)
SELECT position AS row_id, CASE outcome WHEN 'SOURCE' THEN s WHEN 'CORRECTED' THEN 'Düz Ad' ELSE product_name END AS product_name, review_message IS NOT NULL AS review_required, review_message, outcome FROM told""")
def name_review_outcome(v):
    r = suspects(v).withColumnRenamed("position", "row_id")
    d = r.select("row_id", F.when(F.col("row_id") % 3 == 0, "CONFIRMED").when(F.col("row_id") % 3 == 1, "CORRECTED").otherwise("REVIEW_REQUIRED").alias("status"), F.lit("Düz Ad").alias("product_name"), F.lit("belirsiz").alias("reason"))
    return R.name_review_outcome(r, d)


@query("source_identity", "SELECT position, concat('xlsx:', document, ':row:', CAST(row_number AS STRING)) AS identity FROM {import_rows}")
def source_identity(v):
    return v("import_rows").select("position", S.source_identity(F.col("document"), F.col("row_number")).alias("identity"))


@query("parse_source_identity", r"SELECT position, regexp_extract(source_identity, '^xlsx:(.*):row:(\d+)$', 1) AS sheet, CAST(regexp_extract(source_identity, '^xlsx:(.*):row:(\d+)$', 2) AS BIGINT) AS row FROM {import_rows}")
def parse_source_identity(v):
    return v("import_rows").select("position", S.parse_source_identity(F.col("source_identity")).alias("p")).select("position", "p.sheet", "p.row")


GAPS_SQL = "SELECT concat('gap-', CAST(position AS STRING)) AS id, CASE position % 3 WHEN 0 THEN 'XLSX' WHEN 1 THEN 'PDF' ELSE 'CSV' END AS source_type, CASE WHEN position % 5 <> 0 THEN document END AS sheet, row_number AS a, row_number + position % 2 AS b, position, document FROM {import_rows} WHERE quantity IS NULL"


@query("gap_location", f"""SELECT id, CASE source_type WHEN 'XLSX' THEN coalesce(sheet, 'Çalışma sayfası') || ' · satır ' || CAST(a AS VARCHAR) || CASE WHEN a = b THEN '' ELSE '-' || CAST(b AS VARCHAR) END
  WHEN 'PDF' THEN 'PDF sayfa 1 · kayıt ' || CAST(a AS VARCHAR) || CASE WHEN a = b THEN '' ELSE '-' || CAST(b AS VARCHAR) END ELSE 'Kaynak konumu belirlenen kayıt' END AS location FROM ({GAPS_SQL}) g""")
def gap_location(v):
    g = gaps(v)
    return g.select("id", S.gap_location(*[F.col(c) for c in ("source_type", "worksheet_name", "source_row_start", "source_row_end", "page_number", "source_record_start", "source_record_end")]).alias("location"))


# ---- matching ----

KEYED = f"keyed AS (SELECT *, {sql_canonical('name')} AS key FROM {{products}}), imports AS (SELECT *, {sql_canonical('product_name')} AS key FROM {{import_rows}})"


@query("canonical_match", f"WITH {KEYED} SELECT i.position, i.key, count(k.id) AS matches, min(k.id) AS first_id, coalesce(string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.id), '') AS ids FROM imports i LEFT JOIN keyed k ON k.key = i.key GROUP BY i.position, i.key")
def canonical_match(v):
    return M.canonical_match(v("import_rows"), v("products")).select("position", "key", "matches", "first_id", "ids")


@query("source_filtered_match", f"WITH {KEYED} SELECT i.position, count(k.id) AS matches, min(k.id) AS first_id, coalesce(string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.id), '') AS ids FROM imports i LEFT JOIN keyed k ON k.key = i.key AND k.source IS NULL GROUP BY i.position")
def source_filtered_match(v):
    return M.source_filtered_match(v("import_rows"), v("products"), None).select("position", "matches", "first_id", "ids")


@query("matched_products", f"""WITH {KEYED} SELECT key, id, name || ' — ' || coalesce(source, 'Kaynak belirtilmemiş') || ' — ' || coalesce(unit, 'Birim belirtilmemiş') || ' — stok ' || CAST(quantity AS VARCHAR) AS summary
FROM keyed WHERE key IN (SELECT key FROM imports)""")
def matched_products(v):
    return M.matched_products(v("import_rows"), v("products")).select("key", "id", "summary")


ONE = lambda c: f"(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END) <= 1"
ALIKE = " AND ".join(ONE(c) for c in ("category_id", "source", "unit", "min_stock_level", "shelf_location"))


@query("match_group_resolution", f"WITH {KEYED} SELECT key, count(*) AS matches, {ALIKE} AS safe, CASE WHEN {ALIKE} THEN min(id) END AS target_id, CAST(CASE WHEN {ALIKE} THEN sum(quantity) ELSE 0 END AS BIGINT) AS total_stock FROM keyed WHERE key IS NOT NULL GROUP BY key")
def match_group_resolution(v):
    return M.match_group_resolution(v("products"))


def _shown(c: str) -> str:
    return f"CASE WHEN length(trim(CAST({c} AS VARCHAR))) > 0 THEN CAST({c} AS VARCHAR) ELSE 'Belirtilmemiş' END"


_FIELDS = [("Kategori", "category_id", "category"), ("Kaynak", "source", "source"), ("Birim", "unit", "unit"), ("Minimum stok", "min_stock_level", "min_stock_level"), ("Raf konumu", "shelf_location", "shelf_location")]
CONFLICTS = f"""seen AS ({' UNION ALL '.join(f"SELECT key, {n} AS n, '{f}' AS field, {_shown(s)} AS value, min(id) AS first_id FROM keyed WHERE key IS NOT NULL GROUP BY key, {_shown(s)}" for n, (f, _, s) in enumerate(_FIELDS))}),
differ AS ({' UNION ALL '.join(f"SELECT key, {n} AS n FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING NOT ({ONE(c)})" for n, (_, c, _) in enumerate(_FIELDS))}),
fields AS (SELECT s.key, s.n, s.field, string_agg(s.value, ' / ' ORDER BY s.first_id) AS shown FROM seen s JOIN differ d ON d.key = s.key AND d.n = s.n GROUP BY s.key, s.n, s.field),
lists AS (SELECT key, list(field ORDER BY n) AS fs, min(shown) AS only_shown FROM fields GROUP BY key)"""


@query("match_conflict_details", f"""WITH {KEYED}, {CONFLICTS} SELECT key, array_to_string(fs, '|') AS fields,
  CASE WHEN len(fs) = 1 THEN fs[1] || ' farklı: ' || only_shown ELSE array_to_string(fs[1:len(fs) - 1], ', ') || ' ve ' || fs[len(fs)] || ' farklı.' END AS message FROM lists""")
def match_conflict_details(v):
    return M.match_conflict_details(v("products")).select("key", F.array_join("fields", "|").alias("fields"), "message")


PREVIEW = f"""WITH {KEYED},
hits AS (SELECT i.position, count(k.id) AS n_all, count(k.id) FILTER (WHERE k.source = 'Belediye') AS n_own, min(k.id) FILTER (WHERE k.source = 'Belediye') AS own_id, min(k.quantity) FILTER (WHERE k.source = 'Belediye') AS own_stock FROM imports i LEFT JOIN keyed k ON k.key = i.key GROUP BY i.position),
state AS (SELECT i.*, h.n_all, h.n_own, h.own_id, h.own_stock, CASE WHEN nullif({sql_trim('i.product_name')}, '') IS NULL OR coalesce(i.quantity, 0) < 1 THEN NULL WHEN n_all = 0 THEN 'new' WHEN n_own = 1 THEN 'existing' ELSE 'review' END AS state FROM imports i JOIN hits h ON h.position = i.position)"""


PRINTED = "concat_ws(':', CAST(id AS VARCHAR), coalesce(name, 'null'), coalesce(source, 'null'), coalesce(unit, 'null'), coalesce(CAST(category_id AS VARCHAR), 'null'), coalesce(CAST(min_stock_level AS VARCHAR), 'null'), coalesce(shelf_location, 'null'), coalesce(CAST(quantity AS VARCHAR), 'null')) || '|'"
HASHED = f"hashed AS (SELECT key, md5(key || '|Belediye|' || string_agg({PRINTED}, '' ORDER BY id)) AS h FROM keyed WHERE key IS NOT NULL GROUP BY key)"


def _uuid(h: str) -> str:
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1 AS INT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query("match_preview", f"""{PREVIEW}, {CONFLICTS}, {HASHED} SELECT position, CASE state WHEN 'new' THEN 'Yeni ürün' WHEN 'existing' THEN 'Mevcut ürün' WHEN 'review' THEN 'Kontrol gerekli' END AS match_status,
  CASE state WHEN 'new' THEN 'NEW' WHEN 'existing' THEN 'EXISTING' END AS resolution_type, CASE WHEN state = 'existing' THEN own_id END AS selected_product_id, CASE WHEN state = 'existing' THEN own_stock END AS existing_stock, CAST(CASE WHEN state = 'existing' THEN own_stock + quantity END AS BIGINT) AS projected_stock,
  coalesce(state = 'review', false) AS match_review_required, review_required AS document_review_required, review_required OR coalesce(state = 'review', false) AS review_required,
  CASE WHEN state = 'review' THEN CASE WHEN n_own = 0 THEN 'Bu ürün adıyla mevcut kayıtlar bulundu ancak seçilen kaynak Belediye ile eşleşen kayıt yok.' ELSE 'Seçilen kaynak Belediye için ' || CAST(n_own AS VARCHAR) || ' mevcut kayıt bulundu; hedef kayıt seçilmelidir.' END END AS review_message,
  CASE WHEN nullif({sql_trim('product_name')}, '') IS NOT NULL AND quantity >= 1 THEN {_uuid("coalesce(h, md5(key || '|Belediye|'))")} END AS match_fingerprint, coalesce(array_to_string(fs, '|'), '') AS conflict_fields
  FROM state LEFT JOIN hashed USING (key) LEFT JOIN lists USING (key)""")
def match_preview(v):
    m = M.match_preview(rows(v), v("products"), "Belediye")
    return m.select("position", "match_status", "resolution_type", "selected_product_id", "existing_stock", "projected_stock", "match_review_required", "document_review_required", "review_required", "review_message", "match_fingerprint", F.array_join("conflict_fields", "|").alias("conflict_fields"))


@query("match_fingerprint", f"WITH {KEYED}, {HASHED} SELECT key, {_uuid('h')} AS fingerprint FROM hashed")
def match_fingerprint(v):
    return M.fingerprints(v("products"), "Belediye")


@query("manual_resolution_options", f"WITH {KEYED}, g AS (SELECT key, count(*) FILTER (WHERE source = 'T3') AS own FROM keyed WHERE key IS NOT NULL GROUP BY key) SELECT key, id, own = 0 AS allow_new FROM keyed JOIN g USING (key) WHERE own = 0 OR source = 'T3'")
def manual_resolution_options(v):
    return M.manual_resolution_options(v("products"), "T3")


# ---- consolidation ----

ONCE = f"once AS (SELECT key, source_identity, arg_min(quantity, position) AS quantity, min(position) AS position FROM (SELECT *, {sql_canonical('product_name')} AS key FROM {{import_rows}}) i WHERE key IS NOT NULL AND quantity IS NOT NULL"


@query("consolidate_single", f"WITH {ONCE} GROUP BY key, source_identity) SELECT key, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS sources, min(position) AS first_position, sum(quantity) <= 2147483647 AS accepted FROM once GROUP BY key")
def consolidate_single(v):
    return K.consolidate_single(v("import_rows"))


@query("consolidate_import", f"""WITH {ONCE} AND NOT source_identity_review_required GROUP BY key, source_identity)
SELECT min(position) AS first_position, key, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS sources, false AS passed_through FROM once GROUP BY key
UNION ALL SELECT position, key, quantity, CASE WHEN quantity IS NULL AND position % 2 = 0 THEN 2 ELSE 1 END, true FROM (SELECT *, {sql_canonical('product_name')} AS key FROM {{import_rows}}) i WHERE source_identity_review_required OR key IS NULL OR quantity IS NULL""")
def consolidate_import(v):
    c = K.consolidate_import(rows(v))
    return c.select("first_position", "key", "quantity", F.size("source_ids").cast("bigint").alias("sources"), "passed_through")


def overlapping_rows(v):
    """Import rows that share ids: of none, one or two ids; every second id of a product has a trusted name, which some rows spell otherwise."""
    p = F.col("position")
    a = F.concat(F.lit("a"), (p % 23).cast("string"))
    ids = F.when(p % 4 == 0, F.array(a)).when(p % 4 == 1, F.array(a, F.concat(F.lit("a"), (p % 19).cast("string")))).when(p % 4 == 2, F.array(F.concat(F.lit("b"), p.cast("string")), F.lit(" ")))
    spelt = F.when(p % 31 == 4, F.replace("product_name", F.lit(" "), F.lit("_"))).otherwise(F.col("product_name"))
    own = F.create_map(F.when(p % 97 == 1, F.lit("other")).otherwise(a), spelt)
    return rows(v).withColumns({"contributing_source_record_ids": ids, "authoritative_source_product_names": F.when((p % 4 < 2) & (p % 8 != 0), own)})


OVERLAPS = f"""WITH i AS (
  SELECT position, product_name, CAST(quantity AS BIGINT) AS quantity, source_identity_review_required AS review, 'a' || (position % 23) AS a,
    CASE position % 4 WHEN 0 THEN ['a' || (position % 23)] WHEN 1 THEN list_distinct(['a' || (position % 23), 'a' || (position % 19)]) WHEN 2 THEN ['b' || position] ELSE [] END || CASE WHEN quantity IS NULL AND position % 2 = 0 THEN ['gap-' || position] ELSE [] END AS ids,
    position % 4 < 2 AND position % 8 <> 0 AS named, {sql_trim("CASE WHEN position % 31 = 4 THEN replace(product_name, ' ', '_') ELSE product_name END")} AS spelt
  FROM {{import_rows}}),
e AS (SELECT *, CASE WHEN named AND position % 97 = 1 THEN 'a trusted name is of no source row of this row' END AS own_error FROM i),
r AS (SELECT *, {sql_canonical('CASE WHEN named AND own_error IS NULL THEN spelt ELSE product_name END')} AS key FROM e),
good AS (SELECT * FROM r WHERE NOT review AND key IS NOT NULL AND quantity IS NOT NULL AND own_error IS NULL),
uses AS (SELECT key, position, unnest(ids) AS id FROM good),
firsts AS (SELECT key, id, min(position) AS first FROM uses GROUP BY ALL),
late AS (SELECT key, position, count(*) AS earlier FROM uses JOIN firsts USING (key, id) WHERE first < position GROUP BY ALL),
spelling AS (SELECT key, a, arg_min(spelt, position) AS spelt FROM good WHERE named GROUP BY ALL),
d AS (SELECT g.*, coalesce(earlier, 0) AS earlier, named AND g.spelt <> s.spelt AS clash FROM good g LEFT JOIN late USING (key, position) LEFT JOIN spelling s USING (key, a)),
g AS (
  SELECT key, min(position) AS first_position, CAST(sum(CASE WHEN earlier > 0 AND earlier = len(ids) THEN 0 ELSE quantity END) AS BIGINT) AS quantity, count(*) AS members,
    min(position) FILTER (WHERE earlier > 0 AND earlier < len(ids)) AS overlap_at, min(position) FILTER (WHERE clash) AS clash_at FROM d GROUP BY key),
counts AS (SELECT key, count(*) AS sources FROM firsts GROUP BY key)"""


@query("consolidate_overlaps", f"""{OVERLAPS}
SELECT first_position, key, quantity, coalesce(sources, 0) AS sources, members,
  CASE WHEN overlap_at <= coalesce(clash_at, overlap_at) THEN 'a source row contributes twice' WHEN clash_at IS NOT NULL THEN 'a source row has two names' END AS error, false AS passed_through
FROM g LEFT JOIN counts USING (key)
UNION ALL SELECT position, key, quantity, len(ids), 1, own_error, true FROM r WHERE review OR key IS NULL OR quantity IS NULL OR own_error IS NOT NULL""")
def consolidate_overlaps(v):
    groups, _ = K.consolidate_groups(overlapping_rows(v))
    return groups.select("first_position", "key", "quantity", "sources", "members", "error", "passed_through")


@query("consolidated_members", f"""{OVERLAPS}
SELECT first_position, 'source' AS kind, id, CAST(NULL AS VARCHAR) AS value, first AS position FROM firsts JOIN g USING (key)
UNION ALL SELECT first_position, 'name', a, s.spelt, min(d.position) FROM d JOIN spelling s USING (key, a) JOIN g USING (key) WHERE named GROUP BY ALL
UNION ALL SELECT first_position, 'item', 'item-' || d.position, NULL, d.position FROM d JOIN g USING (key)
UNION ALL SELECT position, unnest(['source'] || CASE WHEN id LIKE 'gap-%' THEN ['resolved'] ELSE [] END), id, NULL, position FROM (SELECT position, unnest(ids) AS id FROM r WHERE review OR key IS NULL OR quantity IS NULL OR own_error IS NOT NULL)
UNION ALL SELECT position, 'item', 'item-' || position, NULL, position FROM r WHERE review OR key IS NULL OR quantity IS NULL OR own_error IS NOT NULL
UNION ALL SELECT position, 'name', CASE WHEN position % 97 = 1 THEN 'other' ELSE a END, spelt, position FROM r WHERE named AND (review OR key IS NULL OR quantity IS NULL OR own_error IS NOT NULL)""")
def consolidated_members(v):
    _, members = K.consolidate_groups(overlapping_rows(v))
    return members.select("first_position", "kind", "id", "value", "position")


@query("validate_provenance", f"""WITH i AS (SELECT *, {sql_canonical('product_name')} AS key FROM {{import_rows}} WHERE position % 3 = 0),
seen AS (SELECT DISTINCT key, source_identity, CAST(NULL AS BIGINT) AS position FROM i WHERE NOT source_identity_review_required AND key IS NOT NULL AND quantity IS NOT NULL
  UNION ALL SELECT key, source_identity, position FROM i WHERE source_identity_review_required OR key IS NULL OR quantity IS NULL)
SELECT source_identity AS source_id, 'counted more than once' AS problem FROM seen GROUP BY source_identity HAVING count(*) > 1""")
def validate_provenance(v):
    r = rows(v)
    return K.validate_provenance(r, K.consolidate_groups(r)[1])


@query("consolidation_stats", f"""WITH {ONCE} AND NOT source_identity_review_required GROUP BY key, source_identity),
g AS (SELECT count(*) AS n FROM once GROUP BY key UNION ALL SELECT CASE WHEN quantity IS NULL AND position % 2 = 0 THEN 2 ELSE 1 END FROM (SELECT *, {sql_canonical('product_name')} AS key FROM {{import_rows}}) i WHERE source_identity_review_required OR key IS NULL OR quantity IS NULL)
SELECT CAST(sum(n) AS BIGINT) AS physical_contributions, count(*) AS logical_rows, count(*) FILTER (WHERE n > 1) AS multi_source_groups, CAST(sum(n - 1) AS BIGINT) AS rows_reduced FROM g""")
def consolidation_stats(v):
    return K.consolidation_stats(K.consolidate_groups(rows(v))[0])


@query("contribution_overlap", """SELECT position, CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 'contained' WHEN list_has_any(a, b) THEN 'overlapping' ELSE 'disjoint' END AS how
FROM (SELECT position, [position % 5, position % 7] AS a, [position % 3, position % 5] AS b FROM {import_rows}) t""")
def contribution_overlap(v):
    p = F.col("position")
    return v("import_rows").select("position", K.contribution_overlap(F.array(p % 5, p % 7), F.array(p % 3, p % 5)).alias("how"))


# ---- previews and gaps ----


@query("unresolved_gaps", "SELECT concat('gap-', CAST(position AS STRING)) AS id FROM {import_rows} WHERE quantity IS NULL AND position % 2 <> 0")
def unresolved_gaps(v):
    return K.unresolved_gaps(gaps(v), rows(v)).select("id")


@query("gap_coverage", "SELECT concat('gap-', CAST(position AS STRING)) AS id, CASE WHEN position % 2 <> 0 THEN 'missing' ELSE 'unexpected' END AS problem FROM {import_rows} WHERE quantity IS NULL AND (position % 2 <> 0 OR position % 4 = 0)")
def gap_coverage(v):
    return K.gap_coverage(rows(v), gaps(v).where("gap_position % 4 <> 0"))


@query("preview_counts", "SELECT count(*) FILTER (WHERE (quantity IS NULL OR quantity <= 0) AND NOT review_required) AS invalid, count(*) FILTER (WHERE review_required) AS review, count(*) AS products, (SELECT count(*) FROM {import_rows} WHERE quantity IS NULL) AS unresolved FROM {import_rows}")
def preview_counts(v):
    r = rows(v).withColumn("is_valid", F.coalesce(F.col("quantity") > 0, F.lit(False))).withColumn("error_message", F.lit(None).cast("string"))
    return K.preview_counts(r, gaps(v))


@query("can_confirm_import", "SELECT count(*) > 0 AND bool_and(coalesce(quantity > 0, false) AND NOT review_required) AND (SELECT count(*) = 0 FROM {import_rows} WHERE quantity IS NULL AND position % 2 <> 0) AS can_confirm FROM {import_rows}")
def can_confirm_import(v):
    r = rows(v).withColumn("is_valid", F.coalesce(F.col("quantity") > 0, F.lit(False))).withColumn("error_message", F.lit(None).cast("string")).withColumn("resolution_type", F.lit("NEW"))
    return K.can_confirm_import(r, gaps(v), "preview", "T3")


NOW = "2024-05-01 10:00:00"


def snapshot(v):
    return K.register_preview_snapshot(rows(v), "preview", F.lit(NOW).cast("timestamp"))


@query("register_preview_snapshot", f"SELECT concat('item-', CAST(position AS STRING)) AS item_id, quantity AS imported_quantity, source_identity AS contribution_id, CASE WHEN quantity IS NULL AND position % 2 = 0 THEN 1 ELSE 0 END AS gaps, position % 3 = 0 AS named, source_identity_review_required AS review_required, true AS locked, CAST('{NOW}' AS TIMESTAMP) + INTERVAL 30 MINUTE AS expires_at FROM {{import_rows}}")
def register_preview_snapshot(v):
    s = snapshot(v)
    return s.select("item_id", "imported_quantity", F.get("contribution_ids", F.lit(0)).alias("contribution_id"), F.size("gap_ids").alias("gaps"), (F.size("authoritative_names") > 0).alias("named"), "review_required", "locked", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("active_previews", f"SELECT item_id FROM (SELECT concat('item-', CAST(position AS STRING)) AS item_id, CAST('{NOW}' AS TIMESTAMP) + INTERVAL '1' MINUTE * (position % 60) AS expires_at FROM {{import_rows}}) t WHERE expires_at > CAST('2024-05-01 10:30:00' AS TIMESTAMP)")
def active_previews(v):
    r = v("import_rows")
    s = r.sparkSession.sql(f"SELECT concat('item-', CAST(position AS STRING)) AS item_id, CAST('{NOW}' AS TIMESTAMP) + INTERVAL '1' MINUTE * (position % 60) AS expires_at FROM {{r}}", r=r)
    return K.active_previews(s, F.lit("2024-05-01 10:30:00").cast("timestamp")).select("item_id")


@query("restore_preview", """SELECT position AS row_id, CASE WHEN position % 23 = 0 THEN 'unknown item' WHEN position % 29 <> 0 AND position % 17 = 0 THEN 'quantity was changed' END AS reason FROM {import_rows}""")
def restore_preview(v):
    r = rows(v)
    items = F.when(F.col("position") % 23 == 0, F.array(F.lit("lost"), F.concat(F.lit("lost"), F.col("position").cast("string")))).otherwise(F.col("preview_item_ids"))
    s = r.select(F.col("position").alias("row_id"), F.when(F.col("position") % 17 == 0, F.col("quantity") + 3).otherwise(F.col("quantity")).alias("quantity"), items.alias("preview_item_ids"), "resolved_source_record_ids")
    return K.restore_preview(s, snapshot(v), gaps(v)).select("row_id", "reason")


@query("renumber_with_gaps", f"""SELECT document, place, is_manual, row_number() OVER (PARTITION BY document ORDER BY place, NOT is_manual) AS row_number
FROM (SELECT document, position % 1000 AS place, false AS is_manual FROM {{import_rows}} WHERE quantity IS NOT NULL UNION ALL SELECT document, a, true FROM ({GAPS_SQL}) g) t""")
def renumber_with_gaps(v):
    parsed = v("import_rows").where("quantity IS NOT NULL").select("document", (F.col("position") % 1000).alias("position"))
    manual = gaps(v).select("document", "insertion_index", F.lit(0).alias("gap_ordinal"))
    return R.renumber_with_gaps(parsed, manual).select("document", "place", "is_manual", "row_number")


# ---- confirmation ----


def to_confirm(v):
    """Rows as a user confirms them: previewed and cleaned, some with stale fingerprints or choices."""
    m = M.match_preview(rows(v).where("quantity >= 1 AND NOT review_required AND NOT source_identity_review_required").withColumn("review_required", F.lit(False)), v("products"), "Belediye")
    p = F.col("position")
    review = F.col("match_review_required")
    return m.select(
        F.col("document").alias("batch_id"), "position", "product_name", F.when(p % 41 != 0, F.col("product_code")).alias("product_code"), "quantity", F.lit(None).cast("decimal(12,2)").alias("price"), F.col("quantity").alias("imported_quantity"), F.lit(None).cast("string").alias("canonical_name"),
        F.when(review & (p % 3 == 0), "NEW").otherwise(F.col("resolution_type")).alias("resolution_type"), "selected_product_id", F.when(p % 97 == 0, "stale").otherwise(F.col("match_fingerprint")).alias("match_fingerprint"), F.lit(True).alias("is_valid"), F.lit(False).alias("review_required"), F.lit(False).alias("match_review_required"),
    )


CONFIRM = f"""{PREVIEW.replace('FROM imports i JOIN hits', 'FROM imports i JOIN hits')},
decided AS (SELECT document AS batch_id, position, quantity, product_name, own_id, own_stock, n_own, n_all,
  CASE WHEN regexp_matches(coalesce(CASE WHEN position % 41 <> 0 THEN product_code END, ''), 'x^') THEN '' WHEN lower(regexp_replace(nullif({sql_trim('CASE WHEN position % 41 <> 0 THEN product_code END')}, ''), '\\s+', ' ', 'g')) = lower(regexp_replace({sql_trim('product_name')}, '\\s+', ' ', 'g')) THEN 'Ürün kodu, ürün adından kopyalanamaz'
    WHEN position % 97 = 0 THEN 'matches have changed' WHEN n_own = 1 THEN NULL WHEN n_all = 0 THEN NULL WHEN position % 3 = 0 AND n_own > 0 THEN 'source has the product already' WHEN position % 3 = 0 THEN NULL ELSE 'match is open' END AS error
  FROM state WHERE quantity >= 1 AND NOT review_required AND NOT source_identity_review_required),
batches AS (SELECT batch_id, count(*) FILTER (WHERE error IS NOT NULL) AS errors, arg_min(error, position) FILTER (WHERE error IS NOT NULL) AS reason, count(*) FILTER (WHERE error IS NULL AND n_own <> 1) AS created, count(*) FILTER (WHERE error IS NULL AND n_own = 1) AS updated FROM decided GROUP BY batch_id)"""


def confirmed(v):
    d = I.decide(to_confirm(v), v("products"), "Belediye").withColumn("source", F.lit("Belediye"))
    return I.confirm_import(d, v("products"))


@query("confirm_import", f"{CONFIRM} SELECT d.batch_id, d.own_id AS id, min(d.own_stock) AS stock, CAST(min(d.own_stock) + sum(d.quantity) AS BIGINT) AS new_stock FROM decided d JOIN batches b ON b.batch_id = d.batch_id WHERE b.errors = 0 AND d.n_own = 1 GROUP BY d.batch_id, d.own_id")
def confirm_import(v):
    return confirmed(v)["stocks"]


@query("confirm_import_history", f"{CONFIRM} SELECT d.batch_id, d.position, 'PDF_YUKLEME' AS islem_tipi, d.quantity AS miktar, 'Toplu İçe Aktarım - Miktar: ' || CAST(d.quantity AS VARCHAR) AS aciklama, CASE WHEN d.n_own = 1 THEN d.own_id END AS product_id FROM decided d JOIN batches b ON b.batch_id = d.batch_id WHERE b.errors = 0")
def confirm_import_history(v):
    return confirmed(v)["history"].drop("urun_adi")


@query("import_apply_counts", f"{CONFIRM} SELECT batch_id, errors = 0 AS accepted, reason, CASE WHEN errors = 0 THEN created ELSE 0 END AS created, CASE WHEN errors = 0 THEN updated ELSE 0 END AS updated, CASE WHEN errors = 0 THEN created + updated ELSE 0 END AS total FROM batches")
def import_apply_counts(v):
    return confirmed(v)["batches"].select("batch_id", "accepted", "reason", "created", "updated", "total")


@query("confirmed_row_errors", f"SELECT position, CASE WHEN e.errors <> '' THEN e.errors WHEN position % 53 = 0 THEN 'quantity was changed' WHEN e.review_required THEN 'name is to be reviewed' END AS error FROM ({ERRORS}) e")
def confirmed_row_errors(v):
    r = rows(v).withColumns({"canonical_name": S.canonical_name(F.col("product_name")), "match_review_required": F.lit(False), "is_valid": F.lit(True)})
    return K.confirmed_row_errors(r).select("position", "error")


# ---- reconciliation of extracted rows ----

EXTRACT = "SELECT document AS chunk_id, position, CASE WHEN position % 4 = 0 THEN NULL WHEN position % 9 = 0 THEN 'xlsx:none:row:1' ELSE concat('xlsx:', document, ':row:', CAST(row_number AS STRING)) END AS source_record_id, CASE WHEN position % 8 = 0 THEN upper(product_name) ELSE product_name END AS product_name, quantity FROM {import_rows} WHERE position % 6 <> 5"
SOURCES = "SELECT document AS chunk_id, position, concat('xlsx:', document, ':row:', CAST(row_number AS STRING)) AS source_identity, product_name, quantity FROM {import_rows}"


def _sql(v, text):
    r = v("import_rows")
    return r.sparkSession.sql(text.replace("{import_rows}", "{r}"), r=r)


ASSIGNED = f"""WITH s AS ({SOURCES}), e AS ({EXTRACT}),
refs AS (SELECT chunk_id, source_identity, count(*) AS n FROM s GROUP BY ALL),
named AS (SELECT chunk_id, {sql_alignment('product_name')} AS k, quantity, count(*) AS n, min(source_identity) AS one FROM s WHERE {sql_alignment('product_name')} IS NOT NULL AND quantity IS NOT NULL GROUP BY ALL),
assigned AS (SELECT e.chunk_id, e.position, CASE WHEN e.source_record_id IS NOT NULL THEN CASE WHEN refs.n = 1 THEN e.source_record_id END ELSE CASE WHEN named.n = 1 THEN named.one END END AS source_identity
  FROM e LEFT JOIN refs ON refs.chunk_id = e.chunk_id AND refs.source_identity = e.source_record_id LEFT JOIN named ON named.chunk_id = e.chunk_id AND named.k = {sql_alignment('e.product_name')} AND named.quantity = e.quantity)"""


@query("assign_source_identity", f"{ASSIGNED} SELECT chunk_id, position, source_identity, source_identity IS NULL AS identity_review FROM assigned")
def assign_source_identity(v):
    return R.assign_source_identity(_sql(v, EXTRACT), _sql(v, SOURCES)).select("chunk_id", "position", "source_identity", "identity_review")


@query("reconcile_source_rows", f"""{ASSIGNED},
good AS (SELECT chunk_id FROM s GROUP BY chunk_id HAVING bool_and(nullif({sql_trim('product_name')}, '') IS NOT NULL AND coalesce(quantity >= 1, false))),
found AS (SELECT chunk_id, source_identity, count(*) AS n FROM assigned WHERE source_identity IS NOT NULL GROUP BY ALL)
SELECT s.chunk_id, s.position, s.source_identity, s.quantity, f.n IS NULL AS recovered, greatest(coalesce(f.n, 1) - 1, 0) AS duplicates
FROM s JOIN good g ON g.chunk_id = s.chunk_id LEFT JOIN found f ON f.chunk_id = s.chunk_id AND f.source_identity = s.source_identity WHERE f.n IS NOT NULL OR length(s.chunk_id) % 2 = 0""")
def reconcile_source_rows(v):
    r = stage(v("import_rows").select("document", "position", "row_number", "product_name", "quantity"), "imports")
    sources, extract = (_sql(lambda _: r, text) for text in (SOURCES, EXTRACT))
    e = R.assign_source_identity(extract.select("chunk_id", "position", "source_record_id", "product_name", "quantity"), sources).withColumn("product_code", F.lit(None).cast("string")).withColumn("price", F.lit(None).cast("decimal(38,18)"))
    absent = sources.select("chunk_id").distinct().withColumn("code_absent", F.length("chunk_id") % 2 == 0)
    return R.reconcile_source_rows(sources, e, absent).select("chunk_id", "position", "source_identity", "quantity", "recovered", "duplicates")


CHUNKS = "SELECT document AS chunk_id, CASE WHEN length(document) % 2 = 0 THEN 'XLSX' ELSE 'PDF' END AS source_type, CAST(count(*) AS INT) AS expected, max(position) % 3 <> 0 AS trusted, CASE WHEN max(position) % 2 = 0 THEN 'RELIABLE' ELSE 'APPROXIMATE' END AS confidence FROM {import_rows} GROUP BY document"
GOT = "SELECT document AS chunk_id, source_identity, CASE WHEN quantity IS NULL THEN 'eksik' END AS error_message FROM {import_rows} WHERE position % 3 <> 1"


@query("chunk_completeness", f"""WITH c AS ({CHUNKS}), e AS ({GOT}),
n AS (SELECT chunk_id, count(*) AS rows, count(DISTINCT source_identity) AS ids, bool_or(error_message IS NOT NULL) AS hard FROM e GROUP BY chunk_id),
j AS (SELECT c.*, coalesce(n.rows, 0) AS rows, coalesce(n.hard, false) AS hard, CASE WHEN source_type = 'XLSX' AND trusted THEN coalesce(n.ids, 0) ELSE coalesce(n.rows, 0) END AS extracted FROM c LEFT JOIN n ON n.chunk_id = c.chunk_id)
SELECT chunk_id, extracted, (source_type = 'PDF' OR expected >= 5) AND (extracted = 0 OR 2 * extracted < expected) AS severe,
  (source_type = 'XLSX' AND expected >= 5 AND extracted < expected) OR (source_type = 'PDF' AND (rows <> expected OR (confidence = 'RELIABLE' AND hard))) AS gap, CAST(abs(expected - extracted) AS BIGINT) AS distance FROM j""")
def chunk_completeness(v):
    return R.chunk_completeness(_sql(v, CHUNKS), _sql(v, GOT))


PAGE_CHUNKS = "SELECT document AS chunk_id, 'PDF' AS source_type, 0 AS expected, CAST(count(*) FILTER (WHERE position % 4 = 0) AS INT) AS rows, CAST(count(*) * 400 AS INT) AS chars, CAST(count(*) * 3 AS INT) AS lines, CAST(count(*) * 2 AS INT) AS markers FROM {import_rows} GROUP BY document"


@query("low_yield_pages", f"SELECT chunk_id FROM ({PAGE_CHUNKS}) c WHERE (rows = 0 AND chars >= 1000 AND lines >= 8) OR (markers >= 8 AND rows * 2 < markers)")
def low_yield_pages(v):
    return R.low_yield_pages(_sql(v, PAGE_CHUNKS)).select("chunk_id")


@query("extraction_stats", "SELECT document, 'EK-1' AS place, 1 AS chunks, count(*) AS source_rows, count(*) AS candidates, count(*) AS extracted, count(*) FILTER (WHERE coalesce(quantity > 0, false) AND NOT review_required) AS valid, count(*) FILTER (WHERE review_required) AS review, count(*) FILTER (WHERE NOT coalesce(quantity > 0, false) AND NOT review_required) AS invalid FROM {import_rows} GROUP BY document")
def extraction_stats(v):
    r = v("import_rows")
    chunks = r.groupBy(F.col("document").alias("chunk_id")).agg(F.count("*").alias("source_rows"), F.count("*").alias("expected")).withColumn("document", F.col("chunk_id")).withColumn("place", F.lit("EK-1"))
    return R.extraction_stats(chunks, r.select(F.col("document").alias("chunk_id"), (F.coalesce(F.col("quantity") > 0, F.lit(False)) & ~F.col("review_required")).alias("is_valid"), "review_required"))


@query("global_row_numbers", "SELECT position, row_number() OVER (PARTITION BY user_no ORDER BY document, position) AS row_number FROM (SELECT position, document, position % 10 AS user_no FROM {import_rows}) t")
def global_row_numbers(v):
    r = v("import_rows").select("position", (F.col("position") % 10).alias("document"), F.col("document").alias("chunk_index"))
    return R.global_row_numbers(r, r.select("document", "chunk_index").distinct()).select("position", "row_number")


@query("split_failed_chunks", "SELECT position, n, CASE WHEN n = 1 THEN 0 WHEN nth < n // 2 THEN 1 ELSE 2 END AS half FROM (SELECT position, count(*) OVER (PARTITION BY document) AS n, row_number() OVER (PARTITION BY document ORDER BY position) - 1 AS nth FROM {import_rows} WHERE length(document) % 2 = 0) t")
def split_failed_chunks(v):
    r = v("import_rows").select(F.col("document").alias("chunk_id"), "position", F.col("row_number").alias("record_id"))
    halves, lone = R.split_failed_chunks(r, r.where(F.length("chunk_id") % 2 == 0).select("chunk_id").distinct())
    n = r.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return halves.unionByName(lone.withColumn("half", F.lit(0))).join(n, "chunk_id").select("position", "n", "half")
