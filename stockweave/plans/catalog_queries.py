"""Queries of the catalogue: scans, lookups, filters, checks, changes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import scalars as S
from stockweave.operators import catalog as C
from stockweave.operators import history as H

from .registry import query, sql_canonical, sql_dash, sql_semantic, sql_time

PRODUCT = "id, code, name, category_id, category, quantity, unit, min_stock_level, shelf_location, source"
COLS = [c.strip() for c in PRODUCT.split(",")]


@query("scan_products", "SELECT id, code, name, category_id, CASE WHEN category_id IS NOT NULL THEN category END AS category_name, quantity, unit, min_stock_level, shelf_location, source FROM {products}")
def scan_products(v):
    p = C.scan_products(v("products"))
    return p.select("id", "code", "name", F.col("category.id").alias("category_id"), F.col("category.name").alias("category_name"), "quantity", "unit", "min_stock_level", "shelf_location", "source")


@query("scan_categories", "SELECT id, name, description FROM {categories}")
def scan_categories(v):
    return v("categories").select("id", "name", "description")


@query("scan_users", "SELECT id, username, full_name, role FROM {users}")
def scan_users(v):
    return C.scan_users(v("users"))


@query("get_by_id", f"SELECT {PRODUCT} FROM {{products}} WHERE id = 42")
def get_by_id(v):
    return C.get_by_id(v("products"), 42, "product").select(*COLS)


@query("search_products", f"SELECT {PRODUCT} FROM {{products}} WHERE lower(name) LIKE '%ring_1%' OR lower(code) LIKE '%ring_1%' OR lower(shelf_location) LIKE '%ring_1%'")
def search_products(v):
    return C.search_products(v("products"), "ring_1").select(*COLS)


@query("search_products_literal", f"SELECT {PRODUCT} FROM {{products}} WHERE contains(lower(name), 'ring_1') OR contains(lower(code), 'ring_1') OR contains(lower(shelf_location), 'ring_1')")
def search_products_literal(v):
    return C.search_products(v("products"), "ring_1", literal=True).select(*COLS)


@query("critical_stock", f"SELECT {PRODUCT} FROM {{products}} WHERE quantity <= min_stock_level")
def critical_stock(v):
    return C.critical_stock(v("products")).select(*COLS)


@query("stock_status", "SELECT id, CASE WHEN quantity <= min_stock_level THEN 'Kritik' WHEN quantity <= 2 * min_stock_level THEN 'Az' ELSE 'İyi' END AS status FROM {products}")
def stock_status(v):
    return C.with_stock_status(v("products")).select("id", "status")


@query("filter_products", f"SELECT {PRODUCT} FROM {{products}} WHERE (contains(lower(name), 'ring') OR contains(lower(coalesce(code, '')), 'ring')) AND CASE WHEN source = 'TÜBİTAK' THEN 'Tubitak' ELSE source END = 'Tubitak' AND quantity > 2 * min_stock_level")
def filter_products(v):
    return C.filter_products(v("products"), search="RING", source="Tubitak", stock="İyi").select(*COLS)


@query("search_categories", "SELECT id, name, description FROM {categories} WHERE contains(lower(name), 'econ') OR contains(lower(coalesce(description, '')), 'econ')")
def search_categories(v):
    return C.search_categories(v("categories"), "Econ")


@query("search_users", "SELECT id, username, full_name FROM {users} WHERE contains(lower(username), '00001') OR contains(lower(full_name), '00001')")
def search_users(v):
    return C.search_users(v("users"), "00001").select("id", "username", "full_name")


@query("product_with_category", "SELECT p.id, p.name, p.category_id, c.name AS category_name, c.description AS category_description FROM {products} p LEFT JOIN {categories} c ON c.id = p.category_id")
def product_with_category(v):
    return C.product_with_category(v("products"), v("categories")).select("id", "name", "category_id", "category_name", "category_description")


@query("category_product_counts", "SELECT c.id, c.name, count(p.id) AS product_count FROM {categories} c LEFT JOIN {products} p ON p.category_id = c.id GROUP BY c.id, c.name")
def category_product_counts(v):
    return C.category_product_counts(v("products"), v("categories"))


@query("validate_import_source", "SELECT id, source, coalesce(source IN ('Belediye', 'Tubitak', 'T3'), false) AS accepted, CASE WHEN NOT coalesce(source IN ('Belediye', 'Tubitak', 'T3'), false) THEN 'Geçersiz ürün kaynağı: ' || coalesce(source, 'null') END AS reason FROM {products}")
def validate_import_source(v):
    return C.validate_import_source(v("products").select("id", "source"))


# requests made of the catalogue itself, with some fields broken
REQUESTS = """
requests AS (
  SELECT id AS request_id, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 9 = 0 THEN concat('P-', CAST(id + 1 AS STRING)) ELSE concat('N-', CAST(id AS STRING)) END AS code,
    CASE WHEN id % 6 = 0 THEN '  ' WHEN id % 10 = 1 THEN name ELSE concat('Yeni ', CAST(id % 700 AS STRING)) END AS name, CASE WHEN id % 12 = 5 THEN 9999 ELSE category_id END AS category_id,
    CASE WHEN id % 8 = 0 THEN NULL WHEN id % 14 = 0 THEN -1 ELSE quantity END AS quantity, CASE WHEN id % 2 = 0 THEN NULL ELSE 'Kutu' END AS unit,
    CASE WHEN id % 15 = 0 THEN -2 WHEN id % 2 = 1 THEN NULL ELSE 7 END AS min_stock_level, shelf_location, source
  FROM {products})"""


def requests(v):
    body = REQUESTS.strip().removeprefix("requests AS (").rsplit(")", 1)[0]
    p = v("products")
    return p.sparkSession.sql(body.replace("{products}", "{p}"), p=p)


REASON = "CASE WHEN name IS NULL OR trim(name) = '' THEN 'name is blank' WHEN quantity IS NULL THEN 'quantity is missing' WHEN quantity < 0 THEN 'quantity is negative' WHEN min_stock_level < 0 THEN 'minimum level is negative' END"


@query("validate_product_requests", f"WITH {REQUESTS} SELECT request_id, {REASON} AS reason, {REASON} IS NULL AS accepted FROM requests")
def validate_product_requests(v):
    return C.validate_product_requests(requests(v)).select("request_id", "reason", "accepted")


@query("duplicate_code_check", f"WITH {REQUESTS} SELECT request_id, id, code FROM requests r WHERE EXISTS (SELECT 1 FROM {{products}} p WHERE p.code = r.code AND p.id IS DISTINCT FROM r.id)")
def duplicate_code_check(v):
    return C.taken_by_other(requests(v), v("products"), "code").select("request_id", "id", "code")


@query("duplicate_canonical_name_check", f"WITH {REQUESTS} SELECT request_id, name FROM requests r WHERE r.id IS NULL AND EXISTS (SELECT 1 FROM {{products}} p WHERE {sql_canonical('p.name')} = {sql_canonical('r.name')})")
def duplicate_canonical_name_check(v):
    return C.duplicate_canonical_names(requests(v), v("products")).select("request_id", "name")


@query("duplicate_category_check", "SELECT r.id, r.name FROM (SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE lead(name) OVER (ORDER BY id) END AS name FROM {categories}) r WHERE EXISTS (SELECT 1 FROM {categories} c WHERE c.name = r.name AND c.id <> r.id)")
def duplicate_category_check(v):
    c = v("categories")
    r = c.sparkSession.sql("SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE lead(name) OVER (ORDER BY id) END AS name FROM {c}", c=c)
    return C.taken_by_other(r, c, "name")


@query("duplicate_username_check", "SELECT r.id, r.username FROM (SELECT id, CASE WHEN id % 5 = 0 THEN concat('supplier', lpad(CAST(id + 1 AS STRING), 9, '0')) ELSE username END AS username FROM {users}) r WHERE EXISTS (SELECT 1 FROM {users} u WHERE u.username = r.username AND u.id <> r.id)")
def duplicate_username_check(v):
    u = v("users")
    r = u.withColumn("username", F.when(F.col("id") % 5 == 0, F.concat(F.lit("supplier"), F.lpad((F.col("id") + 1).cast("string"), 9, "0"))).otherwise(F.col("username"))).select("id", "username")
    return C.taken_by_other(r, u, "username")


CREATED = f"""
WITH {REQUESTS},
coded AS (SELECT *, coalesce(nullif(trim(code), ''), 'PRD-' || upper(substr(sha256(CAST(request_id AS STRING)), 1, 8))) AS new_code, {sql_canonical('name')} AS key, {REASON} AS reason0 FROM requests WHERE id IS NULL),
checked AS (
  SELECT *, coalesce(reason0, CASE WHEN new_code IN (SELECT code FROM {{products}} WHERE code IS NOT NULL) THEN 'code exists'
    WHEN key IN (SELECT {sql_canonical('name')} FROM {{products}} WHERE {sql_canonical('name')} IS NOT NULL) THEN 'name exists'
    WHEN category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM {{categories}}) THEN 'category missing' END) AS reason1 FROM coded),
firsts AS (SELECT *, min(CASE WHEN reason1 IS NULL THEN request_id END) OVER (PARTITION BY new_code) AS fc, min(CASE WHEN reason1 IS NULL THEN request_id END) OVER (PARTITION BY key) AS fk FROM checked),
decided AS (SELECT *, coalesce(reason1, CASE WHEN fc < request_id OR fk < request_id THEN 'repeated request' END) AS reason FROM firsts)"""


@query("create_products", f"{CREATED} SELECT request_id, new_code AS code, trim(name) AS name, category_id, quantity, coalesce(unit, 'Adet') AS unit, coalesce(min_stock_level, 5) AS min_stock_level, shelf_location, source FROM decided WHERE reason IS NULL")
def create_products(v):
    return C.create_products(requests(v).where("id IS NULL"), v("products"), v("categories"))[0]


@query("create_products_rejected", f"{CREATED} SELECT request_id, reason FROM decided WHERE reason IS NOT NULL")
def create_products_rejected(v):
    return C.create_products(requests(v).where("id IS NULL"), v("products"), v("categories"))[1]


@query("update_products", f"""WITH {REQUESTS}
SELECT p.id, CASE WHEN r.id IS NULL THEN p.code ELSE r.code END AS code, CASE WHEN r.id IS NULL THEN p.name ELSE r.name END AS name, CASE WHEN r.id IS NULL THEN p.category_id ELSE r.category_id END AS category_id,
  CASE WHEN r.id IS NULL THEN p.quantity ELSE r.quantity END AS quantity, coalesce(r.unit, p.unit) AS unit, coalesce(r.min_stock_level, p.min_stock_level) AS min_stock_level,
  CASE WHEN r.id IS NULL THEN p.shelf_location ELSE r.shelf_location END AS shelf_location, CASE WHEN r.id IS NULL THEN p.source ELSE r.source END AS source
FROM {{products}} p LEFT JOIN requests r ON r.id = p.id""")
def update_products(v):
    return C.update_products(requests(v).where("id IS NOT NULL"), v("products"))


@query("upsert_categories", """
WITH r AS (SELECT id, concat(name, ' *') AS name, description FROM {categories} WHERE id % 2 = 0 UNION ALL SELECT id + 100000, concat('Yeni ', name), NULL FROM {categories} WHERE id % 3 = 0)
SELECT coalesce(r.id, c.id) AS id, CASE WHEN r.id IS NOT NULL THEN r.name ELSE c.name END AS name, CASE WHEN r.id IS NOT NULL THEN r.description ELSE c.description END AS description
FROM {categories} c FULL JOIN r ON r.id = c.id""")
def upsert_categories(v):
    c = v("categories")
    r = c.sparkSession.sql("SELECT id, concat(name, ' *') AS name, description FROM {c} WHERE id % 2 = 0 UNION ALL SELECT id + 100000, concat('Yeni ', name), NULL FROM {c} WHERE id % 3 = 0", c=c)
    return C.upsert_categories(r, c)


@query("update_user_attributes", """
WITH r AS (SELECT id, concat(username, '_x') AS username, full_name, CASE WHEN id % 4 = 0 THEN NULL ELSE 'ADMIN' END AS role FROM {users} WHERE id % 2 = 0)
SELECT u.id, coalesce(r.username, u.username) AS username, coalesce(r.full_name, u.full_name) AS full_name, coalesce(r.role, u.role) AS role FROM {users} u LEFT JOIN r ON r.id = u.id
UNION ALL SELECT NULL, trim(concat(' n', username, ' ')), full_name, CASE WHEN id % 3 = 0 THEN 'STAFF' ELSE 'USER' END FROM {users} WHERE id % 7 = 0""")
def update_user_attributes(v):
    u = v("users")
    r = u.sparkSession.sql("SELECT id, concat(username, '_x') AS username, full_name, CASE WHEN id % 4 = 0 THEN NULL ELSE 'ADMIN' END AS role FROM {u} WHERE id % 2 = 0 UNION ALL SELECT NULL, concat(' n', username, ' '), full_name, CASE WHEN id % 3 = 0 THEN 'STAFF' END FROM {u} WHERE id % 7 = 0", u=u)
    return C.update_user_attributes(r, u)


@query("referential_delete", "SELECT id, CASE WHEN category_id % 3 = 0 THEN NULL ELSE category_id END AS category_id FROM {products}")
def referential_delete(v):
    return C.referential_delete_category(v("products"), v("categories").where("id % 3 = 0")).select("id", "category_id")


@query("referential_delete_product", "SELECT id, product_id, 'movement' AS kind FROM {movements} WHERE product_id % 3 <> 0 UNION ALL SELECT id, CASE WHEN product_id % 3 = 0 THEN NULL ELSE product_id END, 'history' FROM {history}")
def referential_delete_product(v):
    m, h = C.referential_delete_product(v("movements"), v("history"), v("products").where("id % 3 = 0"))
    return m.select("id", "product_id", F.lit("movement").alias("kind")).unionByName(h.select("id", "product_id", F.lit("history").alias("kind")))


@query("referential_delete_user", "SELECT id, CASE WHEN created_by % 2 = 0 THEN NULL ELSE created_by END AS created_by FROM {movements}")
def referential_delete_user(v):
    return C.referential_delete_user(v("movements"), "created_by", v("users").where("id % 2 = 0")).select("id", "created_by")


@query("stock_report", f"SELECT row_number() OVER (ORDER BY lower(name), id) AS row_no, {sql_dash('code')} AS code, name, CAST(quantity AS VARCHAR) AS quantity, {sql_dash('unit')} AS unit, {sql_dash('category')} AS category, {sql_time('coalesce(updated_at, created_at)')} AS changed FROM {{products}}")
def stock_report(v):
    return H.stock_report(v("products"))


@query("report_row_number", "SELECT id, row_number() OVER (ORDER BY lower(name), id) AS row_no FROM {products}")
def report_row_number(v):
    from stockweave.operators.ordering import numbered

    return numbered(v("products"), [F.lower("name"), F.col("id")]).select("id", "row_no")


@query("filtered_stock_list", f"SELECT row_number() OVER (ORDER BY id) AS row_no, trim(name) AS name, {sql_dash('category')} AS category, {sql_dash('source')} AS source, CAST(quantity AS VARCHAR) AS quantity, CAST(min_stock_level AS VARCHAR) AS min_stock_level, {sql_dash('unit')} AS unit, {sql_dash('shelf_location')} AS shelf_location, count(*) OVER () AS total FROM {{products}} WHERE quantity <= min_stock_level")
def filtered_stock_list(v):
    return H.filtered_stock_list(C.filter_products(v("products"), stock="Kritik"))


# ---- scalar functions over product names ----


@query("canonical_name", f"SELECT id, {sql_canonical('name')} AS key FROM {{products}}")
def canonical_name(v):
    return v("products").select("id", S.canonical_name(F.col("name")).alias("key"))


@query("trim_to_null", r"SELECT id, nullif(regexp_replace(CASE WHEN id % 5 = 0 THEN '  ' ELSE name END, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '') AS t FROM {products}")
def trim_to_null(v):
    return v("products").select("id", S.trim_to_null(F.when(F.col("id") % 5 == 0, "  ").otherwise(F.col("name"))).alias("t"))


@query("normalize_source", "SELECT id, CASE WHEN source = 'TÜBİTAK' THEN 'Tubitak' ELSE source END AS source FROM {products}")
def normalize_source(v):
    return v("products").select("id", S.normalize_source(F.col("source")).alias("source"))


@query("null_to_dash", f"SELECT id, {sql_dash('code')} AS code, {sql_dash('shelf_location')} AS shelf FROM {{products}}")
def null_to_dash(v):
    return v("products").select("id", S.null_to_dash(F.col("code")).alias("code"), S.null_to_dash(F.col("shelf_location")).alias("shelf"))


@query("format_ts", f"SELECT id, {sql_time('updated_at')} AS changed FROM {{products}}")
def format_ts(v):
    return v("products").select("id", S.format_ts(F.col("updated_at")).alias("changed"))


@query("truncate_cell", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS cell FROM documents")
def truncate_cell(v):
    return v("documents").select("doc_id", S.truncate_cell(F.col("text")).alias("cell"))


@query("clean_cell", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n\t]', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS cell FROM documents")
def clean_cell(v):
    return v("documents").select("doc_id", S.clean_cell(F.col("text")).alias("cell"))


@query("review_message_160", r"SELECT doc_id, CASE WHEN m IS NULL THEN 'yok' WHEN length(m) <= 160 THEN m ELSE substr(m, 1, 157) || '...' END AS message FROM (SELECT doc_id, regexp_replace(nullif(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), ''), '\s+', ' ', 'g') AS m FROM documents) t")
def review_message_160(v):
    return v("documents").select("doc_id", S.review_message_160(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text")), F.lit("yok")).alias("message"))


@query("historical_summary", "SELECT id, name || ' — ' || coalesce(source, 'Kaynak belirtilmemiş') || ' — ' || coalesce(unit, 'Birim belirtilmemiş') || ' — stok ' || CAST(quantity AS VARCHAR) AS summary FROM {products}")
def historical_summary(v):
    return v("products").select("id", S.historical_summary(F.col("name"), F.col("source"), F.col("unit"), F.col("quantity")).alias("summary"))


@query("semantic_key", f"SELECT id, {sql_semantic('name')} AS key FROM {{products}}")
def semantic_key(v):
    """Names of the catalogue are without Unicode compatibility forms; those are tested against unicodedata."""
    return v("products").select("id", S.semantic_key(F.col("name")).alias("key"))
