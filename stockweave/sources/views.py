"""Inventory views over the given tables, as SQL that Spark and DuckDB both run.

Every view names the tables and views that it reads in braces. `frame` builds one as a DataFrame, `duckdb_sql`
puts the views that a query reads in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "categories": """
SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS id, p_type AS name,
  CASE WHEN length(p_type) % 2 = 0 THEN concat('Sınıf ', lower(p_type)) END AS description
FROM (SELECT DISTINCT p_type FROM {part}) t""",
    "products": """
SELECT CAST(p_partkey AS BIGINT) AS id,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('P-', CAST(p_partkey AS STRING)) END AS code,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', CAST(p_size AS STRING))
    WHEN 1 THEN replace(concat(p_name, ' ', CAST(p_size AS STRING)), ' ', '_')
    WHEN 2 THEN upper(concat(p_name, ' ', CAST(p_size AS STRING)))
    ELSE concat('  ', replace(p_name, ' ', ' - '), '  ', CAST(p_size AS STRING), ' ') END AS name,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE c.id END AS category_id,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS category,
  CAST(p_size AS INT) AS quantity,
  CASE WHEN p_size % 11 = 0 THEN 'Paket' ELSE 'Adet' END AS unit,
  CAST(p_size % 20 AS INT) AS min_stock_level,
  CASE WHEN p_size % 13 = 0 THEN NULL ELSE concat('R-', CAST(p_size % 9 AS STRING)) END AS shelf_location,
  CASE p_partkey % 5 WHEN 0 THEN 'Belediye' WHEN 1 THEN 'Tubitak' WHEN 2 THEN 'T3' WHEN 3 THEN 'TÜBİTAK' ELSE NULL END AS source,
  CAST('2024-01-01 08:30:00' AS TIMESTAMP) + INTERVAL '1' HOUR * (p_partkey % 500) AS created_at,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST('2024-03-01 09:05:00' AS TIMESTAMP) + INTERVAL '1' HOUR * (p_partkey % 900) END AS updated_at
FROM {part} LEFT JOIN {categories} c ON c.name = p_type""",
    "users": """
SELECT CAST(s_suppkey AS BIGINT) AS id, lower(replace(s_name, '#', '')) AS username, md5(s_name) AS password, s_name AS full_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'USER' ELSE 'STAFF' END AS role
FROM {supplier}""",
    # ids are unique as no order has a thousand lines
    "history": """
SELECT l.id, l.batch_id, l.product_id, l.user_id, l.islem_tipi, p.name AS urun_adi, l.miktar, l.aciklama, l.recipient_name, l.is_cancelled, l.tarih_saat
FROM (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
    CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE concat('B-', CAST(l_orderkey AS STRING)) END AS batch_id,
    l_partkey AS product_id,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_orderkey % 10 AS BIGINT) END AS user_id,
    CASE l_returnflag WHEN 'N' THEN 'STOK_GIRIS' WHEN 'A' THEN 'STOK_CIKIS' ELSE 'PDF_YUKLEME' END AS islem_tipi,
    CAST(l_quantity AS INT) AS miktar,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('Satır ', CAST(l_linenumber AS STRING)) END AS aciklama,
    CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('Alıcı ', CAST(l_suppkey % 50 AS STRING)) END AS recipient_name,
    l_linestatus = 'F' AS is_cancelled, l_shipdate AS tarih_saat
  FROM {lineitem}) l LEFT JOIN {products} p ON p.id = l.product_id""",
    "movements": """
SELECT id, coalesce(batch_id, concat('S-', CAST(id AS STRING))) AS batch_id, product_id,
  CASE WHEN islem_tipi = 'STOK_CIKIS' THEN 'OUT' ELSE 'IN' END AS movement_type,
  miktar AS quantity, recipient_name, aciklama AS description, user_id AS created_by, is_cancelled, tarih_saat AS created_at
FROM {history}""",
    "stream_events": """
SELECT event_id, ts, user_id AS product_id, CASE event_type WHEN 'purchase' THEN 'OUT' ELSE 'IN' END AS movement_type, CAST(floor(value) AS INT) + 1 AS quantity
FROM {events} WHERE event_type IN ('purchase', 'signup')""",
    "import_rows": """
SELECT id AS position, batch_id AS document, CAST(id % 1000 + 1 AS INT) AS row_number, urun_adi AS product_name,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 41 = 0 THEN urun_adi ELSE concat('P-', CAST(product_id AS STRING)) END AS product_code,
  CASE WHEN id % 29 = 0 THEN NULL WHEN id % 31 = 0 THEN 0 ELSE miktar END AS quantity,
  CASE WHEN id % 7 = 0 THEN NULL WHEN id % 37 = 0 THEN CAST(-1.5 AS DECIMAL(12, 2)) ELSE CAST(12.25 AS DECIMAL(12, 2)) END AS price,
  concat('xlsx:', batch_id, ':row:', CAST(CASE WHEN id % 11 = 0 THEN id % 1000 ELSE id % 1000 + 1 END AS STRING)) AS source_identity,
  id % 43 = 0 AS source_identity_review_required, id % 19 = 0 AS review_required
FROM {history} WHERE batch_id IS NOT NULL""",
    "sheet_cells": """
SELECT batch_id AS document, 'EK-1' AS sheet, CAST(1 AS INT) AS row, col, value
FROM (SELECT DISTINCT batch_id FROM {history} WHERE batch_id IS NOT NULL) b
CROSS JOIN (SELECT 1 AS col, 'Sıra No' AS value UNION ALL SELECT 2, 'Malzeme Adı' UNION ALL SELECT 3, 'Teknik Özellikler' UNION ALL SELECT 4, 'Toplam Adet') h
UNION ALL
SELECT batch_id, 'EK-1', CAST(id % 1000 + 1 AS INT), col,
  CASE col WHEN 1 THEN CAST(id % 1000 AS STRING) WHEN 2 THEN CASE WHEN id % 13 = 0 THEN '  ' ELSE urun_adi END WHEN 3 THEN 'Teknik 12V 5mm' ELSE CASE WHEN id % 17 = 0 THEN 'yok' ELSE CAST(miktar AS STRING) END END
FROM {history} CROSS JOIN (SELECT 1 AS col UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c
WHERE batch_id IS NOT NULL""",
    # sheets with titles above the header, without a header, and with a header of two rows
    "varied_sheets": """
SELECT document, sheet, row, col, value FROM {sheet_cells} WHERE CAST(substring(document, 3) AS INT) % 4 = 0 AND (row > 1 OR value IN ('Sıra No', 'Malzeme Adı', 'Teknik Özellikler', 'Toplam Adet'))
UNION ALL
SELECT document, sheet, CAST(row + 3 AS INT), col, value FROM {sheet_cells} WHERE CAST(substring(document, 3) AS INT) % 4 = 1 AND (row > 1 OR value IN ('Sıra No', 'Malzeme Adı', 'Teknik Özellikler', 'Toplam Adet'))
UNION ALL
SELECT document, sheet, t.place, CAST(1 AS INT), t.title FROM (SELECT DISTINCT document, sheet FROM {sheet_cells} WHERE CAST(substring(document, 3) AS INT) % 4 = 1) d CROSS JOIN (SELECT CAST(1 AS INT) AS place, 'Depo Listesi' AS title UNION ALL SELECT CAST(2 AS INT), 'Stok Kodu: D-1' UNION ALL SELECT CAST(3 AS INT), 'Tarih 2024') t
UNION ALL
SELECT document, sheet, row, col, value FROM {sheet_cells} WHERE CAST(substring(document, 3) AS INT) % 4 = 2 AND row > 1
UNION ALL
SELECT document, sheet, CAST(CASE WHEN row = 1 AND col < 3 THEN 1 ELSE row + 1 END AS INT), col, value FROM {sheet_cells} WHERE CAST(substring(document, 3) AS INT) % 4 = 3 AND (row > 1 OR value IN ('Sıra No', 'Malzeme Adı', 'Teknik Özellikler', 'Toplam Adet'))""",
    "page_lines": """
SELECT batch_id AS document, CAST(1 AS INT) AS page, CAST(0 AS INT) AS line_no, 'Sıra No | Malzeme Adı | Teknik Özellik | Toplam Adet' AS text
FROM (SELECT DISTINCT batch_id FROM {history} WHERE batch_id IS NOT NULL) b
UNION ALL
SELECT batch_id, CAST(1 AS INT), CAST(2 * (id % 1000) AS INT),
  CASE WHEN product_id % 19 = 0 THEN concat('Ürün Adı: ', urun_adi, ' | Miktar: ', CAST(miktar AS STRING))
    WHEN product_id % 7 = 0 THEN concat(CAST(id % 1000 AS STRING), ') ', urun_adi, ' | Teknik 12V | Miktar: ', CAST(miktar AS STRING))
    WHEN product_id % 5 = 0 THEN concat(CAST(id % 1000 AS STRING), '. ', urun_adi, ' - aciklama metni ', CAST(miktar AS STRING))
    ELSE concat(CAST(id % 1000 AS STRING), ' | ', urun_adi, ' | Teknik 12V 5mm | ', CAST(miktar AS STRING)) END
FROM {history} WHERE batch_id IS NOT NULL
UNION ALL
SELECT batch_id, CAST(1 AS INT), CAST(2 * (id % 1000) + 1 AS INT),
  CASE WHEN product_id % 3 = 0 THEN concat('Ürün Kodu: P-', CAST(product_id AS STRING)) WHEN product_id % 3 = 1 THEN 'Ürün Kodu: Belirtilmemiş' ELSE '12 V adaptör' END
FROM {history} WHERE batch_id IS NOT NULL AND product_id % 2 = 0""",
}


def _reads(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: frame(spark, sf_dir, n) for n in _reads(VIEWS[name])})


def duckdb_sql(sql: str) -> str:
    """sql with every {view} that it reads, directly or not, as a common table expression of its own."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _reads(text):
            if n not in BASE and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).strip()
    body = plain(sql)
    views = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    if not views:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE):
        return f"WITH {m[1] or ''}{views},\n{body[m.end():]}"
    return f"WITH {views}\n{body}"
