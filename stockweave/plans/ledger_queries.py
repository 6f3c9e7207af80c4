"""Queries of movements and the audit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import scalars as S
from stockweave.operators import history as H
from stockweave.operators import ledger as L

from .registry import query, sql_time

LABELS = {k: v for k, v in S.BATCH_LABELS.items()}


def sql_pick(column: str, k: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in LABELS.items()) + f" ELSE '{LABELS['PDF_YUKLEME'][k]}' END"


ENRICHED = "SELECT m.id, m.product_id, m.movement_type, m.quantity, m.created_at, p.name AS product_name, p.code AS product_code, u.full_name AS created_by_name FROM {movements} m JOIN {products} p ON p.id = m.product_id LEFT JOIN {users} u ON u.id = m.created_by"


def enriched(v):
    m = L.movement_enriched(v("movements"), v("products"), v("users"))
    return m.select("id", "product_id", "movement_type", "quantity", "created_at", "product_name", "product_code", "created_by_name")


@query("movement_enriched", ENRICHED)
def movement_enriched(v):
    return enriched(v)


@query("list_movements", ENRICHED)
def list_movements(v):
    return enriched(v).orderBy(F.desc("created_at"), F.desc("id"))


@query("movements_by_product", "SELECT id, product_id, movement_type, quantity FROM {movements} WHERE product_id = 42")
def movements_by_product(v):
    return L.movements_by_product(v("movements"), v("products"), 42).select("id", "product_id", "movement_type", "quantity")


@query("validate_movement_requests", """
SELECT id, reason, reason IS NULL AS accepted FROM (SELECT id, CASE WHEN p IS NULL THEN 'product is missing' WHEN t IS NULL THEN 'type is missing' WHEN q IS NULL THEN 'quantity is missing' WHEN q < 1 THEN 'quantity under 1' END AS reason
FROM (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE product_id END AS p, CASE WHEN id % 13 = 0 THEN NULL ELSE movement_type END AS t, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 0 ELSE quantity END AS q FROM {movements}) a) b""")
def validate_movement_requests(v):
    m = v("movements")
    r = m.select("id", F.when(F.col("id") % 11 != 0, F.col("product_id")).alias("product_id"), F.when(F.col("id") % 13 != 0, F.col("movement_type")).alias("movement_type"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, 0).otherwise(F.col("quantity")).alias("quantity"))
    return L.validate_movement_requests(r).select("id", "reason", "accepted")


BATCH = """
WITH lines AS (SELECT m.batch_id, m.id AS seq, m.product_id, m.quantity, p.quantity AS start_stock,
    p.quantity + sum(CASE WHEN m.movement_type = 'OUT' THEN -CAST(m.quantity AS BIGINT) ELSE m.quantity END) OVER (PARTITION BY m.batch_id, m.product_id ORDER BY m.id) AS running
  FROM {movements} m LEFT JOIN {products} p ON p.id = m.product_id),
judged AS (SELECT *, CASE WHEN start_stock IS NULL THEN 'unknown product' WHEN quantity IS NULL OR quantity < 1 THEN 'invalid quantity' WHEN running < 0 THEN 'insufficient stock' WHEN running > 2147483647 THEN 'stock beyond int' END AS problem FROM lines),
batches AS (SELECT batch_id, count(*) AS lines, arg_min(problem, seq) FILTER (WHERE problem IS NOT NULL) AS reason FROM judged GROUP BY batch_id)"""


def applied(v):
    return L.apply_movement_batch(v("movements").withColumn("seq", F.col("id")), v("products"))


@query("apply_movement_batch", f"{BATCH} SELECT j.batch_id, j.seq, j.product_id, CAST(j.running AS BIGINT) AS running FROM judged j JOIN batches b ON b.batch_id = j.batch_id WHERE b.reason IS NULL")
def apply_movement_batch(v):
    return applied(v)[0].select("batch_id", "seq", "product_id", "running")


@query("apply_movement_batch_status", f"{BATCH} SELECT batch_id, lines, reason, reason IS NULL AS accepted FROM batches")
def apply_movement_batch_status(v):
    return applied(v)[1].select("batch_id", "lines", "reason", "accepted")


# the fold over a product's movements as a recursive walk by place
REPLAY = """
WITH RECURSIVE ordered AS (SELECT m.product_id, m.id, row_number() OVER (PARTITION BY m.product_id ORDER BY m.created_at, m.id) AS n, CASE WHEN m.movement_type = 'OUT' THEN -CAST(m.quantity AS BIGINT) ELSE m.quantity END AS change, CAST(p.quantity AS BIGINT) AS start_stock
  FROM {movements} m JOIN {products} p ON p.id = m.product_id),
walk AS (
  SELECT product_id, n, id, start_stock + change >= 0 AS accepted, CASE WHEN start_stock + change >= 0 THEN start_stock + change ELSE start_stock END AS stock FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.product_id, o.n, o.id, w.stock + o.change >= 0, CASE WHEN w.stock + o.change >= 0 THEN w.stock + o.change ELSE w.stock END FROM walk w JOIN ordered o ON o.product_id = w.product_id AND o.n = w.n + 1)
SELECT product_id, id, accepted, CAST(stock AS BIGINT) AS stock_after FROM walk"""


@query("replay_movements_with_rejection", REPLAY)
def replay_movements_with_rejection(v):
    return L.replay_movements_with_rejection(v("movements"), v("products"))


@query("cancel_movement", """
SELECT id, product_id, CASE WHEN reason IS NULL THEN CAST(new AS BIGINT) END AS new_stock, reason IS NULL AS accepted, reason FROM (
  SELECT m.id, m.product_id, p.quantity - CASE WHEN m.movement_type = 'OUT' THEN -m.quantity ELSE m.quantity END AS new,
    CASE WHEN m.is_cancelled THEN 'already cancelled' WHEN p.id IS NULL THEN 'unknown product' WHEN p.quantity - CASE WHEN m.movement_type = 'OUT' THEN -m.quantity ELSE m.quantity END < 0 THEN 'insufficient stock' END AS reason
  FROM {movements} m LEFT JOIN {products} p ON p.id = m.product_id WHERE m.id % 2 = 0) t""")
def cancel_movement(v):
    m = v("movements")
    return L.cancel_movement(m.where("id % 2 = 0"), m, v("products"))


TARGET = """
WITH h AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE product_id END AS pid FROM {history}),
names AS (SELECT name, count(*) AS hits, min(id) AS named_id FROM {products} GROUP BY name),
j AS (SELECT h.*, p.id AS hit_id, n.hits, n.named_id FROM h LEFT JOIN {products} p ON p.id = h.pid LEFT JOIN names n ON n.name = h.urun_adi),
t AS (SELECT *, coalesce(hit_id, CASE WHEN pid IS NULL AND hits = 1 THEN named_id END) AS target_id,
  CASE WHEN coalesce(hit_id, CASE WHEN pid IS NULL AND hits = 1 THEN named_id END) IS NOT NULL THEN NULL WHEN pid IS NOT NULL THEN 'product missing' WHEN trim(coalesce(urun_adi, '')) = '' THEN 'name is blank' WHEN coalesce(hits, 0) = 0 THEN 'no product of this name' ELSE 'name is not unique' END AS target_problem FROM j)"""


def history_without_some_ids(v):
    return v("history").withColumn("product_id", F.when(F.col("id") % 4 != 0, F.col("product_id")))


@query("rollback_target", f"{TARGET} SELECT id, target_id, target_problem FROM t")
def rollback_target(v):
    return L.rollback_target(history_without_some_ids(v), v("products")).select("id", "target_id", "target_problem")


ROLLBACK = f"""{TARGET},
lines AS (SELECT t.*, p.quantity + sum(CASE WHEN islem_tipi = 'STOK_CIKIS' THEN miktar ELSE -miktar END) OVER (PARTITION BY batch_id, target_id ORDER BY tarih_saat DESC, t.id DESC) AS after FROM t LEFT JOIN {{products}} p ON p.id = t.target_id WHERE batch_id IS NOT NULL AND id_ok),
judged AS (SELECT *, CASE WHEN is_cancelled THEN 'already cancelled' WHEN miktar <= 0 THEN 'invalid quantity' WHEN target_problem IS NOT NULL THEN target_problem WHEN after < 0 THEN 'insufficient stock' END AS problem FROM lines),
batches AS (SELECT batch_id, count(*) AS lines, arg_max(problem, (tarih_saat, id)) FILTER (WHERE problem IS NOT NULL) AS reason FROM judged GROUP BY batch_id)""".replace(" AND id_ok", "")


def rolled_back(v):
    return L.rollback_batch(history_without_some_ids(v), v("products"))


@query("rollback_batch", f"{ROLLBACK} SELECT j.batch_id, j.target_id AS product_id, CAST(arg_min(j.after, (j.tarih_saat, j.id)) AS BIGINT) AS stock FROM judged j JOIN batches b ON b.batch_id = j.batch_id WHERE b.reason IS NULL GROUP BY j.batch_id, j.target_id")
def rollback_batch(v):
    return rolled_back(v)[0]


@query("rollback_batch_status", f"{ROLLBACK} SELECT batch_id, lines, reason, reason IS NULL AS accepted FROM batches")
def rollback_batch_status(v):
    return rolled_back(v)[1].select("batch_id", "lines", "reason", "accepted")


@query("net_cart_changes", """
SELECT n.product_id, net AS net_change, CASE WHEN net > 0 THEN 'IN' ELSE 'OUT' END AS movement_type, abs(net) AS quantity, p.quantity + net >= 0 AS accepted
FROM (SELECT product_id, CAST(sum(CASE WHEN movement_type = 'IN' THEN 1 ELSE -1 END) AS BIGINT) AS net FROM {movements} GROUP BY product_id) n JOIN {products} p ON p.id = n.product_id WHERE net <> 0""")
def net_cart_changes(v):
    return L.net_cart_changes(v("movements"), v("products"))


# ---- history ----

ROWS = "h.id, h.batch_id, h.user_id, h.islem_tipi, h.urun_adi, h.miktar, h.tarih_saat, u.username"


@query("history_enriched", f"SELECT {ROWS} FROM {{history}} h LEFT JOIN {{users}} u ON u.id = h.user_id")
def history_enriched(v):
    return H.history_enriched(v("history"), v("users")).select("id", "batch_id", "user_id", "islem_tipi", "urun_adi", "miktar", "tarih_saat", "username")


@query("list_history", f"SELECT {ROWS} FROM {{history}} h LEFT JOIN {{users}} u ON u.id = h.user_id WHERE h.user_id = 3")
def list_history(v):
    return H.list_history(v("history"), v("users"), viewer=3, is_admin=False).select("id", "batch_id", "user_id", "islem_tipi", "urun_adi", "miktar", "tarih_saat", "username")


@query("batch_detail", f"SELECT {ROWS} FROM {{history}} h LEFT JOIN {{users}} u ON u.id = h.user_id WHERE h.batch_id = 'B-101'")
def batch_detail(v):
    return H.batch_detail(v("history"), v("users"), "B-101").select("id", "batch_id", "user_id", "islem_tipi", "urun_adi", "miktar", "tarih_saat", "username")


SUMMARY = "SELECT batch_id, user_id, CASE WHEN min(islem_tipi) = max(islem_tipi) THEN max(islem_tipi) ELSE 'KARMA_ISLEM' END AS islem_tipi, min(tarih_saat) AS tarih_saat, count(*) AS toplam_urun, max(recipient_name) AS recipient_name, max(aciklama) AS aciklama, max(CAST(is_cancelled AS INT)) = 1 AS is_cancelled FROM {history} WHERE batch_id IS NOT NULL GROUP BY batch_id, user_id"


@query("batch_summary", SUMMARY)
def batch_summary(v):
    return H.batch_summary(v("history"))


@query("history_summary", f"""
SELECT id, CAST(NULL AS VARCHAR) AS batch_id, false AS is_batch, user_id, islem_tipi, urun_adi, miktar, aciklama, recipient_name, CAST(0 AS BIGINT) AS toplam_urun, is_cancelled, tarih_saat FROM {{history}} WHERE batch_id IS NULL
UNION ALL SELECT NULL, batch_id, true, user_id, islem_tipi, NULL, NULL, aciklama, recipient_name, toplam_urun, is_cancelled, tarih_saat FROM ({SUMMARY}) s""")
def history_summary(v):
    return H.history_summary(v("history"))


@query("history_batch_count", f"SELECT (SELECT count(*) FROM ({SUMMARY}) s) AS batches, (SELECT count(*) FROM ({SUMMARY}) s) + (SELECT count(*) FROM {{history}} WHERE batch_id IS NULL) AS rows")
def history_batch_count(v):
    return H.history_batch_count(H.history_summary(v("history"), ordered=False))


@query("batch_detail_report", f"""
SELECT batch_id, row_number() OVER o AS row_no, coalesce(urun_adi, '—') AS urun_adi, {sql_pick('islem_tipi', 2)} || CAST(miktar AS VARCHAR) AS miktar, coalesce(aciklama, '—') AS aciklama, {sql_time('tarih_saat')} AS tarih,
  first_value(recipient_name IGNORE NULLS) OVER w AS header_recipient, first_value(aciklama IGNORE NULLS) OVER w AS header_description
FROM {{history}} WHERE batch_id IS NOT NULL
WINDOW o AS (PARTITION BY batch_id ORDER BY tarih_saat, id), w AS (PARTITION BY batch_id ORDER BY tarih_saat, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def batch_detail_report(v):
    return H.batch_detail_report(v("history"))


@query("operation_label", f"SELECT id, {sql_pick('islem_tipi', 0)} AS text, {sql_pick('islem_tipi', 1)} AS description, {sql_pick('islem_tipi', 2)} AS sign FROM {{history}}")
def operation_label(v):
    return v("history").select("id", S.operation_label(F.col("islem_tipi")).alias("o")).select("id", "o.text", "o.description", "o.sign")


@query("history_type_label", "SELECT id, CASE islem_tipi WHEN 'STOK_GIRIS' THEN 'Stok Giriş' WHEN 'STOK_CIKIS' THEN 'Stok Çıkış' WHEN 'PDF_YUKLEME' THEN 'PDF Yükleme' ELSE islem_tipi END AS label FROM {history}")
def history_type_label(v):
    return v("history").select("id", S.history_type_label(F.col("islem_tipi")).alias("label"))


@query("effective_type", "SELECT batch_id, CASE WHEN min(islem_tipi) = max(islem_tipi) THEN max(islem_tipi) ELSE 'KARMA_ISLEM' END AS kind FROM {history} WHERE batch_id IS NOT NULL GROUP BY batch_id")
def effective_type(v):
    return v("history").where("batch_id IS NOT NULL").groupBy("batch_id").agg(F.min("islem_tipi").alias("lo"), F.max("islem_tipi").alias("hi")).select("batch_id", S.effective_type(F.col("lo"), F.col("hi")).alias("kind"))


@query("double_reversed", f"{ROLLBACK} SELECT m.id, NOT m.is_cancelled AS double_reversed FROM {{movements}} m JOIN batches b ON b.batch_id = m.batch_id WHERE b.reason IS NULL")
def double_reversed(v):
    return L.double_reversed(v("movements"), rolled_back(v)[1]).select("id", "double_reversed")
