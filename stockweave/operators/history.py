"""Audit history: visibility, batch roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockweave.functions.scalars import DASH, clean_cell, effective_type, format_ts, null_to_dash, operation_label

from .ordering import numbered


def visible(history: DataFrame, viewer: int | None, is_admin: bool) -> DataFrame:
    """An admin sees all rows, others their own; rows without a user are no one's own."""
    return history if is_admin else history.where(F.col("user_id") == viewer)


def history_enriched(history: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("user_id"), "username", "full_name")
    return history.join(u, "user_id", "left")


def list_history(history: DataFrame, users: DataFrame, viewer: int | None = None, is_admin: bool = True) -> DataFrame:
    """Visible rows with their user, newest first."""
    return history_enriched(visible(history, viewer, is_admin), users).orderBy(F.desc("tarih_saat"), F.desc("id"))


def batch_detail(history: DataFrame, users: DataFrame, batch_id: str, viewer: int | None = None, is_admin: bool = True) -> DataFrame:
    """Visible rows of one batch, oldest first; the batch filter reaches the scan."""
    return history_enriched(visible(history.where(F.col("batch_id") == batch_id), viewer, is_admin), users).orderBy("tarih_saat", "id")


def batch_summary(history: DataFrame, viewer: int | None = None, is_admin: bool = True) -> DataFrame:
    """A row per visible batch and user, batches without a user kept: type (mixed when its types differ), first time, lines, greatest recipient and description, cancelled when any line is."""
    rows = visible(history, viewer, is_admin).where("batch_id IS NOT NULL")
    g = rows.groupBy("batch_id", "user_id").agg(
        F.min("islem_tipi").alias("lo"), F.max("islem_tipi").alias("hi"), F.min("tarih_saat").alias("tarih_saat"), F.count("*").alias("toplam_urun"),
        F.max("recipient_name").alias("recipient_name"), F.max("aciklama").alias("aciklama"), F.max(F.col("is_cancelled").cast("int")).alias("c"),
    )
    return g.select("batch_id", "user_id", effective_type(F.col("lo"), F.col("hi")).alias("islem_tipi"), "tarih_saat", "toplam_urun", "recipient_name", "aciklama", (F.col("c") == 1).alias("is_cancelled"))


def history_summary(history: DataFrame, viewer: int | None = None, is_admin: bool = True, ordered: bool = True) -> DataFrame:
    """Single rows and batch roll-ups together, newest first: one scan filter, one shuffle for the roll-up, one for the order."""
    none = lambda t: F.lit(None).cast(t)
    singles = visible(history, viewer, is_admin).where("batch_id IS NULL").select("id", none("string").alias("batch_id"), F.lit(False).alias("is_batch"), "user_id", "islem_tipi", "urun_adi", "miktar", "aciklama", "recipient_name", F.lit(0).cast("bigint").alias("toplam_urun"), "is_cancelled", "tarih_saat")
    batches = batch_summary(history, viewer, is_admin).select(none("bigint").alias("id"), "batch_id", F.lit(True).alias("is_batch"), "user_id", "islem_tipi", none("string").alias("urun_adi"), none("int").alias("miktar"), "aciklama", "recipient_name", "toplam_urun", "is_cancelled", "tarih_saat")
    out = singles.unionByName(batches)
    return out.orderBy(F.desc("tarih_saat"), F.desc_nulls_last("id"), F.desc_nulls_last("batch_id")) if ordered else out


def history_batch_count(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if("is_batch").alias("batches"), F.count("*").alias("rows"))


def stock_report(products: DataFrame) -> DataFrame:
    """The seven columns of the stock report, by name whatever the case, then id."""
    n = numbered(products, [F.lower("name"), F.col("id")])
    return n.select("row_no", null_to_dash(F.col("code")).alias("code"), "name", F.col("quantity").cast("string").alias("quantity"), null_to_dash(F.col("unit")).alias("unit"), null_to_dash(F.col("category")).alias("category"), format_ts(F.coalesce("updated_at", "created_at")).alias("changed"))


def filtered_stock_list(products: DataFrame) -> DataFrame:
    """The eight columns of a filtered list with its total count, by id."""
    total = products.agg(F.count("*").alias("total"))  # one row
    rows = numbered(products, [F.col("id")]).join(F.broadcast(total), F.lit(True))
    dashed = lambda *names: [null_to_dash(F.col(c)).alias(c) for c in names]
    texts = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    return rows.select("row_no", clean_cell(F.col("name")).alias("name"), *dashed("category", "source"), *texts("quantity", "min_stock_level"), *dashed("unit", "shelf_location"), "total")


def signed_quantity(kind: Column, quantity: Column) -> Column:
    return F.concat(operation_label(kind)["sign"], quantity.cast("string"))


def batch_detail_report(history: DataFrame) -> DataFrame:
    """Every batch's report rows: number, name, signed quantity, description, time; the header's recipient and description are those of the first row that has one."""
    order = Window.partitionBy("batch_id").orderBy("tarih_saat", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = history.where("batch_id IS NOT NULL")
    return rows.select(
        "batch_id", F.row_number().over(order).alias("row_no"), F.coalesce("urun_adi", F.lit(DASH)).alias("urun_adi"), signed_quantity(F.col("islem_tipi"), F.col("miktar")).alias("miktar"),
        null_to_dash(F.col("aciklama")).alias("aciklama"), format_ts(F.col("tarih_saat")).alias("tarih"),
        F.first("recipient_name", ignorenulls=True).over(whole).alias("header_recipient"), F.first("aciklama", ignorenulls=True).over(whole).alias("header_description"),
    )
