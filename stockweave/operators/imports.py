"""Confirmation of an import: stocks, new products and history rows as new snapshots, all or nothing per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scalars import INT_MAX, canonical_name, trim_to_null

from .consolidate import confirmed_row_errors
from .matching import group_facts, no_match


def decide(rows: DataFrame, products: DataFrame, source: str) -> DataFrame:
    """rows (position, product_name, product_code, quantity, price, imported_quantity, canonical_name, resolution_type, selected_product_id, match_fingerprint, is_valid, review_required, match_review_required)
    -> with decision EXISTING or NEW, target_id, and error where the row stops the import.

    A fingerprint that no longer fits is stale. One product in the source is the target, whatever was chosen if nothing else was.
    Else an explicit choice counts: an existing product among those of the source, or of all if the source has none, or a new one if the source has none; both need a fingerprint.
    """
    facts = group_facts(products, source).select("key__", "n_all", "n_own", F.col("own_id").alias("only"), "printed")
    m = confirmed_row_errors(rows).withColumn("key", canonical_name(F.col("product_name"))).join(facts, F.col("key") == F.col("key__"), "left")
    # the product chosen, if it is a match of the row; no list of matches goes with a row
    picked = products.select(F.col("id").alias("picked__"), canonical_name(F.col("name")).alias("picked_key__"), F.col("source").alias("picked_source__"))
    m = m.join(picked, (F.col("selected_product_id") == F.col("picked__")) & (F.col("key") == F.col("picked_key__")), "left")
    n_own, n_all, only = F.coalesce("n_own", F.lit(0)), F.coalesce("n_all", F.lit(0)), F.col("only")
    live = F.coalesce("printed", no_match(source))
    allowed = F.col("picked__").isNotNull() & ((n_own == 0) | F.col("picked_source__").eqNullSafe(F.lit(source)))
    chosen = F.col("selected_product_id")
    previewed = F.length(F.trim(F.coalesce("match_fingerprint", F.lit("")))) > 0
    existing, new = F.col("resolution_type") == "EXISTING", F.col("resolution_type") == "NEW"
    picks = existing & chosen.isNotNull()
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("match_fingerprint").isNotNull() & (F.col("match_fingerprint") != live), "matches have changed")
        .when((n_own == 1) & chosen.isNotNull() & (chosen != only), "chosen product does not fit the source")
        .when(n_own == 1, None)
        .when(picks & ~previewed, "choice rests on no preview")
        .when(picks & ~allowed, "chosen product is not valid")
        .when(picks, None)
        .when(n_all == 0, None)
        .when(new & (n_own > 0), "source has the product already")
        .when(new & ~previewed, "choice rests on no preview")
        .when(new, None)
        .otherwise("match is open")
    )
    target = F.when(n_own == 1, only).when(picks, chosen)
    return m.withColumn("error", problem).withColumn("target_id", F.when(problem.isNull(), target)).withColumn("decision", F.when(problem.isNull(), F.when(target.isNotNull(), "EXISTING").otherwise("NEW"))).drop("key__", "n_all", "n_own", "only", "printed", "picked__", "picked_key__", "picked_source__")


def confirm_import(decided: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """decided (batch_id, position, product_name, product_code, quantity, source, decision, target_id, error) -> updated stocks, new products, history rows, and batches with counts.

    Any error, or a stock beyond int, rejects the whole batch. Rows of one product add up. Each batch is applied to the given products.
    """
    stock = products.select(F.col("id").alias("target_id"), F.col("quantity").cast("bigint").alias("stock"), F.col("name").alias("target_name"))
    added = decided.where("decision = 'EXISTING'").groupBy("batch_id", "target_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("added"))
    sums = added.join(stock, "target_id").withColumn("new_stock", F.col("stock") + F.col("added"))
    over = sums.where(F.col("new_stock") > INT_MAX).select("batch_id").distinct().withColumn("over", F.lit(True))
    batches = decided.groupBy("batch_id").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("decision") == "NEW").alias("created"), F.count_if(F.col("decision") == "EXISTING").alias("updated"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("position"))).alias("reason"))
    batches = batches.join(over, "batch_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("over"), "stock beyond int"))).withColumn("accepted", F.col("reason").isNull()).drop("over")
    ok = batches.where("accepted").select("batch_id")
    rows = decided.join(ok, "batch_id", "left_semi")
    fresh = rows.where("decision = 'NEW'").select("batch_id", "position", trim_to_null(F.col("product_code")).alias("code"), trim_to_null(F.col("product_name")).alias("name"), "quantity", "source")
    named = rows.join(stock.select("target_id", "target_name"), "target_id", "left")
    history = named.select("batch_id", "position", F.lit("PDF_YUKLEME").alias("islem_tipi"), F.coalesce("target_name", trim_to_null(F.col("product_name"))).alias("urun_adi"), F.col("quantity").alias("miktar"), F.concat(F.lit("Toplu İçe Aktarım - Miktar: "), F.col("quantity").cast("string")).alias("aciklama"), F.col("target_id").alias("product_id"))
    counts = batches.select("batch_id", "accepted", "reason", "errors", F.when(F.col("accepted"), F.col("created")).otherwise(0).alias("created"), F.when(F.col("accepted"), F.col("updated")).otherwise(0).alias("updated"))
    return {"stocks": sums.join(ok, "batch_id", "left_semi").select("batch_id", F.col("target_id").alias("id"), "stock", "new_stock"), "products": fresh, "history": history, "batches": counts.withColumn("total", F.col("created") + F.col("updated"))}
