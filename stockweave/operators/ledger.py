"""Stock movements: batches, single movements, cancellation and rollback.

Stocks are summed as bigint; a result beyond int is a rejection, never a wrap. In a batch one failing row rejects all of it, so
prefix sums decide; independent movements are applied in order, as a rejected one changes what follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockweave.functions.scalars import INT_MAX
from stockweave.sources.shared import stage

from .ordering import BROADCAST_BYTES, running


def signed(kind: Column, quantity: Column) -> Column:
    return F.when(kind == "OUT", -quantity.cast("bigint")).otherwise(quantity.cast("bigint"))


def validate_movement_requests(requests: DataFrame) -> DataFrame:
    """requests (product_id, movement_type, quantity, ...) with accepted and the first reason against."""
    reason = F.when(F.col("product_id").isNull(), "product is missing").when(F.coalesce(~F.col("movement_type").isin("IN", "OUT"), F.lit(True)), "type is missing").when(F.col("quantity").isNull(), "quantity is missing").when(F.col("quantity") < 1, "quantity under 1")
    return requests.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def movement_enriched(movements: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Movements with their product's name and code and their user's name."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("code").alias("product_code"))
    u = users.select(F.col("id").alias("created_by"), F.col("full_name").alias("created_by_name"))
    return movements.join(p, "product_id").join(u, "created_by", "left")


def movements_by_product(movements: DataFrame, products: DataFrame, product_id: int) -> DataFrame:
    """Movements of one product, newest first; the filter is pushed into both scans. An unknown product gives no rows and is reported by catalog.unknown_ids."""
    known = products.where(F.col("id") == product_id).select(F.col("id").alias("product_id"))
    return movements.where(F.col("product_id") == product_id).join(known, "product_id", "left_semi")


def running_stock(movements: DataFrame, stocks: DataFrame) -> DataFrame:
    """movements (batch_id, seq, product_id, movement_type, quantity) with start and running stock within their batch, from stocks (id, quantity)."""
    s = stocks.select(F.col("id").alias("product_id"), F.col("quantity").cast("bigint").alias("start_stock"))
    order = Window.partitionBy("batch_id", "product_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    change = signed(F.col("movement_type"), F.col("quantity"))
    return movements.join(s, "product_id", "left").withColumn("running", F.col("start_stock") + F.sum(change).over(order))


def apply_movement_batch(movements: DataFrame, stocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of accepted batches with the stock after each, batches with accepted and reason). Each batch starts from the given stocks.

    A batch is rejected if any line has no known product, an invalid quantity, or leaves less than nothing or more than int.
    """
    lines = running_stock(movements, stocks)
    bad = F.when(F.col("start_stock").isNull(), "unknown product").when(F.col("quantity").isNull() | (F.col("quantity") < 1), "invalid quantity").when(F.col("running") < 0, "insufficient stock").when(F.col("running") > INT_MAX, "stock beyond int")
    lines = lines.withColumn("problem", bad)
    batches = lines.groupBy("batch_id").agg(F.count("*").alias("lines"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("reason")).withColumn("accepted", F.col("reason").isNull())
    good = lines.join(batches.where("accepted").select("batch_id"), "batch_id", "left_semi").drop("problem")
    return good, batches


def stock_after_batch(lines: DataFrame) -> DataFrame:
    """The last running stock of each batch and product."""
    return lines.groupBy("batch_id", "product_id").agg(F.max_by("running", "seq").alias("stock"))


#: Movements of a product that are one stretch of its history.
STRETCH = 4096


def replay_movements_with_rejection(movements: DataFrame, stocks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Independent movements (id, product_id, movement_type, quantity, ordered by created_at, id) -> id, product_id, accepted, stock_after.

    An insufficient OUT, or an IN beyond int, leaves the stock as it is; one without quantity is neither accepted nor rejected; movements of unknown products give no row.
    A product of at most `stretch` movements is streamed with its stock as the only state. The history of any other is cut into stretches, and those that surely hold no rejection
    are applied as one sum: only the rest is streamed, and the rows of the others are filled in by all tasks.
    """
    s = stocks.select(F.col("id").alias("product_id"), F.col("quantity").cast("bigint").alias("start_stock"))
    lines = movements.select("product_id", "created_at", "id", signed(F.col("movement_type"), F.col("quantity")).cast("bigint").alias("change"))
    large = stage(lines.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") > stretch).select("product_id"), "large")
    n = large.count()
    if not n:
        return _streamed(lines.join(s, "product_id").withColumn("i", F.lit(0)), ["created_at", "id"]).select("id", "product_id", "accepted", "stock_after")
    side = F.broadcast(large) if n * 16 <= BROADCAST_BYTES else large
    few = _streamed(lines.join(side, "product_id", "left_anti").join(s, "product_id").withColumn("i", F.lit(0)), ["created_at", "id"])
    many = _by_stretches(lines.join(side, "product_id", "left_semi").join(s, "product_id"), stretch)
    return few.select("id", "product_id", "accepted", "stock_after").unionByName(many.select("id", "product_id", "accepted", "stock_after"))


def _streamed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (product_id, i, id, change, start_stock) in order -> product_id, i, id, before, accepted, stock_after. Nothing is held but the stock of one product."""
    ordered = rows.repartition("product_id").sortWithinPartitions("product_id", *order).select("product_id", "i", "id", "change", "start_stock")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, stock = None, None
        for batch in batches:
            before, accepted, after = [], [], []
            for p, change, start in zip(*[batch.column(k).to_pylist() for k in (0, 3, 4)], strict=True):
                if p != product:
                    product, stock = p, start
                before.append(stock)
                new = None if stock is None or change is None else stock + change
                ok = None if new is None else 0 <= new <= INT_MAX
                stock = new if ok else stock
                accepted.append(ok)
                after.append(stock)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.int64()), pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], names=["product_id", "i", "id", "before", "accepted", "stock_after"])

    return ordered.mapInArrow(run, f"product_id {kinds['product_id']}, i {kinds['i']}, id {kinds['id']}, before bigint, accepted boolean, stock_after bigint")


def _by_stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """rows (product_id, created_at, id, change, start_stock) -> id, product_id, accepted, stock_after.

    A stock that is cut to 0 where an OUT asks for more is never above the true one, which keeps what it has. That lower stock has a closed form: the sum so far less
    the least sum so far if that is under 0. A stretch in which it is not cut, and before whose end all that came in stays within int, holds no rejection.
    """
    change = F.coalesce("change", F.lit(0))
    placed = running(rows, ["product_id"], [F.col("created_at"), F.col("id")], {"i": ("sum", F.lit(1).cast("bigint")), "p": ("sum", change), "came": ("sum", F.greatest(change, F.lit(0)))})
    placed = stage(placed.select("product_id", "id", "change", "start_stock", "i", "p", "came", ((F.col("i") - 1) / stretch).cast("bigint").alias("part")), "placed")
    parts = placed.groupBy("product_id", "part").agg(F.min("start_stock").alias("start_stock"), F.min("i").alias("i"), F.min("p").alias("least"), F.max_by("p", "i").alias("last"), F.max("came").alias("came"))
    w = Window.partitionBy("product_id").orderBy("part")  # a row per stretch
    parts = parts.withColumn("entered", F.coalesce(F.lag("last").over(w), F.lit(0))).withColumn("least_before", F.min("least").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lower = F.col("start_stock") + F.col("entered") - F.least(F.lit(0), F.col("start_stock") + F.coalesce("least_before", F.lit(0)))
    sure = (lower + F.col("least") - F.col("entered") >= 0) & (F.col("start_stock") + F.col("came") <= INT_MAX)
    parts = stage(parts.select("product_id", "part", "start_stock", "i", "entered", (F.col("last") - F.col("entered")).alias("sum"), F.coalesce(sure, F.lit(False)).alias("sure")), "parts")
    whole = parts.where("sure").select("product_id", "i", F.lit(None).cast(dict(placed.dtypes)["id"]).alias("id"), F.col("sum").alias("change"), "start_stock")
    single = placed.join(parts.where("NOT sure").select("product_id", "part"), ["product_id", "part"], "left_semi").select("product_id", "i", "id", "change", "start_stock")
    walked = stage(_streamed(whole.unionByName(single), ["i"]), "walked")
    entering = parts.where("sure").select("product_id", "part", "i", "entered").join(walked.select("product_id", "i", "before"), ["product_id", "i"]).select("product_id", "part", "entered", "before")
    filled = placed.join(entering, ["product_id", "part"]).select("id", "product_id", F.when(F.col("change").isNotNull(), F.lit(True)).alias("accepted"), (F.col("before") + F.col("p") - F.col("entered")).alias("stock_after"))
    rest = walked.join(parts.where("sure").select("product_id", "i"), ["product_id", "i"], "left_anti").select("id", "product_id", "accepted", "stock_after")
    return filled.unionByName(rest)


def cancel_movement(requests: DataFrame, movements: DataFrame, stocks: DataFrame) -> DataFrame:
    """requests (id of a movement) -> id, product_id, new_stock, accepted, reason. Each is judged on the given stocks; a cancelled one is a conflict."""
    m = movements.select("id", "product_id", "movement_type", "quantity", "is_cancelled")
    s = stocks.select(F.col("id").alias("product_id"), F.col("quantity").cast("bigint").alias("stock"))
    j = requests.select("id").join(m, "id", "left").join(s, "product_id", "left")
    new = F.col("stock") - signed(F.col("movement_type"), F.col("quantity"))
    reason = F.when(F.col("movement_type").isNull(), "unknown movement").when(F.col("is_cancelled"), "already cancelled").when(F.col("stock").isNull(), "unknown product").when(new < 0, "insufficient stock").when(new > INT_MAX, "stock beyond int")
    return j.select("id", "product_id", F.when(reason.isNull(), new).alias("new_stock"), reason.isNull().alias("accepted"), reason.alias("reason"))


def rollback_target(history: DataFrame, products: DataFrame) -> DataFrame:
    """history rows with target_id: the product of product_id, else the only one of exactly that name; target_problem says why there is none."""
    by_id = products.select(F.col("id").alias("hit_id"))
    names = products.groupBy(F.col("name").alias("hit_name")).agg(F.count("*").alias("hits"), F.min("id").alias("named_id"))
    j = history.join(by_id, F.col("product_id") == F.col("hit_id"), "left").join(names, F.col("urun_adi") == F.col("hit_name"), "left")
    named = F.when(F.col("product_id").isNull() & (F.col("hits") == 1), F.col("named_id"))
    problem = F.when(F.coalesce(F.col("hit_id"), named).isNotNull(), None).when(F.col("product_id").isNotNull(), "product missing").when(F.trim(F.coalesce("urun_adi", F.lit(""))) == "", "name is blank").when(F.coalesce("hits", F.lit(0)) == 0, "no product of this name").otherwise("name is not unique")
    return j.withColumn("target_id", F.coalesce("hit_id", named)).withColumn("target_problem", problem).drop("hit_id", "hit_name", "hits", "named_id")


def rollback_batch(history: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reverses whole batches of history -> (batch_id, product_id, stock after) and (batch_id, accepted, reason, lines).

    Newest line first: what came in is taken back and may at no step leave less than nothing, what went out returns and may not pass int. Any cancelled,
    non-positive or unresolvable line, or another type, rejects the batch. Each batch is judged on the given stocks; stock_movements are not touched.
    """
    rows = rollback_target(history.where("batch_id IS NOT NULL"), products)
    change = F.when(F.col("islem_tipi") == "STOK_CIKIS", F.col("miktar").cast("bigint")).otherwise(-F.col("miktar").cast("bigint"))
    s = products.select(F.col("id").alias("target_id"), F.col("quantity").cast("bigint").alias("stock"))
    newest = Window.partitionBy("batch_id", "target_id").orderBy(F.desc("tarih_saat"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.join(s, "target_id", "left").withColumn("after", F.col("stock") + F.sum(change).over(newest))
    bad = F.when(F.col("is_cancelled"), "already cancelled").when(F.coalesce(F.col("miktar") <= 0, F.lit(True)), "invalid quantity").when(~F.col("islem_tipi").isin("STOK_GIRIS", "STOK_CIKIS", "PDF_YUKLEME", "TOPLU_ICE_AKTARIM"), "type cannot be reversed").when(F.col("target_problem").isNotNull(), F.col("target_problem")).when(F.col("after") < 0, "insufficient stock").when(F.col("after") > INT_MAX, "stock beyond int")
    lines = lines.withColumn("problem", bad)
    place = F.when(F.col("problem").isNotNull(), F.struct("tarih_saat", "id"))
    batches = lines.groupBy("batch_id").agg(F.count("*").alias("lines"), F.max_by("problem", place).alias("reason")).withColumn("accepted", F.col("reason").isNull())
    good = lines.join(batches.where("accepted").select("batch_id"), "batch_id", "left_semi")
    oldest = F.struct((-F.unix_micros(F.col("tarih_saat").cast("timestamp"))).alias("t"), (-F.col("id")).alias("i"))
    return good.groupBy("batch_id", F.col("target_id").alias("product_id")).agg(F.max_by("after", oldest).alias("stock")), batches


def double_reversed(movements: DataFrame, batches: DataFrame) -> DataFrame:
    """Movements of rolled-back batches: they stay active in their own ledger, so that cancelling one would reverse it twice."""
    return movements.join(batches.where("accepted").select("batch_id"), "batch_id", "left_semi").withColumn("double_reversed", ~F.col("is_cancelled"))


def net_cart_changes(actions: DataFrame, stocks: DataFrame) -> DataFrame:
    """actions (product_id, movement_type) -> product_id, net_change, movement_type, quantity, accepted: one request per product with a net; a net out beyond the stock is rejected."""
    net = actions.groupBy("product_id").agg(F.sum(F.when(F.col("movement_type") == "IN", 1).otherwise(-1)).alias("net_change")).where("net_change <> 0")
    s = stocks.select(F.col("id").alias("product_id"), F.col("quantity").cast("bigint").alias("stock"))
    kind = F.when(F.col("net_change") > 0, "IN").otherwise("OUT")
    return net.join(s, "product_id").select("product_id", "net_change", kind.alias("movement_type"), F.abs("net_change").alias("quantity"), (F.col("stock") + F.col("net_change") >= 0).alias("accepted"))
