import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stockweave.operators import history as H
from stockweave.operators import ledger as L

MOVE = "batch_id string, seq bigint, id bigint, product_id bigint, movement_type string, quantity int, created_at timestamp"
HIST = "id bigint, batch_id string, user_id bigint, product_id bigint, islem_tipi string, urun_adi string, miktar int, aciklama string, recipient_name string, is_cancelled boolean, tarih_saat timestamp_ntz"


def stocks(spark, **kv):
    return spark.createDataFrame([(int(k[1:]), f"p{k[1:]}", v) for k, v in kv.items()], "id bigint, name string, quantity int")


def moves(spark, *rows):
    return spark.createDataFrame([(b, n, n, p, t, q, datetime(2024, 1, 1) + timedelta(minutes=n)) for n, (b, p, t, q) in enumerate(rows)], MOVE)


def test_mixed_batch(spark):
    lines, batches = L.apply_movement_batch(moves(spark, ("b", 1, "IN", 2), ("b", 2, "OUT", 3)), stocks(spark, p1=10, p2=20))
    assert {(r.product_id, r.running) for r in lines.collect()} == {(1, 12), (2, 17)}
    assert batches.first().accepted


def test_independent_movements_against_a_batch(spark):
    m = moves(spark, ("b", 1, "OUT", 7), ("b", 1, "OUT", 3))
    s = stocks(spark, p1=5)
    got = [(r.accepted, r.stock_after) for r in L.replay_movements_with_rejection(m, s).orderBy("id").collect()]
    assert got == [(False, 5), (True, 2)]
    lines, batches = L.apply_movement_batch(m, s)
    assert lines.count() == 0 and batches.first().reason == "insufficient stock"


def test_replay_by_stretches_against_a_walk(spark):
    rng = random.Random(6)
    data = [("b", rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 9]), rng.choice(["IN", "OUT", "OUT"]) if k % 400 > 150 else "IN", rng.choice([1, 5, 40, None]) if k % 97 else 2**31 - 50) for k in range(2500)]
    start = {1: 30, 2: 0, 3: 7, 4: 2**31 - 100, 5: None}
    stock, want = dict(start), {}
    for n, (_, p, kind, q) in enumerate(data):
        if p in stock:
            after = None if stock[p] is None or q is None else stock[p] + (q if kind == "IN" else -q)
            ok = None if after is None else 0 <= after <= 2**31 - 1
            stock[p] = after if ok else stock[p]
            want[n] = (p, ok, stock[p])
    s = spark.createDataFrame([(k, f"p{k}", v) for k, v in start.items()], "id bigint, name string, quantity int")
    for stretch in (8, 300, 4096):
        got = {r.id: (r.product_id, r.accepted, r.stock_after) for r in L.replay_movements_with_rejection(moves(spark, *data), s, stretch).collect()}
        assert got == want


def test_stretches_without_rejections_are_not_streamed(spark, monkeypatch):
    seen = []
    streamed = L._streamed
    monkeypatch.setattr(L, "_streamed", lambda rows, order: (seen.append(rows.count()), streamed(rows, order))[1])
    m = spark.range(5000).select(F.lit(1).alias("product_id"), F.col("id").cast("timestamp").alias("created_at"), "id", F.when((F.col("id") % 2 == 0) | F.col("id").between(4000, 4010), "OUT").otherwise("IN").alias("movement_type"), F.lit(1).alias("quantity"))
    out = L.replay_movements_with_rejection(m, stocks(spark, p1=3), 100)
    assert out.count() == 5000 and seen[1] <= 50 + 3 * 100  # the other is of small products
    assert out.where("NOT accepted").count() > 0


def test_overflow_is_rejected(spark):
    _, batches = L.apply_movement_batch(moves(spark, ("b", 1, "IN", 2147483647)), stocks(spark, p1=1))
    assert batches.first().reason == "stock beyond int"


def history(spark, *rows):
    return spark.createDataFrame(rows, HIST)


T = [datetime(2024, 1, 1, h) for h in range(5)]


def test_rollback(spark):
    h = history(spark, (1, "b", 1, 1, "STOK_GIRIS", "p1", 5, None, None, False, T[0]), (2, "b", 1, 1, "STOK_CIKIS", "p1", 3, None, None, False, T[1]))
    stock, batches = L.rollback_batch(h, stocks(spark, p1=12))
    assert stock.first().stock == 10 and batches.first().lines == 2 and batches.first().accepted


def test_rollback_of_cancelled_row(spark):
    h = history(spark, (1, "b", 1, 1, "STOK_GIRIS", "p1", 5, None, None, True, T[0]))
    stock, batches = L.rollback_batch(h, stocks(spark, p1=12))
    assert stock.count() == 0 and batches.first().reason == "already cancelled"


def test_rollback_by_name(spark):
    h = history(spark, (1, "b", 1, None, "STOK_GIRIS", "p1", 5, None, None, False, T[0]), (2, "c", 1, None, "STOK_GIRIS", "none", 5, None, None, False, T[0]))
    t = {r.id: (r.target_id, r.target_problem) for r in L.rollback_target(h, stocks(spark, p1=12)).collect()}
    assert t == {1: (1, None), 2: (None, "no product of this name")}


def test_summary(spark):
    h = history(spark, *[(i, "b", 1, 1, t, "p", 1, "d", "r", c, T[i]) for i, (t, c) in enumerate([("STOK_GIRIS", False), ("STOK_CIKIS", True), ("STOK_GIRIS", False)])], (9, None, None, 1, "STOK_GIRIS", "p", 4, None, None, False, T[4]))
    rows = H.history_summary(h).collect()
    assert [r.is_batch for r in rows] == [False, True]
    b = rows[1]
    assert (b.toplam_urun, b.is_cancelled, b.islem_tipi, b.recipient_name, b.aciklama, b.tarih_saat) == (3, True, "KARMA_ISLEM", "r", "d", T[0])
    assert H.history_summary(h, viewer=1, is_admin=False).count() == 1


def test_cart(spark):
    a = spark.createDataFrame([(1, "IN"), (1, "OUT"), (2, "OUT"), (2, "OUT"), (3, "IN")], "product_id bigint, movement_type string")
    got = {r.product_id: (r.net_change, r.accepted) for r in L.net_cart_changes(a, stocks(spark, p1=0, p2=1, p3=0)).collect()}
    assert got == {2: (-2, False), 3: (1, True)}


def test_cancel(spark):
    m = moves(spark, ("b", 1, "IN", 5), ("b", 1, "OUT", 5)).withColumn("is_cancelled", F.lit(False))
    got = {r.id: (r.new_stock, r.reason) for r in L.cancel_movement(m.select("id"), m, stocks(spark, p1=3)).collect()}
    assert got == {0: (None, "insufficient stock"), 1: (8, None)}
