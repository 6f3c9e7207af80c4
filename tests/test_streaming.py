from datetime import datetime, timedelta

import pytest

from stockweave.streaming.ledger import stream_contribution_dedupe, stream_stock_ledger

EVENT = "event_id long, product_id long, movement_type string, quantity int"
ROW = "event_id long, ts timestamp, source_identity string, product_key string, quantity int"
START = datetime(2024, 1, 1)


def arrive(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{name}")


def run(spark, at, schema, stream, mode):
    """Everything that has arrived, from the checkpoint of the runs before; the rows that come out."""
    out = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    query = stream(source).writeStream.foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    stocks = spark.createDataFrame([(1, 10), (2, 2**31 - 2), (4, None)], "id long, quantity int")
    ledger = lambda rows: stream_stock_ledger(rows, stocks)
    arrive(spark, tmp_path, "a", [(3, 1, "OUT", 4), (1, 1, "OUT", 5), (2, 1, "OUT", 7), (4, 3, "IN", 1), (5, 2, "IN", 5), (6, 4, "IN", 1), (1, 1, "OUT", 5)], EVENT)
    got, _ = run(spark, tmp_path, EVENT, ledger, "update")
    assert sorted(got) == [(1, 1, False, 5, "repeated"), (1, 1, True, 5, None), (2, 1, False, 5, "insufficient stock"), (3, 1, True, 1, None), (4, 3, False, None, "unknown product"), (5, 2, False, 2**31 - 2, "stock beyond int"), (6, 4, False, None, "unknown product")]
    # another catalogue does not matter any more
    stocks = spark.createDataFrame([(1, 999)], "id long, quantity int")
    arrive(spark, tmp_path, "b", [(7, 1, "IN", None), (8, 1, None, 3), (9, None, "IN", 3), (10, 1, "IN", 0), (11, 1, "IN", 2), (3, 1, "OUT", 1), (None, 1, "OUT", 3), (None, 1, "OUT", 3)], EVENT)
    got, _ = run(spark, tmp_path, EVENT, ledger, "update")
    assert sorted(got, key=str) == sorted([(7, 1, False, 1, "quantity is missing"), (8, 1, False, 1, "type is missing"), (9, None, False, None, "product is missing"), (10, 1, False, 1, "quantity under 1"), (11, 1, True, 3, None), (3, 1, False, 1, "repeated"), (None, 1, True, 0, None), (None, 1, False, 0, "insufficient stock")], key=str)


def test_ledger_without_a_catalogue(spark, tmp_path):
    arrive(spark, tmp_path, "a", [(1, 1, "OUT", 4), (2, 1, "IN", 3), (3, 2, "OUT", 2)], EVENT)
    got, _ = run(spark, tmp_path, EVENT, lambda rows: stream_stock_ledger(rows, start_stock=2), "update")
    assert sorted(got) == [(1, 1, False, 2, "insufficient stock"), (2, 1, True, 5, None), (3, 2, True, 0, None)]


def test_contributions_count_once_and_again_after_a_preview(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    arrive(spark, tmp_path, "a", [(5, at(1), "x", "p", 50), (2, at(2), "x", "p", 20), (3, at(2), "y", "p", None), (4, at(3), None, "p", 9), (6, None, "x", "p", 9)], ROW)
    got, _ = run(spark, tmp_path, ROW, stream_contribution_dedupe, "append")
    assert sorted((r[0], r[2], r[4]) for r in got) == [(2, "x", 20), (3, "y", 0)]
    arrive(spark, tmp_path, "b", [(7, at(31), "x", "p", 1), (8, at(32), "x", "p", 2), (9, at(33), "x", "p", 3)], ROW)
    got, _ = run(spark, tmp_path, ROW, stream_contribution_dedupe, "append")
    assert [(r[0], r[4]) for r in got] == [(8, 2)]


def test_state_goes_when_previews_have_ended(spark, tmp_path):
    arrive(spark, tmp_path, "a", [(k, START, f"s{k}", "p", 1) for k in range(30)], ROW)
    run(spark, tmp_path, ROW, stream_contribution_dedupe, "append")
    arrive(spark, tmp_path, "b", [(100, START + timedelta(hours=2), "late", "p", 1)], ROW)
    _, query = run(spark, tmp_path, ROW, stream_contribution_dedupe, "append")
    rows = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert rows[-1] < 10 < max(rows[0], 30)
