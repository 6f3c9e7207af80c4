import random

from pyspark.sql import functions as F

from stockweave.operators.ordering import numbered_within, running


def rows_of(n, hot):
    """Rows of which a share `hot` has one key; keys may be null."""
    rng = random.Random(n)
    return [("hot" if rng.random() < hot else rng.choice([None, "a", "b", "c"]), k, rng.randint(-50, 50)) for k in rng.sample(range(10 * n), n)]


def plain(rows):
    out = []
    for key in {r[0] for r in rows}:
        total, xor, least, most = 0, 0, None, None
        for n, (_, at, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total, xor = total + v, xor ^ v
            least, most = min(v, v if least is None else least), max(v, v if most is None else most)
            out.append((key, at, v, n, total, xor, least, most))
    return sorted(out, key=str)


def test_running_values_against_a_walk(spark):
    rows = rows_of(600, 0.5)
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(7)
    v = F.col("v")
    for parts, key_rows in ((4, 1000), (1, 0), (4, 100), (40, 0)):
        got = running(df, ["key"], [F.col("at")], {"n": ("sum", F.lit(1)), "total": ("sum", v), "xor": ("bit_xor", v), "least": ("min", v), "most": ("max", v)}, parts, key_rows)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_a_key_of_most_rows_is_spread_over_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("key"), F.col("id").alias("at"))
    out = numbered_within(df, ["key"], [F.col("at")], "n", 8, 100)
    assert out.where("n <> at + 1").count() == 0 and out.count() == 4000
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 4000 * 0.7


def test_no_rows(spark):
    assert numbered_within(spark.range(0).select(F.col("id").alias("key"), "id"), ["key"], [F.col("id")]).count() == 0


def test_numbers_of_documents_do_not_depend_on_their_size(spark, monkeypatch):
    """Every operator that numbers rows of a document gives the same where a document lies in many slices."""
    from stockweave.operators import documents as D
    from stockweave.operators import ordering
    from stockweave.operators import reconcile as R

    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(9).alias("document"), F.col("id").alias("line"), (F.col("id") / 7).cast("int").alias("chunk_index"), F.col("id").alias("position"), F.lit("s").alias("sheet"), F.col("id").alias("row"), (F.col("id") % 4 == 0).alias("numbered"), F.lit(1).alias("page"), F.col("id").alias("ordinal"), F.col("id").alias("record_id"), F.when(F.col("id") % 6 > 0, F.col("id")).alias("insertion_index"), F.col("id").cast("int").alias("gap_ordinal"))
    records = rows.where("row % 5 = 0").withColumnRenamed("row", "source_row")

    def every():
        frames = [
            D.row_chunks(rows, ["document"], "line"),
            D.excel_chunks(rows, records),
            D.record_chunks(rows),
            R.global_row_numbers(rows, rows.where("chunk_index < 90")).select("document", "line", "row_number"),
            R.renumber_with_gaps(rows.select("document", "position"), rows.select("document", "insertion_index", "gap_ordinal")),
        ]
        return [sorted(map(str, f.collect())) for f in frames]

    want = every()
    monkeypatch.setattr(ordering.running, "__defaults__", (4, 20))
    monkeypatch.setattr(ordering.numbered_within, "__defaults__", ("row_no", 4, 20))
    assert every() == want and all(want)
