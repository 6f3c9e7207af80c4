"""Streaming queries: a file stream of events run to its end, its result read from a sink in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions.scalars import canonical_name
from stockweave.sources.shared import new_folder
from stockweave.sources.views import VIEWS, duckdb_sql, frame
from stockweave.streaming.ledger import CONTRIBUTION, LEDGER, ROCKSDB, stream_contribution_dedupe, stream_stock_ledger

from .registry import ORACLES, QUERIES, query


def _run(spark: SparkSession, stream: DataFrame, schema, mode: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that its source holds; every micro-batch is appended to parquet with its number."""
    at = new_folder(spark, "stream")
    old = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)

        def sink(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/{number}")

        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(f"{at}/out/*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = frame(spark, sf_dir, "events").schema
    # a pattern, as the table may be one file or a folder of files
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return spark.sql(VIEWS["stream_events"], events=raw)


def _movements(events: DataFrame) -> DataFrame:
    """Events as movements, some without type or quantity, some given twice."""
    e = F.col("event_id")
    rows = events.withColumn("movement_type", F.when(e % 67 != 0, F.col("movement_type"))).withColumn("quantity", F.when(e % 61 != 0, F.col("quantity")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(e % 71 == 0, 2).otherwise(1))))


def stream_stock_ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every movement event from the catalogue's stocks on; its batch twin is replay_movements_with_rejection."""
    out = stream_stock_ledger(_movements(_events(spark, sf_dir)), frame(spark, sf_dir, "products").select("id", "quantity"))
    return _run(spark, out, LEDGER, "update", {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}).select("event_id", "product_id", "accepted", "stock", "reason")


def stream_contribution_dedupe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity of every product key: the sum of the contributions that count."""
    e = _events(spark, sf_dir)
    rows = e.select("event_id", "ts", F.concat(F.lit("xlsx:S:row:"), (F.col("event_id") % 1000).cast("string")).alias("source_identity"), canonical_name(F.concat(F.lit("Ürün_"), (F.col("event_id") % 1000 % 50).cast("string"))).alias("product_key"), "quantity")
    out = _run(spark, stream_contribution_dedupe(rows), CONTRIBUTION, "append", {"spark.sql.streaming.stateStore.providerClass": ROCKSDB})
    return out.groupBy("product_key").agg(F.count("*").alias("contributions"), F.sum("quantity").alias("quantity"))


QUERIES["stream_stock_ledger"] = stream_stock_ledger_query
# one file is one micro-batch, in which events go by id
ORACLES["stream_stock_ledger"] = duckdb_sql("""
WITH RECURSIVE events_given AS (
  SELECT e.event_id, e.product_id, p.quantity AS start_stock, CASE WHEN event_id % 67 = 0 THEN 'type is missing' WHEN event_id % 61 = 0 THEN 'quantity is missing' WHEN p.id IS NULL OR p.quantity IS NULL THEN 'unknown product' END AS reason,
    CASE WHEN movement_type = 'OUT' THEN -CAST(e.quantity AS BIGINT) ELSE e.quantity END AS change
  FROM {stream_events} e LEFT JOIN {products} p ON p.id = e.product_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY event_id) AS n FROM events_given WHERE reason IS NULL),
walk AS (
  SELECT product_id, n, event_id, start_stock + change >= 0 AS accepted, CAST(CASE WHEN start_stock + change >= 0 THEN start_stock + change ELSE start_stock END AS BIGINT) AS stock FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.product_id, o.n, o.event_id, w.stock + o.change >= 0, CASE WHEN w.stock + o.change >= 0 THEN w.stock + o.change ELSE w.stock END FROM walk w JOIN ordered o ON o.product_id = w.product_id AND o.n = w.n + 1),
refused AS (
  SELECT g.event_id, g.product_id, false AS accepted, coalesce((SELECT arg_max(w.stock, w.n) FROM walk w WHERE w.product_id = g.product_id AND w.event_id < g.event_id), g.start_stock) AS stock, g.reason FROM events_given g WHERE reason IS NOT NULL),
once AS (SELECT event_id, product_id, accepted, stock, CASE WHEN NOT accepted THEN 'insufficient stock' END AS reason FROM walk UNION ALL SELECT * FROM refused)
SELECT event_id, product_id, accepted, stock, reason FROM once UNION ALL SELECT event_id, product_id, false, stock, 'repeated' FROM once WHERE event_id % 71 = 0""")
QUERIES["stream_contribution_dedupe"] = stream_contribution_dedupe_query
ORACLES["stream_contribution_dedupe"] = duckdb_sql("""
WITH RECURSIVE ordered AS (SELECT event_id % 1000 AS source, event_id, ts, quantity, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY event_id) AS n FROM {stream_events}),
walk AS (
  SELECT source, n, quantity, true AS counts, ts AS since FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.source, o.n, o.quantity, o.ts >= w.since + INTERVAL 30 MINUTE, CASE WHEN o.ts >= w.since + INTERVAL 30 MINUTE THEN o.ts ELSE w.since END FROM walk w JOIN ordered o ON o.source = w.source AND o.n = w.n + 1)
SELECT 'ürün ' || CAST(source % 50 AS VARCHAR) AS product_key, count(*) AS contributions, CAST(sum(quantity) AS BIGINT) AS quantity FROM walk WHERE counts GROUP BY ALL""")


@query("stream_events", VIEWS["stream_events"])
def stream_events(v):
    """The movement feed as a batch."""
    return v("stream_events")
