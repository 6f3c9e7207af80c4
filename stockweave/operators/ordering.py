"""Numbers and running values in a stated order, over a whole table or within keys, without a single-task window.

Rows of the table, or of keys too large for a task, are dealt to range partitions of the sort key, slices, and each slice is summed up; a row's value is what the slices before it give
plus what the rows before it in its own slice give. Ties need a total order in the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockweave.sources.shared import stage

#: Rows of a key that are one window; a side of a join is broadcast up to so many bytes.
KEY_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: What a running value may be: how two stretches' values become one, and the value of an empty stretch.
_JOINED = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "bit_xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def numbered(df: DataFrame, order: list[Column], name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """df with 1-based numbers in the given order. The dealt rows are staged with their partition: bounds of ranges are sampled, and a second run could draw others."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *order).withColumn("slice__", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("slice__").agg(F.count("*").alias("n__"))
    before = Window.orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("slice__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    within = Window.partitionBy("slice__").orderBy(*order)
    return dealt.join(F.broadcast(starts), "slice__").withColumn(name, (F.col("start__") + F.row_number().over(within)).cast("bigint")).drop("slice__", "start__")


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], partitions: int | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """df with a running value per name, over the rows of its key up to and with this one: values are name -> (sum, bit_xor, min or max; column).

    Keys of at most key_rows rows are windows. A key of more lies in several slices, and each of them is a window of its own; what earlier slices give is known for keys that lie in
    more than one, of which there are fewer than slices: that side is bounded and broadcast. Null keys are a key; nulls add nothing to a sum. Rows are staged once.
    """
    ins = {f"{name}__in": c for name, (_, c) in values.items()}
    rows = stage(df.withColumns(ins), "running")
    total = lambda name: getattr(F, values[name][0])(f"{name}__in")
    renamed = [F.col(k).alias(f"{k}__key") for k in keys]
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    large = stage(rows.groupBy(*keys).agg(F.count("*").alias("n__")).where(F.col("n__") > key_rows).select(*renamed), "large")
    n_large = large.count()

    def windows(part: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumns({f"{name}__own": total(name).over(w) for name in values})

    if not n_large:
        own = windows(rows, keys)
        return own.select(*df.columns, *[_JOINED[kind](F.lit(None), F.col(f"{name}__own")).alias(name) for name, (kind, _) in values.items()])
    side = F.broadcast(large) if n_large * 256 <= BROADCAST_BYTES else large
    few = windows(rows.join(side, same, "left_anti"), keys)
    few = few.select(*df.columns, *[_JOINED[kind](F.lit(None), F.col(f"{name}__own")).alias(name) for name, (kind, _) in values.items()])
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.join(side, same, "left_semi").repartitionByRange(n, *keys, *order).withColumn("slice__", F.spark_partition_id()), "ordered")
    slices = dealt.groupBy(*keys, "slice__").agg(*[total(name).alias(name) for name in values])
    several = slices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slice__", *values))).alias("slices__")).where(F.size("slices__") > 1)
    ahead = Window.partitionBy(*keys).orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1)
    starts = several.select(*keys, F.explode("slices__").alias("of_slice__")).select(*keys, "of_slice__.*")
    starts = starts.select(*renamed, F.col("slice__").alias("slice_at__"), *[getattr(F, values[name][0])(name).over(ahead).alias(f"{name}__start") for name in values])
    met = windows(dealt.join(F.broadcast(starts), same & (F.col("slice__") == F.col("slice_at__")), "left"), [*keys, "slice__"])
    return few.unionByName(met.select(*df.columns, *[_JOINED[kind](F.col(f"{name}__start"), F.col(f"{name}__own")).alias(name) for name, (kind, _) in values.items()]))


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "row_no", partitions: int | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """df with 1-based numbers (bigint) within each key in the given order."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, partitions, key_rows)
