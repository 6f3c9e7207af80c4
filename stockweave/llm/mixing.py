"""Mixing sources to target weights, in DataFrame operations only.

Targets share a total by weight, capped at a multiple of each source's size. Within its source every
row has a hash-random key; rows are split into key ranges, sizes are summed per range, the sums become
prefix sums over the ranges and then over the rows of each range, and the source is cut where the
prefix sum meets its budget. A budget over the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, small_or_shuffled, source_key, stage

#: The weights dealt out to the sources in turn, the share of all sizes to take, the most that a source or a row is repeated.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
#: Hex digits of the random key that name a range: 16 ** 3 ranges of each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of characters that are no white space; null has none. Between spaces added at both ends, with every run of white space as one space, there is a space more than words."""
    spaced = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    runs = F.regexp_replace(spaced, f"\\x20*[\\x09-\\x0D][{WHITE}]*|\\x20{{2,}}", " ")
    return (F.octet_length(runs) - F.octet_length(F.replace(runs, F.lit(" "), F.lit(""))) - 1).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, size) -> one row per source: source_key, source_size, weight, target double.

    Sources by code point, null last, take the weights in turn. A source's target is its weight's part
    of share * all sizes, at most `most` times its size; what is above goes to the others by weight.
    Sources in order of cap by weight: those are capped whose part, with all before them capped, reaches their cap;
    so every target is least(cap, weight * level), with the highest level found on the way.
    The source table (a row per source, not per document) is ordered in one task: sources are few beside documents.
    """
    per = sizes.groupBy(source_key(F.col("source")).alias("source_key")).agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source_key") == "n", "source_key")) - 1) % len(weights)
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = ranked.withColumn("level", level)
    return levelled.select("source_key", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(whole)).alias("target"))


def mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS, digits: int = RANGE_DIGITS) -> DataFrame:
    """rows (doc_id, source, size long, ...) -> the same rows with source_size, target, taken: the words that the mix takes of each.

    The budget is the target rounded to whole words: every row gives its size once per whole epoch, and the rest
    is cut from the rows in key order, the last of them in part. Keys are md5 of doc_id and size, so that rows without doc_id, or given one often, are spread;
    rows alike in both give the same, whatever their order. Rows without words give none; an empty table gives no rows.
    """
    keyed = rows.withColumn("source_key", source_key(F.col("source"))).withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))).withColumn("part", F.substring("key", 1, digits))
    sums = keyed.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_start"))
    # a row per source and range at most
    plan = starts.join(targets(rows, weights, share, most), "source_key")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0)
    within = Window.partitionBy("source_key", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = keyed.join(plan, ["source_key", "part"]).withColumn("epochs", epochs).withColumn("before", F.col("part_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return cut.withColumn("taken", taken.cast("long")).drop("source_key", "key", "part", "part_start", "weight", "epochs", "before")


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken; texts are read once, for their sizes."""
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space unchanged."""
    pieces = F.regexp_extract_all(text, F.lit(f"([{WHITE}]*[^{WHITE}]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for every epoch that takes a document whole, and the cut document's first words.

    A document without words has nothing to take and adds no row. Rows equal in doc_id and text are taken as one row
    that gives what all of them give. n_chars, where there is such a column, follows the text.
    """
    key = F.xxhash64("doc_id", "text")
    narrow = stage(docs.select("doc_id", key.alias("row__"), "source", word_count(F.col("text")).alias("size")), "sizes")
    taken = mix(narrow).groupBy("row__", F.col("doc_id").alias("id__")).agg(F.max("size").alias("size__"), F.sum("taken").alias("taken__"), F.count("*").alias("repeats__"))
    taken = stage(taken.where("taken__ > 0"), "taken")
    rows = docs.withColumn("key__", key).join(small_or_shuffled(taken, 40), (F.col("key__") == F.col("row__")) & F.col("doc_id").eqNullSafe(F.col("id__")))
    if taken.where("repeats__ > 1").take(1):
        rows = rows.where("repeats__ = 1").unionByName(rows.where("repeats__ > 1").dropDuplicates(["row__", "id__"]))
    times = F.ceil(F.col("taken__") / F.col("size__")).cast("int")
    rows = rows.withColumn("copy__", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("size__"), F.col("taken__") - (F.col("copy__") - 1) * F.col("size__"))
    text = F.when(words < F.col("size__"), first_words(F.col("text"), words)).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
