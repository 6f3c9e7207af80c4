"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

Every row gets a 64-bit hash of its normalised text. The index has one chain per hash. A directory
says which bucket a hash lies in: all buckets start as one, and every bucket that holds more chains
than its capacity is split by one more leading bit of the hash, which doubles the directory, until
none is overfull. Buckets follow the order of the hashes, so each owner task holds a range of keys:
it reads the chains of its buckets and the texts that were routed to them by the directory, and chains
texts of one hash that differ in their bytes. Every row takes its group from the chain and link it has there;
a text that is the only one of its chain needs no comparison, and none of its bytes are moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, partitions, small_or_shuffled, stage, unstage

#: Chains that a bucket of the index holds before it is split; shares in which a text's copies are counted before they meet.
BUCKET_CHAINS, SHARES = 100_000, 32


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space becomes one space. A single plain space already is one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"\\x20*[\\x09-\\x0D][{WHITE}]*|\\x20{{2,}}", " ")


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(chains: DataFrame, capacity: int = BUCKET_CHAINS) -> DataFrame:
    """chains (key long) -> staged (cell, depth, bucket, bits): for each cell, the keys that share `bits` leading bits, its bucket's local depth and the bucket's first cell.

    A bucket of depth d covers the cells that share d leading bits; it is the largest such that holds at most
    `capacity` chains. The full directory doubles until no cell is overfull: a chain is one key, so 64 bits are always enough.
    Its rows are cells that have chains: about 16 for each bucket that hash-random keys fill.
    """
    n = chains.count()
    bits = min(62, max(1, math.ceil(math.log2(max(n, 1) / capacity)) + 4 if n > capacity else 1))
    while True:
        cells = stage(chains.groupBy(_leading(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n")), "cells")
        if bits == 62 or not cells.where(F.col("n") > capacity).take(1):
            break
        unstage(cells)
        bits = min(62, bits + 4)
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)"))
    fits = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == bits)).select("depth", "bucket")
    least = levels.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("at"))
    out = stage(least.select("cell", "at.depth", "at.bucket", F.lit(bits).alias("bits")), "directory")
    unstage(cells)
    return out


def build_index(keyed: DataFrame, capacity: int = BUCKET_CHAINS) -> DataFrame:
    """keyed (doc_id, key) -> staged index (bucket, depth, key, n, least): one row per chain in the bucket that the directory names, in files of one range of buckets and keys each."""
    chains = stage(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "chains")
    cells = directory(chains, capacity)
    bits = cells.select("bits").first()
    # a key whose cell the directory lacks would be in no bucket
    placed = chains.withColumn("cell", _leading(F.col("key"), bits[0] if bits else 1)).join(small_or_shuffled(cells.drop("bits"), 24), "cell")
    index = stage(placed.select("bucket", "depth", "key", "n", "least").repartitionByRange(partitions(keyed.sparkSession), "bucket", "key"), "index")
    unstage(chains, cells)
    return index


def _chained(docs: DataFrame, routed: DataFrame) -> DataFrame:
    """The texts of the chains with several rows: bucket, key, link (place in the chain), sha, keep_id, group_size. Each owner of a range of buckets and keys compares the bytes that were routed there.

    routed (doc_id, bucket, key, n): rows with their bucket.
    """
    spark = docs.sparkSession
    several = routed.where("n > 1")
    members = stage(several.select(F.col("doc_id").alias("member")).distinct(), "members")
    chains = stage(several.select("bucket", "key").distinct(), "routes")
    read = docs.select("doc_id", "text").join(small_or_shuffled(members, 16), F.col("doc_id").eqNullSafe(F.col("member")), "left_semi")
    text = read.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm")).join(small_or_shuffled(chains, 24), "key")
    # copies of a text are counted in shares first, so that a text of very many rows reaches its owner as a few
    parts = text.groupBy("bucket", "key", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).alias("share")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = parts.repartitionByRange(partitions(spark), "bucket", "key").groupBy("bucket", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    link = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    return owned.select("bucket", "key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").withColumn("link", link)


def exact_groups(docs: DataFrame, capacity: int = BUCKET_CHAINS) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as empty.
    keep_id is the smallest doc_id of the group, nulls left out (null if all are). Where the row that
    stays was given several times under the same doc_id, exactly one of its repeats is kept.
    Other columns are not read, so names cannot clash; an empty table gives no rows.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = stage(text.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")), "keyed")
    routed = stage(keyed.join(build_index(keyed, capacity), "key"), "routed")
    unstage(keyed)
    # a chain of one row is one text; a row of any other takes its group from its link
    single = routed.where("n = 1").select("doc_id", F.col("least").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    links = stage(_chained(docs, routed), "links").select("bucket", "key", "sha", "keep_id", "group_size")
    again = F.row_number().over(Window.partitionBy("doc_id", "key", "sha").orderBy(F.lit(1)))
    several = routed.where("n > 1").withColumn("again", again).join(small_or_shuffled(links, 120), ["bucket", "key", "sha"])
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)
    return single.unionByName(several.select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated under one doc_id one stays."""
    gone = stage(exact_groups(docs).where("NOT kept").select(F.col("doc_id").alias("gone__"), F.col("text_sha256").alias("gone_sha__"), "keep_id"), "gone")
    copies = stage(gone.where("NOT (gone__ <=> keep_id)").select("gone__", "gone_sha__").distinct(), "copies")
    repeats = stage(gone.where("gone__ <=> keep_id").select("gone__", "gone_sha__").distinct(), "repeats")
    sha = F.sha2(normalised(F.col("text")), 256)
    # bounds instead of equality: the hash is then no join key and is computed only for rows whose doc_id matches
    same = F.col("doc_id").eqNullSafe(F.col("gone__")) & (sha >= F.col("gone_sha__")) & (sha <= F.col("gone_sha__"))
    rest = docs.join(small_or_shuffled(copies, 96), same, "left_anti")
    if not repeats.take(1):
        return rest
    repeats = small_or_shuffled(repeats, 96)
    nth = F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.lit(1)))
    once = rest.join(repeats, same, "left_semi").withColumn("nth__", nth).where("nth__ = 1").drop("nth__")
    return rest.join(repeats, same, "left_anti").unionByName(once)
