"""Secret scans with corpus-wide ownership frequency.

Every text is searched for three kinds of credentials and for further candidates: long mixed strings of high
entropy. The hash of each candidate's value is counted over the distinct owners, repositories and texts in which it occurs. A value
that several owners share, or that one owner has in many repositories or texts, is a copied example and adds nothing; any other looks live
and adds a span of kind "owner" where no other span lies.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The kinds of spans in the order in which they are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "owner")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
LEAST_VALUE = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Further candidates: long strings with a letter and a digit, of at least so many bits of entropy a character.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.5
#: Owners, repositories and distinct texts from which on a value is a copied example; each alone is enough.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, EXAMPLE_TEXTS = 2, 3, 10


def _entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _hash(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)


def find_spans(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans (start, end, kind), candidates (start, end, hash of the value)), in code points, of a whole UTF-8 text."""
    base, values = [], []
    if b"=" in text or b":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                base.append((m.start(), m.end(), 0))
                values.append((m.start(), m.end(), m[2]))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            base.append((m.start(), m.end(), kind))
            values.append((m.start(), m.end(), m[0]))
    base.sort(key=lambda s: (s[0], s[2]))
    k, end = 0, -1  # both lists go by start: base spans that begin before a candidate's end, and the farthest end of those
    for m in CANDIDATE.finditer(text):
        v = m[0]
        while k < len(base) and base[k][0] < m.end():
            end = max(end, base[k][1])
            k += 1
        if m.start() < end:
            continue
        if re.search(rb"[0-9]", v) and re.search(rb"[A-Za-z]", v) and _entropy(v) >= LEAST_BITS:
            values.append((m.start(), m.end(), v))
    if not values:
        return [], []
    if text.isascii():
        at = lambda k: k
    else:
        starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        at = lambda k: int(starts[k - 1]) if k else 0
    return [(at(s), at(e), k) for s, e, k in base], [(at(s), at(e), _hash(v)) for s, e, v in values]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, owner, repository, text_hash, base (array of start, stop, kind), found (array of start, stop, hash, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32())]))
        seen = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.int64()), ("own", pa.bool_())]))
        for batch in batches:
            base, found = [], []
            for text in pc.cast(pc.fill_null(batch.column(4), ""), pa.binary()).to_pylist():
                b, f = find_spans(text)
                places = {(s, e) for s, e, _ in b}
                base.append([{"start": s, "stop": e, "kind": k} for s, e, k in b])
                found.append([{"start": s, "stop": e, "hash": h, "own": (s, e) not in places} for s, e, h in f])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(base, span), pa.array(found, seen)], names=["doc_id", "owner", "repository", "text_hash", "base", "found"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(run, "doc_id long, owner string, repository string, text_hash long, base array<struct<start: long, stop: long, kind: int>>, found array<struct<start: long, stop: long, hash: long, own: boolean>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, owners, repositories, texts: in how many distinct ones each candidate value occurs. Rows without an owner count as one owner of their own; a repository belongs to its owner.

    Spark counts distinct (value, owner), (value, owner, repository) and (value, text) first, so a value copied everywhere is spread and combined before it is grouped.
    """
    seen = scanned.select("owner", "repository", "text_hash", F.explode("found.hash").alias("hash"))
    return seen.groupBy("hash").agg(F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("owner", "repository")).alias("repositories"), F.count_distinct("text_hash").alias("texts"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, example_texts: int = EXAMPLE_TEXTS) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per input row: doc_id, n_assign, n_access, n_hex, base, added, n_copied, n_live.

    base and added are spans (start, stop, kind) in code points, stop exclusive, by start. Per kind matches are leftmost and do not
    overlap. added holds candidates that are not copied. n_copied and n_live count the row's base
    spans by whether their value is copied: it occurs with `example_owners` owners, in `example_repositories` repositories or in `example_texts` distinct texts, or more. A null text is empty; null owners and
    repositories are values of their own; repeated rows are each reported; other columns are not read; an empty table gives no rows.
    """
    scanned = stage(scan(docs, owner, repository).withColumn("row__", F.monotonically_increasing_id()), "scanned")
    freq = ownership(scanned)
    each = scanned.select("row__", F.explode("found").alias("f")).select("row__", "f.start", "f.stop", "f.hash", "f.own")
    judged = each.join(freq, "hash", "left").withColumn("copied", F.coalesce((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories) | (F.col("texts") >= example_texts), F.lit(False)))
    live = F.when(F.col("own") & ~F.col("copied"), F.struct("start", "stop", F.lit(3).alias("kind")))
    extra = judged.groupBy("row__").agg(F.array_sort(F.collect_list(live)).alias("added"), F.count_if(~F.col("own") & F.col("copied")).alias("n_copied"), F.count_if(~F.col("own") & ~F.col("copied")).alias("n_live"))
    out = scanned.join(extra, "row__", "left")
    none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint, kind: int>>)")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base", F.coalesce("added", none).alias("added"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop, joined by commas, by start, then by kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
