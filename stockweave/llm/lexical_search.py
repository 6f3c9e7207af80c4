"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

A first pass keeps of each document its length and how often it holds each term that any item asks for, and counts documents by term.
A second pass takes these rows in shards of bounded size, each with the lists of its terms in order of documents. For each item, the lists of rare terms are summed
term at a time into accumulators; the accumulators then are one more list with bounds, read document at a time beside the long lists of common
terms: blocks of documents whose bounds stay under the item's threshold are skipped, and where the long lists alone can't reach it only
accumulated documents are looked up in them. A task keeps the best of all its shards, so the threshold of one serves the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import short_batches, stage, text_chunks, word_hashes

#: Documents that an item returns.
TOP = 20
#: Bytes of items' texts that are asked at a time; entries of lists in a shard; documents of a block; blocks between two looks at the threshold.
ITEM_BYTES, SHARD_ENTRIES, BLOCK_DOCS, STRIDE = 8 << 20, 2_000_000, 128, 32
#: A list is short that holds at most this part of a shard's documents.
SHORT_PART = 1 / 8
#: Groups of tasks whose best are ranked before they meet.
SALTS = 64


class Items:
    """A block of items: the hashes of their terms, sorted, and of each item its terms as indexes there with their repeats."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashes = []
        for _, raw, offsets in text_chunks(pa.array(texts, pa.large_string())):
            h, counts = word_hashes(raw, offsets, "letters")
            hashes += np.split(h, np.cumsum(counts)[:-1])
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.terms = [np.unique(np.searchsorted(self.vocabulary, h), return_counts=True) for h in hashes]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _counted(items: Broadcast):
    """Texts -> a row per document that has terms: its number of terms, and which of the items' terms it holds how often; at the end a row without doc of the task's counts of documents by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        v, df = len(vocabulary), np.zeros(len(vocabulary), np.int64)

        def rows(ids, n, splits, terms, counts) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (terms, counts)]
            return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *lists, pa.array(np.zeros(len(n), bool))], names=["doc_id", "n", "terms", "counts", "stats"])

        for batch in batches:
            for at, raw, offsets in text_chunks(batch.column(1)):
                h, counts = word_hashes(raw, offsets, "letters")
                place = np.minimum(np.searchsorted(vocabulary, h), max(v - 1, 0))
                hit = vocabulary[place] == h if v else np.zeros(len(h), bool)
                row = np.repeat(np.arange(len(counts)), counts)[hit]
                held, tf = np.unique(row * max(v, 1) + place[hit], return_counts=True)
                row, terms = np.divmod(held, max(v, 1))
                df += np.bincount(terms, minlength=v)[:v]
                some = np.flatnonzero(counts > 0)
                ids = batch.column(0).slice(at, len(counts)).take(pa.array(some))
                yield rows(ids, counts[some], np.searchsorted(row, np.r_[some, len(counts)]), terms, tf)
        known = np.flatnonzero(df)
        # a task reads fewer than 2 ** 31 documents
        end = rows(pa.array([None], pa.int64()), np.zeros(1), np.array([0, len(known)]), known, df[known])
        yield end.set_column(4, "stats", pa.array([True]))

    return run


class Shard:
    """Lists of a shard: for each term its documents, in order, with what each gives for a weight of one."""

    def __init__(self, docs: np.ndarray, unknown: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, all_terms: int, vocabulary: int):
        order = np.lexsort((docs, unknown))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.docs, self.unknown = docs[order], unknown[order]
        if len(n) and 25 * int(n.max()) * n_docs >= 2**63:
            m = np.array([75 + 25 * int(x) * n_docs // all_terms for x in n], np.int64)
        else:
            m = 75 + 25 * n * n_docs // max(all_terms, 1)
        of = np.repeat(np.arange(len(n)), sizes)
        gives = 1_000_000_000 * counts // (1000 * counts + 12 * m[of])
        by_term = np.lexsort((rank[of], terms))
        self.places, self.gives = rank[of][by_term], gives[by_term]
        self.edges = np.searchsorted(terms[by_term], np.arange(vocabulary + 1))
        self.blocks = np.arange(0, max(len(docs), 1), BLOCK_DOCS)
        self._most: dict[int, np.ndarray] = {}

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.edges[term], self.edges[term + 1]
        return self.places[lo:hi], self.gives[lo:hi]

    def most(self, term: int) -> np.ndarray:
        """The most that a term gives in each block, for a weight of one."""
        if term not in self._most:
            places, gives = self.list(term)
            out = np.zeros(len(self.blocks), np.int64)
            np.maximum.at(out, places // BLOCK_DOCS, gives)
            self._most[term] = out
        return self._most[term]


class Best:
    """The best documents of an item so far: by score, then by document, those without doc_id last."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.docs, self.unknown = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """What a further document must score at least."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def take(self, scores: np.ndarray, docs: np.ndarray, unknown: np.ndarray) -> None:
        good = scores >= self.threshold
        s, d, u = (np.concatenate(p) for p in zip((self.scores, self.docs, self.unknown), (scores[good], docs[good], unknown[good]), strict=True))
        order = np.lexsort((d, u, -s))[: self.top]
        self.scores, self.docs, self.unknown = s[order], d[order], u[order]


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best, short_part: float = SHORT_PART) -> int:
    """Adds a shard's best documents for an item of these terms, each with its weight; returns how many documents were scored in the long lists."""
    n = len(shard.docs)
    length = shard.edges[terms + 1] - shard.edges[terms]
    used = (length > 0) & (weights > 0)
    short = used & (length <= short_part * n)
    accumulators = np.zeros(n, np.int64)
    for t, w in zip(terms[short], weights[short], strict=True):
        places, gives = shard.list(t)
        accumulators[places] += w * gives
    long = [(int(t), int(w)) for t, w in sorted(zip(terms[used & ~short], weights[used & ~short], strict=True), key=lambda x: -x[1])]
    threshold = best.threshold
    if short.any() and n >= best.top:  # sums of some lists are scores at least
        threshold = max(threshold, int(np.partition(accumulators, n - best.top)[n - best.top]))
    beside = np.zeros(len(shard.blocks), np.int64)
    for t, w in long:
        beside += w * shard.most(t)
    bound = np.maximum.reduceat(accumulators, shard.blocks) + beside if n else beside
    scored = 0
    alive = np.flatnonzero(bound >= threshold)
    for at in range(0, len(alive), STRIDE):
        now = alive[at : at + STRIDE]
        now = now[bound[now] >= threshold]
        # where the long lists may reach the threshold alone every document is a candidate, elsewhere only accumulated ones that may with them
        inside = (now[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).reshape(-1)
        inside = inside[inside < n]
        block = inside // BLOCK_DOCS
        open_ = (accumulators[inside] + beside[block] >= threshold) & ((accumulators[inside] > 0) | (beside[block] >= threshold))
        places = inside[open_]
        if not len(places):
            continue
        scored += len(places)
        scores, rest = accumulators[places], beside[places // BLOCK_DOCS]
        for t, w in long:
            held, gives = shard.list(t)
            hit = np.minimum(np.searchsorted(held, places), len(held) - 1)
            own = held[hit] == places
            scores = scores + np.where(own, w * gives[hit], 0)
            rest = rest - w * shard.most(t)[places // BLOCK_DOCS]
            may = scores + rest >= threshold
            places, scores, rest = places[may], scores[may], rest[may]
        best.take(scores, shard.docs[places], shard.unknown[places])
        threshold = max(threshold, best.threshold)
    return scored


def _ranked(items: Broadcast, facts: Broadcast, top: int, short_part: float):
    """Rows of _counted -> item (its index), doc_id, score: the task's best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, all_terms, weights = facts.value
        asked = [(terms, weights[terms] * repeats) for terms, repeats in items.value.terms]
        best = [Best(top) for _ in asked]
        held, entries = [], 0

        def through() -> None:
            docs, unknown, n, sizes, terms, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            shard = Shard(docs, unknown, n, sizes, terms, counts, n_docs, all_terms, len(weights))
            for (terms_, weights_), b in zip(asked, best, strict=True):
                search(shard, terms_, weights_, b, short_part)

        for batch in batches:
            doc, n, terms, counts = (batch.column(k) for k in range(4))
            values = [np.asarray(x.flatten()).astype(np.int64) for x in (terms, counts)]
            held.append((np.asarray(doc.fill_null(0)), np.asarray(doc.is_null()), np.asarray(n), np.asarray(terms.value_lengths()).astype(np.int64), *values))
            entries += len(values[0])
            if entries >= SHARD_ENTRIES:
                through()
                entries = 0
        if held:
            through()
        out = [(np.full(len(b.scores), k), pa.array(b.docs, mask=b.unknown), b.scores) for k, b in enumerate(best) if len(b.scores)]
        if out:
            item, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item).astype(np.int64)), pa.concat_arrays(doc), pa.array(np.concatenate(score))], names=["item", "doc_id", "score"])

    return run


def _of_block(docs: DataFrame, asked: DataFrame, top: int, short_part: float) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.toArrow()
    block = Items(rows["item_id"].to_pylist(), rows["text"].to_pylist())
    items = spark.sparkContext.broadcast(block)
    counted = stage(docs.mapInArrow(_counted(items), "doc_id long, n long, terms array<int>, counts array<int>, stats boolean"), "counted")
    n_docs, all_terms = counted.where("NOT stats").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a row per term of the block's items
    by_term = counted.where("stats").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df")).collect()
    weights = np.zeros(len(block.vocabulary), np.int64)
    for r in by_term:
        weights[r.terms] = weight(n_docs, r.df)
    facts = spark.sparkContext.broadcast((n_docs, all_terms, weights))
    found = counted.where("NOT stats AND size(terms) > 0").select("doc_id", "n", "terms", "counts").mapInArrow(_ranked(items, facts, top, short_part), "item long, doc_id long, score long")
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    numbers = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.ids)), pa.int64()), "item_id": rows["item_id"]}))
    return ranked.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, short_part: float = SHORT_PART) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> item_id, rank (from 1), doc_id, score: for each item the documents of the highest scores above 0.

    Every row of docs is a document; equal scores by doc_id, null last, and rows alike in both are ranked one after the other. Items equal in item_id and text are one. Null and empty texts have no terms:
    such documents do not count and such items return nothing. Items are asked in blocks of about item_bytes of text; every block reads all documents.
    Terms are compared by 64-bit hashes. Other columns are not read; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.groupBy("item_id", "text").agg(F.count("*").alias("n")).drop("n")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / item_bytes))
    out = None
    for k in range(blocks):
        part = _of_block(texts, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), top, short_part)
        out = part if out is None else out.unionByName(part)
    return out
