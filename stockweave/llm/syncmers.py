"""Document fingerprints of closed syncmers, in DataFrame operations only.

The letters of a text are its words (in scripts without spaces its characters). A k-mer of K consecutive letters is an anchor if, of the
substrings of S letters within it, one with the least hash is the first or the last: that can be told from the k-mer alone, whatever
stands around it, so texts that share a passage share the anchors within it, and no stretch of K - S + 1 k-mers is without one.

A fingerprint is the sequence of the anchors, each as a hash of its letters and its distance from the anchor before. An anchor of two texts matches
only if both agree: the same letters at the same place relative to their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockweave.operators.ordering import numbered

from .common import WHITE, small_or_shuffled, stage

#: Letters of a k-mer and of its inner substrings; characters of a word at most, a longer one is several letters.
K, S, WORD_CHARS = 5, 2, 24
#: Documents that a window joins to their next ones.
SLICE_ROWS = 64
#: Bits of an anchor's hash, beside four for the distance.
HASH_BITS = 28
# Ranges of characters that are written without spaces between words (Thai to Lao, Burmese, Khmer, Han, kana and others).
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\x{20000}-\x{3ffff}"
LETTER = rf"[^{WHITE}{UNSPACED}]{{1,{WORD_CHARS}}}|[{UNSPACED}]"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array of (place, hash): where the closed syncmers of a text begin, counted in letters, and the hashes of their letters. Null is empty; a text of fewer than k letters is one anchor, one without letters has none."""
    letters = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTER), F.lit(0)), lambda x: F.xxhash64(x))
    last = k - s

    def chosen(inner: Column) -> Column:
        edge = lambda x, i: F.least(x, F.get(inner, i + last))
        within = [lambda i, j=j: F.get(inner, i + j) for j in range(1, last)]
        found = F.transform(inner, lambda x, i: F.when((i < F.size(inner) - last) & (F.least(*[g(i) for g in within]) >= edge(x, i)), i))
        covering = sorted({*range(0, last + 1, s), last})
        return F.transform(F.filter(found, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(inner, i + j) for j in covering]).alias("hash")))

    def of(letters: Column) -> Column:
        inner = F.transform(letters, lambda x, i: F.when(i <= F.size(letters) - s, F.xxhash64(x, *[F.get(letters, i + j) for j in range(1, s)])))
        kmers = _let(F.filter(inner, lambda x: x.isNotNull()), chosen)
        whole = F.array(F.struct(F.lit(0).alias("place"), F.aggregate(letters, F.lit(0).cast("long"), lambda h, x: F.xxhash64(h, x)).alias("hash")))
        return F.when(F.size(letters) >= k, kmers).when(F.size(letters) > 0, whole).otherwise(F.array().cast("array<struct<place: int, hash: bigint>>"))

    return _let(letters, of)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """array<int>: the anchors in order, each HASH_BITS of its hash, then four bits of its distance in letters from the anchor before (the first: from the text's first letter)."""
    mask = (1 << HASH_BITS) - 1
    distance = lambda a, x, i: F.least(x["place"] - F.coalesce(F.get(a, i - 1)["place"], F.lit(0)), F.lit(15))
    code = lambda a: F.transform(a, lambda x, i: F.shiftleft(x["hash"].bitwiseAND(F.lit(mask)), 4).bitwiseOR(distance(a, x, i).cast("long")))
    # as signed 32-bit numbers
    return F.transform(_let(anchors(text, k, s), code), lambda c: F.when(c >= 2**31, c - 2**32).otherwise(c).cast("int"))


def printed(codes: Column) -> Column:
    """A fingerprint as text: eight hex digits for each anchor."""
    digits = F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Distinct anchors that both fingerprints hold, by those that either holds; 1 for two empty ones."""
    common, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(common / either)


def with_next(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, text, codes, next_text, next_codes, rank; ranks): every document beside the next one by doc_id, the last beside the first.

    Documents are numbered; a slice holds slice_rows of them and, at its end, the first of the next slice, so texts are moved once (twice if the numbers exceed a broadcast).
    ranks: doc_id, hash, n, rank; rows equal in doc_id and text are one document.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    facts = keyed.groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    ranks = stage(numbered(facts, [F.col("doc_id").asc_nulls_last(), F.col("hash")], "rank").withColumn("rank", F.col("rank") - 1), "ranks")
    n = ranks.count()
    side = small_or_shuffled(ranks.withColumnsRenamed({"doc_id": "id", "hash": "text_hash"}), 40)
    rows = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))).select("doc_id", "text", "n", "rank")
    if ranks.where("n > 1").take(1):
        rows = rows.where("n = 1").unionByName(rows.where("n > 1").dropDuplicates(["rank"]))
    at = lambda cut, place: F.struct((cut / slice_rows).cast("long").alias("slice"), place.alias("place"))
    first_again = F.when(F.col("rank") == 0, at(F.lit(max(n - 1, 0)), F.lit(n).cast("long"))).when(F.col("rank") % slice_rows == 0, at(F.col("rank") - 1, F.col("rank")))
    dealt = rows.withColumn("at", F.explode(F.array_compact(F.array(at(F.col("rank"), F.col("rank")), first_again)))).select("doc_id", "text", "rank", "at.slice", "at.place")
    coded = dealt.repartition("slice").withColumn("codes", fingerprint(F.col("text")))
    w = Window.partitionBy("slice").orderBy("place")
    beside = coded.withColumns({"next_text": F.lead("text").over(w), "next_codes": F.lead("codes").over(w)})
    own = (F.col("place") == F.col("rank")) & F.col("next_text").isNotNull()
    return beside.where(own).select("doc_id", "text", "codes", "next_text", "next_codes", "rank"), ranks


def fingerprint_documents(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last quarter of the code points, rounded down, replaced by the first as many of the next document. Null texts are empty. Rows equal in doc_id and text are one document
    and get equal results; equal doc_ids with other texts follow by their texts' hashes; rows without doc_id come last. Other columns are not read; an empty table gives no rows.
    """
    beside, ranks = with_next(docs, slice_rows)
    n = F.length("text")
    edited = beside.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - F.floor(n / 4).cast("int")), F.left("next_text", F.floor(n / 4).cast("int"))))
    coded = edited.withColumn("edited_codes", fingerprint(F.col("edited")))
    out = coded.select("doc_id", "rank", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("codes")).alias("fingerprint"), printed(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
    if ranks.where("n > 1").take(1):
        made = stage(out, "fingerprints")
        repeated = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
        numbers = ranks.where("n > 1").select(F.col("doc_id").alias("id"), F.col("hash").alias("text_hash"), F.col("rank").alias("number"))
        again = repeated.join(numbers, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))).select("number")
        once = made.join(small_or_shuffled(numbers.select("number"), 8), F.col("rank") == F.col("number"), "left_anti")
        out = once.unionByName(again.join(made, F.col("rank") == F.col("number")).drop("number"))
    return out.drop("rank")
