"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a share of their union.

Sets are sorted arrays of 64-bit n-gram hashes; equal sets are one class. Four exact steps keep rows linear in the input.

1. Every class deals its n-grams to hash ranges. Each range tells each class how many of its n-grams some other class
   has too. A class with a partner at threshold t shares at least t of its own n-grams, so all others are done.
2. The classes left deal their rarest n-grams, as many as any partner must hit at least once, into tiles of one n-gram
   and one band of set sizes; a set joins the tiles of its own band and the next, as sizes of partners differ by 1/t at most.
   Tiles with the same least member go together from here on: near copies meet in one place, not once for every n-gram they share.
3. In a tile every member is first compared with the least member; linked members are one component.
4. Tiles with several components are split into pairs of blocks, each a group of one task. In a group, hashed bitmaps as long as
   its sets need bound every overlap from above: each bit that one has and the other lacks stands for an n-gram that the other lacks.
   Pairs that the bound lets through have their sorted arrays intersected at once, unless their components are already one;
   what leaves a group is a forest of its links, never a candidate pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_part, connected_components, mix, partitions, short_batches, small_or_shuffled, stage, text_chunks, unstage, word_hashes

#: Words of an n-gram; overlap in percent of the union.
WORDS, PERCENT = 5, 75
#: Bits of a bitmap for each n-gram of the largest set beside it; members and n-grams of a tile's block; n-grams that a task gathers before it deals them; classes of a hash range.
BITS, BLOCK, BLOCK_GRAMS, GATHER, RANGE_CLASSES = 16, 512, 2_000_000, 500_000, 8000

_ORDER = np.uint64(0x9E3779B97F4A7C15)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct n-gram hashes of its text."""
    with np.errstate(over="ignore"):
        for _, raw, offsets in text_chunks(texts):
            h, counts = word_hashes(raw, offsets)
            n = len(h)
            grams = np.zeros(n, np.uint64)
            for k in range(width):
                grams[: n - k] = grams[: n - k] * _ORDER + h[k:]
            grams = mix(grams)
            at = 0
            for c in counts:
                if c >= width:
                    yield np.unique(grams[at : at + c - width + 1])
                elif c:
                    whole = np.uint64(c)
                    for x in h[at : at + c]:
                        whole = whole * _ORDER + x
                    yield mix(np.array([whole]) ^ np.uint64(0x5851F42D4C957F2D))
                else:
                    yield np.zeros(0, np.uint64)
                at += c


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of the set's members under two mixings: the same only for equal sets, but for 128-bit chance."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        b = mix(s * _ORDER + np.uint64(len(s))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _with_keys(docs: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """docs -> columns (text may be one), n__, key_a__, key_b__: the size of each row's set and the key of its class; a set without members has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), *(_set_key(s) if len(s) else (None, None))) for s in _sets(batch.column(len(columns)), width)]
            cols = list(zip(*sets, strict=True)) if sets else [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in cols]], names=[*columns, "n__", "key_a__", "key_b__"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    return docs.select(*columns, F.col("text").alias("text__")).mapInArrow(run, f"{schema}, n__ long, key_a__ long, key_b__ long")


def _dealt(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """Each task's sets by hash range: part, keys (of the classes), lens (their n-grams there), grams (low 32 bits of each)."""

    def flush(keys: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        part = (((grams >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if ranges < 1 << 16 else part, kind="stable")
        low, owner, part = grams[order].astype(np.uint32), owner[order], part[order]
        heads_of = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])  # only the ranges that occur
        key = np.array(keys, dtype=np.int64)
        rows = []
        for lo, hi in zip(heads_of, np.r_[heads_of[1:], len(part)], strict=True):
            own = owner[lo:hi]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows.append((int(part[lo]), key[own[heads]].tobytes(), np.diff(np.r_[heads, hi - lo]).astype(np.uint32).tobytes(), low[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "lens", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, seen, n = [], [], set(), 0
        for batch in batches:
            for s in _sets(batch.column(0), width):
                if len(s) and (k := _set_key(s)[0]) not in seen:  # copies within a task's gathering go once
                    seen.add(k)
                    keys.append(k)
                    sets.append(s)
                    n += len(s)
                    if n >= GATHER:
                        yield from flush(keys, sets)
                        keys, sets, seen, n = [], [], set(), 0
        if sets:
            yield from flush(keys, sets)

    return docs.select("text").mapInArrow(run, "part int, keys binary, lens binary, grams binary")


def _arrays(rows: list[tuple], k: int, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[k], dtype) for r in rows])


def _shared_counts(dealt: DataFrame, n: int) -> DataFrame:
    """For each class how many of its n-grams some other class has: key, shared. A task holds one hash range at a time; counts are summed by tasks that own keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            keys, lens, grams = _arrays(rows, 0, np.int64), _arrays(rows, 1, np.uint32).astype(np.int64), _arrays(rows, 2, np.uint32)
            _, first = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), bool)
            once[first] = True  # a class sent by several tasks counts once
            owner = np.repeat(np.arange(len(keys), dtype=np.int32), lens)
            keep = once[owner]
            owner, grams = owner[keep], grams[keep]
            order = np.argsort(grams, kind="stable")
            g = grams[order]
            same = g[1:] == g[:-1]
            both = np.zeros(len(g), bool)
            both[1:] |= same
            both[:-1] |= same
            shared = np.bincount(owner[order[both]], minlength=len(keys))
            keys, shared = keys[shared > 0], shared[shared > 0]
            to = (keys.view(np.uint64) % np.uint64(n)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(n + 1))
            out = [(p, keys[o].tobytes(), shared[o].astype(np.uint32).tobytes()) for p in range(n) if len(o := order[edges[p] : edges[p + 1]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "shared"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, where = np.unique(np.concatenate([keys, *[np.frombuffer(r[0], np.int64) for r in held]]), return_inverse=True)
            return k, np.bincount(where, weights=np.concatenate([sums, *[np.frombuffer(r[1], np.uint32).astype(np.int64) for r in held]])).astype(np.int64)

        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                held.append(row)
                size += len(row[0])
                if size > 16 << 20:
                    keys, sums = merged()
                    held, size = [], 0
        keys, sums = merged()
        for lo in range(0, len(keys), 100_000):
            yield pa.record_batch([pa.array(keys[lo : lo + 100_000]), pa.array(sums[lo : lo + 100_000])], names=["key_a", "shared"])

    counted = dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(count, "part int, keys binary, shared binary")
    return counted.repartition(n, "part").mapInArrow(total, "key_a long, shared long")


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs (rep, text) -> rep, n, grams (sorted array of 64-bit hashes), halves (their low 32 bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), width))
            lens = np.array([len(s) for s in sets], dtype=np.int64)
            grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            offsets = pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (grams.view(np.int64), grams.astype(np.uint32).view(np.int32))]
            yield pa.record_batch([batch.column(0), pa.array(lens), *lists], names=["rep", "n", "grams", "halves"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, n long, grams array<long>, halves array<int>")


def _enough(common: int, x: int, y: int, percent: int) -> bool:
    return 100 * common >= percent * (x + y - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of reps those whose sorted arrays overlap enough."""
    grams = sets.select("rep", "grams")
    both = pairs.join(grams.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            xs, ys = _lists(batch.column(2)), _lists(batch.column(3))
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                keep[i] = _enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _tiles(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest n-grams of each set, as many as a partner must share one of: gram, band, rep. Each set is in the tiles of its band and the next."""
    each = sets.select("rep", "n", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    rare = Window.partitionBy("rep").orderBy("df", "gram")
    ranked = each.join(counts, "gram").withColumn("rank", F.row_number().over(rare)).withColumn("kept", F.count("*").over(Window.partitionBy("rep")))
    # those that no other set has stand first in the order, and hit nothing
    least = F.expr(f"(n * {percent} + 99) div 100")
    prefix = ranked.where(F.col("rank") + F.col("n") - F.col("kept") <= F.col("n") - least + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    return prefix.select("gram", F.explode(F.array(band, band + 1)).alias("band"), "rep")


def _forest(left: np.ndarray, rep: np.ndarray, comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Of one group: links that join its components as far as its links can, each of a left member with another component's right member.

    n: sizes; sets: distinct hashes of the members' n-grams. Where hashes are cut, fewer may be distinct, but each that the other set lacks still stands for an n-gram that it lacks.
    """
    right = np.flatnonzero(~left)
    width = 1 << max(0, (int(n.max()) * BITS - 1).bit_length() - 6)  # 64-bit words of a bitmap
    bits = np.zeros((len(sets), width), np.uint64)
    hashed, owner = np.concatenate(sets).astype(np.int64).astype(np.uint32), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    np.bitwise_or.at(bits, (owner, (hashed >> np.uint32(6)) & np.uint32(width - 1)), np.uint64(1) << (hashed & np.uint32(63)).astype(np.uint64))
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    out = []
    for a in np.flatnonzero(left):
        some = right[(comp[right] != comp[a]) & (percent * n[right] <= 100 * n[a]) & (percent * n[a] <= 100 * n[right])]
        both = np.bitwise_count(bits[some] & bits[a]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[a] - (ones[a] - both), n[some] - (ones[some] - both))
        some, most = some[at := (100 + percent) * most >= percent * (n[a] + n[some])], most[at]
        for b in some[np.argsort(-most, kind="stable")]:
            p, q = root(int(comp[a])), root(int(comp[b]))
            if p != q:
                x, y = sets[a], sets[b]
                same = len(np.intersect1d(x, y, assume_unique=True))
                if _enough(int(min(n[a] - (len(x) - same), n[b] - (len(y) - same))), int(n[a]), int(n[b]), percent):
                    up[max(p, q)] = min(p, q)
                    out.append((int(rep[a]), int(rep[b])))
    return out


def _links_in_tiles(rest: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Links (a, b) between components, out of tiles with several: rest (tile, rep, comp, main, members, others, longest).

    Members outside a tile's main component meet all its members, block by block. n-grams go as 64-bit hashes if whole, else as the
    low halves of them, which can only add links.
    """
    per = F.greatest(F.least(F.lit(BLOCK), F.expr(f"{BLOCK_GRAMS} div longest")), F.lit(1))
    blocks = lambda c: F.ceil(F.col(c) / per).cast("int")
    own = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), blocks(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    left = rest.where("comp <> main").select("tile", own("others", 1).alias("i"), F.explode(upto("members")).alias("j"), F.lit(True).alias("left"), "rep", "comp")
    right = rest.select("tile", F.explode(upto("others")).alias("i"), own("members", 2).alias("j"), F.lit(False).alias("left"), "rep", "comp")
    keys = ("tile", "i", "j")
    dealt = left.unionByName(right).join(sets.select("rep", "n", F.col("grams" if whole else "halves").alias("grams")), "rep").select(*keys, "left", "rep", "comp", "n", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []

        def close() -> None:
            if held:
                is_left, rep, comp, n = (np.array(c) for c in list(zip(*held, strict=True))[:4])
                if is_left.any() and not is_left.all():
                    out.extend(_forest(is_left, rep, comp, n, [np.unique(h[4]) for h in held], percent))

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            for k, g in enumerate(_lists(batch.column(7))):
                key = tuple(c[k] for c in cols[:3])
                if key != group:
                    close()
                    group, held = key, []
                held.append((*[c[k] for c in cols[3:]], g.copy()))
            yield _pairs(out)
            out.clear()
        close()
        yield _pairs(out)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sets (rep, n, grams, halves) -> staged (node, component) of the sets that link with some other."""
    tiles = stage(_tiles(sets, percent), "tiles")
    least = tiles.groupBy("gram", "band").agg(F.min("rep").alias("tile"), F.count("*").alias("members")).where("members > 1")
    few = stage(tiles.join(least, ["gram", "band"]).select("tile", "rep").distinct(), "tiles")
    unstage(tiles)
    first = few.where("rep <> tile").select(F.col("tile").alias("a"), F.col("rep").alias("b"))
    links = stage(_verified(first, sets, percent), "links")
    comp = stage(connected_components(links), "components")
    placed = few.join(comp, F.col("rep") == F.col("node"), "left").join(sets.select("rep", "n"), "rep").select("tile", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    parts = placed.groupBy("tile", "comp").agg(F.count("*").alias("size"), F.max("n").alias("longest"))
    mixed = parts.groupBy("tile").agg(F.sum("size").alias("members"), F.count("*").alias("comps"), F.max("longest").alias("longest"), F.max("size").alias("most"), F.max_by("comp", F.struct("size", "comp")).alias("main")).where("comps > 1")
    rest = stage(placed.drop("n").join(mixed.select("tile", "main", "members", (F.col("members") - F.col("most")).alias("others"), "longest"), "tile"), "mixed")
    more = stage(_links_in_tiles(rest, sets, percent, whole=False), "links")
    sure = stage(_verified(more, sets, percent), "links")
    if more.count() != sure.count():  # halves of hashes joined two sets that do not link: once more with whole ones
        unstage(sure)
        sure = stage(_links_in_tiles(rest, sets, percent, whole=True), "links")
    out = stage(connected_components(links.unionByName(sure)), "components")
    unstage(few, links, comp, rest, more, sure)
    return out


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs -> staged classes of equal sets: key_a, key_b, n, rep (smallest doc_id), rows, top (component of the class), and of each component: component_id (its smallest doc_id), best_a, best_b (the class of the row that stays)."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = _with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, ["doc_id"])
    grouped = rows.where("n__ > 0").groupBy(F.col("key_a__").alias("key_a"), F.col("key_b__").alias("key_b")).agg(F.min("doc_id").alias("rep"), F.max("n__").alias("n"), F.count("*").alias("rows"))
    classes = stage(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    ranges = max(n, classes.count() // RANGE_CLASSES)
    able = _shared_counts(_dealt(docs, width, ranges), n)
    # one row of each class that may link gives its set; of two 64-bit keys that clash both classes are looked at
    wanted = stage(classes.join(able, "key_a").where(F.col("shared") * 100 >= F.col("n") * percent).select("class", "rep", F.col("key_a").alias("a__"), F.col("key_b").alias("b__")), "wanted")
    ids = small_or_shuffled(wanted.select(F.col("rep").alias("rep__")).distinct(), 16)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _with_keys(read.join(ids, F.col("doc_id").eqNullSafe(F.col("rep__")), "left_semi"), width, ["doc_id", "text"])
    same = (F.col("key_a__") == F.col("a__")) & (F.col("key_b__") == F.col("b__")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    texts = found.join(small_or_shuffled(wanted, 40), same).groupBy("class").agg(F.min("text").alias("text")).select(F.col("class").alias("rep"), "text")
    sets = stage(_with_sets(texts, width), "grams")
    comp = set_links(sets, percent)
    placed = classes.join(small_or_shuffled(comp, 24), F.col("class") == F.col("node"), "left").select("key_a", "key_b", "rep", "rows", F.coalesce("component", "class").alias("top"))
    best = placed.groupBy("top").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key_a", "key_b")).alias("best"), F.sum("rows").alias("size"))
    best = best.select("top", "size", F.col("best.rep").alias("component_id"), F.col("best.key_a").alias("best_a"), F.col("best.key_b").alias("best_b"))
    out = stage(placed.join(best, "top"), "labelled")
    unstage(classes, wanted, sets, comp)
    return out


def jaccard_groups(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per input row: doc_id, n_shingles, component_id.

    A-Z are lowered; words are runs without white space; the set of a text is its distinct `width`-word n-grams, with fewer
    words the whole sequence, without words empty. Two rows link when 100 * intersection >= percent * union; empty sets link
    with nothing, and their component_id is their own doc_id. component_id is the smallest doc_id of the rows that a row reaches by links; rows without doc_id link like others,
    and where all of a component are without it is null. Links are between rows: two texts given under one doc_id are not one for that.
    Null texts are empty; repeated rows are rows of one class; other columns are not read. An empty table gives no rows. Sets are compared by 64-bit hashes of their n-grams.
    """
    short_batches(docs.sparkSession)
    labelled = _classes(docs, width, percent).where("size > 1").select(F.col("key_a").alias("a__"), F.col("key_b").alias("b__"), F.col("component_id").alias("component__"), F.lit(True).alias("known__"))
    rows = _with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, ["doc_id"])
    out = rows.join(small_or_shuffled(labelled, 40), (F.col("key_a__") == F.col("a__")) & (F.col("key_b__") == F.col("b__")), "left")
    return out.select("doc_id", F.col("n__").alias("n_shingles"), F.when(F.col("known__"), F.col("component__")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each component does, with all their columns.

    The row with the smallest doc_id stays (null after all others; of several texts under that doc_id one). Rows equal to it in doc_id and set stay
    with it: to drop repeats is exact dedup's work. Rows with empty sets link with nothing and stay.
    """
    short_batches(docs.sparkSession)
    labelled = _classes(docs, WORDS, PERCENT)
    stays = (F.col("key_a") == F.col("best_a")) & (F.col("key_b") == F.col("best_b"))
    fate = stage(labelled.where("size > 1").select(F.col("key_a").alias("a__"), F.col("key_b").alias("b__"), F.col("component_id").alias("keep__"), stays.alias("stays__")), "fates")
    rows = _with_keys(docs, WORDS, docs.columns).join(small_or_shuffled(fate, 40), (F.col("key_a__") == F.col("a__")) & (F.col("key_b__") == F.col("b__")), "left")
    return rows.where(F.col("stays__").isNull() | (F.col("stays__") & F.col("doc_id").cast("long").eqNullSafe(F.col("keep__")))).select(*docs.columns)
