"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, distributed components.

Equal vectors are one class. Each class gets one code of hyperplane signs in every table; classes of one label that
share a code in a table meet in a bucket. Buckets of one class are dropped at once; large buckets are
split into blocks and every pair of blocks is a task row group of bounded size, so no bucket is gathered whole and none is cut.
Two rounds keep what is moved small. In the first, groups hold signs alone: a member stays if this is the first table in which it meets some other whose signs
over all tables differ no more than those of a pair at the threshold can. Only for those that stay vectors are fetched, and cosines are exact, in double precision.
A pair counts in the first table in which it meets, so link counts need no list of pairs, and only a spanning forest of each group's links goes on to the connected components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, mix, small_or_shuffled, stage

#: Least cosine of a link; chance at most that a pair just at it meets in no table; members of a bucket's block; seed of the planes.
COSINE, MISS, BLOCK, SEED = 0.93, 0.0005, 512, 20240
#: Standard deviations over the mean that the differing signs of a pair at the threshold may reach: beyond them lies a chance of 1e-9.
SIGNS_Z = 6.0


def plan_tables(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors: codes long enough that a bucket holds few unrelated vectors, tables enough that a pair at the threshold is missed with chance `miss`."""
    bits = min(40, max(10, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def most_differing(signs: int, cosine: float) -> int:
    """The most of so many signs in which a pair at the threshold is let differ."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(signs * p + SIGNS_Z * math.sqrt(signs * p * (1 - p)) + 1)


def _planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, count))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """rep, n, vec, codes, signs. codes: a 64-bit hash of the sign bits of each table, with label and dimension, so that only equals meet; signs: the bits themselves, a number for each table."""
    width = _width(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
        for batch in batches:
            labels, vectors = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(3))
            codes, own_signs = np.zeros((len(vectors), tables), np.uint64), np.zeros((len(vectors), tables), width)
            for dim in {len(v) for v in vectors}:
                at = np.array([k for k, v in enumerate(vectors) if len(v) == dim])
                x = np.array([vectors[k] for k in at])
                signs = (x @ _planes(dim, bits * tables) > 0).reshape(len(at), tables, bits)
                numbers = (signs * weights).sum(axis=2, dtype=np.uint64)
                own_signs[at] = numbers.astype(width)
                with np.errstate(over="ignore"):
                    own = mix(labels[at].view(np.uint64) * np.uint64(2654435761) + np.uint64(dim))
                    codes[at] = mix(numbers ^ own[:, None] ^ mix(np.arange(tables, dtype=np.uint64))[None, :])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.reshape(-1).view(np.int64)))
            raw = pa.array([row.tobytes() for row in own_signs], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), lists, raw], names=["rep", "n", "vec", "codes", "signs"])

    return classes.select("rep", "n", "label", "vec").mapInArrow(run, "rep long, n long, vec array<float>, codes array<long>, signs binary")


def _width(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def _meets(group: dict[str, np.ndarray], signs: np.ndarray, most: int) -> np.ndarray:
    """Which members of a group have a candidate there that they met in no table before: of another block where blocks differ, and with at most `most` differing signs."""
    table, found = int(group["table"][0]), np.zeros(len(signs), bool)
    for a in range(len(signs)):
        ok = np.bitwise_count(signs ^ signs[a]).sum(axis=1, dtype=np.int64) <= most
        ok[a] = False
        if group["i"][0] != group["j"][0]:
            ok &= group["block"] != group["block"][a]
        some = np.flatnonzero(ok & ~found) if found[a] else np.flatnonzero(ok)
        if len(some):
            first = ~(signs[some, :table] == signs[a, :table]).any(axis=1)
            found[some[first]] = True
            found[a] |= first.any()
    return found


def _linked_in(group: dict[str, np.ndarray], x: np.ndarray, signs: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Of the vectors x of one group those with links: rep, links (pairs that met in no table before this one), rep of the least member that they reach."""
    x = x.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if group["i"][0] != group["j"][0]:
        linked &= group["block"][:, None] != group["block"][None, :]
    a, b = np.nonzero(linked)
    if not len(a):
        return [np.zeros(0, np.int64)] * 3
    new = ~(signs[a, : group["table"][0]] == signs[b, : group["table"][0]]).any(axis=1)
    links = np.bincount(a[new], weights=group["n"][b[new]], minlength=len(x)).astype(np.int64)
    root = np.arange(len(x))
    while True:  # least row among the linked, until nothing changes
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    at = np.unique(a)
    return [group["rep"][at], links[at], group["rep"][root[at]]]


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """Rows sorted by code, i, j -> the columns of one group at a time; lists and binaries as Python lists of arrays. A group that goes on in the next batch is held over."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
        change = np.zeros(batch.num_rows - 1, bool)
        for c in ("code", "i", "j"):
            change |= now[c][1:] != now[c][:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1]
        for lo, hi in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            part = {c: v[lo:hi] for c, v in now.items()}
            if held and any(held[-1][c][0] != part[c][0] for c in ("code", "i", "j")):
                yield _one(held)
                held = []
            held.append(part)
    if held:
        yield _one(held)


def _one(parts: list[dict]) -> dict:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _signs(column: np.ndarray, width: type, tables: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), width).reshape(-1, tables)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """vectors (vec_id long, embedding array<float>, label int, ...) -> one row per input row: vec_id, n_links, component_id, kept.

    Rows of equal, non-null label and equal length are compared. A vector that is null, empty, zero or holds a null, NaN or
    infinite component, or has no label, links with nothing. n_links counts the other rows linked directly, equal vectors
    included; component_id is the smallest vec_id reachable by links; kept marks the row with that id. Repeated rows are
    vectors of one class, all kept if they share the smallest id. Null vec_ids are no one's component unless their class has no other.
    Other columns are not read; an empty table gives no rows. Pairs at the threshold are missed with chance `miss` at most, those above it more rarely.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"), F.col("label").cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    classes = stage(v.where(good).groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("rep", F.coalesce("rep", -F.monotonically_increasing_id() - 2**62)), "classes")
    if bits is None or tables is None:
        bits, tables = plan_tables(classes.count(), cosine, miss)
    coded = stage(_codes(classes, bits, tables), "codes")
    width, most = _width(bits), most_differing(bits * tables, cosine)
    slots = coded.select("rep", F.posexplode("codes").alias("table", "code"))  # a code names its table too
    shared = stage(slots.groupBy("code").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).drop("members"), "shared")
    met = slots.join(small_or_shuffled(shared, 16), "code").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    # a member of block k takes part in the block pairs (i, k) and (k, j)
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "table", "rep", "block")
    groups = lambda rows: rows.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j", "rep")
    names = ["code", "i", "j", "table", "rep", "block"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # columns and signs of the last group so far, which may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if held is None:
                    break
                now, signs = held, last
            else:
                now, signs = [batch.column(k).to_numpy() for k in range(len(names))], _signs(batch.column(len(names)).to_numpy(zero_copy_only=False), width, tables)
                if held is not None:
                    now, signs = [np.concatenate(c) for c in zip(held, now, strict=True)], np.concatenate((last, signs))
            if not len(signs):
                continue
            starts = np.flatnonzero(np.r_[True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])])
            ends = np.r_[starts[1:], len(signs)]
            if batch is not None:
                held, last = [c[starts[-1] :].copy() for c in now], signs[starts[-1] :].copy()
                starts, ends = starts[:-1], ends[:-1]
            keep = np.zeros(len(signs), bool)
            # most groups are two members: all of them at once
            two = starts[ends - starts == 2]
            differ = signs[two] ^ signs[two + 1]
            before = np.arange(tables)[None, :] < now[3][two][:, None]
            meets = (np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most) & ~((differ == 0) & before).any(axis=1) & ((now[1][two] == now[2][two]) | (now[5][two] != now[5][two + 1]))
            keep[two[meets]] = keep[two[meets] + 1] = True
            for lo, hi in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                keep[lo:hi] = _meets({c: v[lo:hi] for c, v in zip(names, now, strict=True)}, signs[lo:hi], most)
            if keep.any():
                yield pa.record_batch([pa.array(c[keep]) for c in now], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, [*names, "n", "vec", "signs"]):
            if len(group["rep"]) > 1:
                cols = _linked_in(group, np.stack(group["vec"]), _signs(group["signs"], width, tables), cosine)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "root"])

    stay = groups(pairs.join(coded.select("rep", "signs"), "rep").select(*names, "signs")).mapInArrow(meet, "code long, i int, j int, table int, rep long, block int")
    full = stage(stay, "meetings").join(coded.select("rep", "n", "vec", "signs"), "rep").select(*names, "n", "vec", "signs")
    found = stage(groups(full).mapInArrow(compare, "rep long, links long, root long"), "found")
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labelled = classes.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select(F.col("label").alias("l__"), F.col("vec").alias("v__"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c__"))
    good_rows = v.where(good).join(labelled, (F.col("label") == F.col("l__")) & (F.col("vec") == F.col("v__")))
    comp_id = F.when(F.col("c__") > -(2**61), F.col("c__"))
    rest = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good_rows.select("vec_id", "n_links", comp_id.alias("component_id")).unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
