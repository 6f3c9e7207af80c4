"""Tables staged in the shared folder, size-checked joins, connected components and word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and \t \n \v \f \r.
WHITE = "\\x20\\x09-\\x0D"
#: A side of a join is broadcast only when its counted rows need at most this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset a folder of its own if all runs on one machine, as in tests, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = _own_dir[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return at.rstrip("/")


_own_dir: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stockweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path

    def at_end() -> None:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone; the cluster clears its folder
            pass

    atexit.register(at_end)
    return out


def unstage(*dfs: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_staged_at", None):
            _remove(df.sparkSession, path)


def small_or_shuffled(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a staged df for broadcast only if its counted rows fit BROADCAST_BYTES; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Rows and bytes of a batch that Arrow hands to Python at a time: whole texts of a task's two batches must fit beside everything else in its worker.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS and, where Spark's own 64 MB stand, to ARROW_BYTES; a session that has smaller ones keeps them."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)
    if spark.conf.get(size) in ("67108864b", "67108864", "64m"):
        spark.conf.set(size, ARROW_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_key(col: Column) -> Column:
    """A key that is never null: 's' before each value, 'n' for null."""
    return F.coalesce(F.concat(F.lit("s"), col), F.lit("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): for each node with an edge the smallest node it reaches.

    Alternates large-star and small-star steps until the edges no longer change. Minima are
    combined before each shuffle and joined back, so a node with very many edges is never one group.
    An empty edge table gives no rows; null ends and loops are left out.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "edges")
    mark = _fingerprint(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stage(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _fingerprint(nxt)
        unstage(e)
        e, done, mark = nxt, now == mark, now
        if done:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
    return tuple(r)


# ---- words and their hashes, on whole Arrow columns ----

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that its powers have inverses modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, kept for the longest chunk so far."""

    n = 0

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INV)):
                    p = np.full(cls.n, np.uint64(base), dtype=np.uint64)
                    p[0] = 1
                    setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (part, ...) sorted by part -> each part with its rows, one part at a time."""
    part, held = None, []
    for batch in batches:
        for p, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(tuple(row))
    if held:
        yield part, held


def text_chunks(texts: pa.Array, limit: int = 1 << 19):
    """Yields (first row, byte array, row offsets) for runs of rows of about `limit` bytes; a null row is empty, a longer row stands alone."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        offset_type = np.int64
    else:
        offset_type = np.int32
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=offset_type)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_WORD_OF = {}


def _table_of(kind: str) -> np.ndarray:
    if kind not in _WORD_OF:
        b = np.arange(256)
        white = (b == 32) | ((b >= 9) & (b <= 13))
        letters = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
        _WORD_OF[kind] = ~white if kind == "white" else letters
    return _WORD_OF[kind]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, kind: str = "white") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lowered, and how many words each row has."""
    return word_spans(raw, offsets, kind)[:2]


def word_spans(raw: np.ndarray, offsets: np.ndarray, kind: str = "white") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, words of each row, and where each word starts and ends in raw.

    kind "white": words are runs without white space; "letters": runs of ASCII letters, digits and non-ASCII bytes.
    A word's hash is a polynomial of its bytes, taken from prefix sums, then mixed with its length.
    """
    n, rows = len(raw), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64), none, none
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _table_of(kind)[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])  # a word may not run over two rows
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    up, down = _Powers.upto(n)
    with np.errstate(over="ignore"):
        low = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(up[:n] * (low.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix(h ^ ((ends - starts).astype(np.uint64) * _MULT))
    counts = np.diff(np.searchsorted(starts, offsets))
    return h, counts, starts, ends


def sums_between(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words a..b (b exclusive), from prefix sums of the words' hashes."""
    up, down = _Powers.upto(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(up[: len(h)] * h, out=sums[1:])
        return mix((sums[b] - sums[a]) * down[a] ^ ((b - a).astype(np.uint64) * _MULT))
