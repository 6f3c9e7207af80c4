"""Packing of tokenised documents into fixed-length sequences by vector bin packing.

Every piece of a document makes three demands on a sequence: tokens, one segment, and the tokens that
bear loss. Each task keeps a pool of pieces and fills one sequence at a time with the piece whose demands
have the greatest dot product with what is left of the three limits. When no piece fits whole, one is cut
to fill the rest. What is left at a task's end goes into sequences of power-of-two length, which need no
padding. Nothing is shuffled: a task packs its own input, so work and memory are even on any cluster.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Limits of a sequence, and the id that ends each document.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, END_ID = 2048, 256, 2048, 1
#: A task packs when its pool holds this many pieces, down to the second number; cached words of a task.
POOL, LOW_POOL, CACHE_WORDS = 2048, 256, 150_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class WordEncoder:
    """Ids of whole texts under a BPE tokenizer file whose words end with </w> and whose white space is dropped.

    The file's own library encodes any text. Words of plain letters, most of all text, go through a second BPE with the
    same vocabulary, in which a marker stands for the word's end: merges are looked up by rank, which gives the same ids,
    as each vocabulary entry is the product of exactly one merge. White space splits every word from the next in both, so
    words are encoded once and kept.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {}
        for piece, i in spec["model"]["vocab"].items():
            if i not in special:
                core = piece.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in core) + b"\x01" * (core != piece)] = i
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for k, i in ranks.items() if k[-1:] == b"\x01" and len(k) > 1]] = True
        self.fast = tiktoken.Encoding("words", pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
        self.words: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        plain, parts, odd = [], [], []
        for w in words:
            if m := self.plain.fullmatch(s := w.decode("utf-8", "replace")):
                plain.append((w, 2 if m[2] else 1))
                parts.append(m[1].lower() + "\x01" + (m[2] and m[2] + "\x01"))
            else:
                odd.append((w, s))
        if plain:
            ids = np.array(self.fast.encode_ordinary("".join(parts)), dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1  # one for each run of letters or mark
            at, lo = -1, 0
            raw = ids.tobytes()
            for w, n in plain:
                at += n
                hi = int(stops[at]) * 4
                self.words[w] = raw[lo:hi]
                lo = hi
        for (w, _), e in zip(odd, self.full.encode_batch_fast([s for _, s in odd], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            self.learn(set(words).difference(self.words))
            return b"".join(map(self.words.__getitem__, words))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Packer:
    """Open pool of pieces of one task; give() takes documents, rows() what has been placed."""

    def __init__(self, first_sequence: int, limits: tuple[int, int, int]):
        self.limits = np.array(limits, dtype=np.int64)
        self.next, self.out = first_sequence, []
        self.pool: list[tuple] = []  # (doc row, start, ids, loss tokens)

    def give(self, doc: tuple, ids: bytes, loss_from: int = 0) -> None:
        """doc: what its rows carry. Tokens from loss_from on bear loss. Pieces that fill a sequence alone are placed at once."""
        n, most, start = len(ids) // 4, int(min(self.limits[0], self.limits[2])), 0
        while n - start >= most:
            self._place(self.next, 0, doc, start, ids[4 * start : 4 * (start + most)], loss_from)
            self.next += 1
            start += most
        if start < n:
            self.pool.append((doc, start, ids[4 * start :], loss_from))

    def _place(self, sequence: int, offset: int, doc: tuple, start: int, ids: bytes, loss_from: int) -> None:
        n = len(ids) // 4
        self.out.append((doc[0], start, n, zlib.crc32(ids), doc[1], sequence, offset, max(0, start + n - max(start, loss_from))))

    def pack(self, until: int) -> None:
        """Fills sequences until fewer than `until` pieces, or no whole sequence, are left."""
        pool = self.pool
        if not pool:
            return
        need = np.array([(len(p[2]) // 4, 1, max(0, len(p[2]) // 4 - max(0, p[3] - p[1]))) for p in pool], dtype=np.int64)
        scale = need / self.limits
        live = np.ones(len(pool), bool)
        total, alive = int(need[:, 0].sum()), len(pool)
        while alive >= max(until, 1) and total >= self.limits[0]:
            left, offset = self.limits.copy(), 0
            while left.min() > 0 and alive:
                fits = live & (need <= left).all(axis=1)
                dots = np.where(fits, scale @ (left / self.limits), -1.0)
                k = int(dots.argmax())
                if not fits[k]:
                    k = int(np.argmax(np.where(live, need[:, 0], -1)))  # cut the longest to fill the rest
                doc, start, ids, loss_from = pool[k]
                n = int(min(need[k, 0], left[0]))
                # a cut piece may not pass the limit of tokens that bear loss
                n = int(min(n, max(0, loss_from - start) + left[2]))
                if n <= 0:
                    break
                self._place(self.next, offset, doc, start, ids[: 4 * n], loss_from)
                used = np.array((n, 1, max(0, start + n - max(start, loss_from))))
                left, offset, total = left - used, offset + n, total - n
                if n == need[k, 0]:
                    live[k] = False
                    alive -= 1
                else:
                    pool[k] = (doc, start + n, ids[4 * n :], loss_from)
                    m = need[k, 0] - n
                    need[k] = (m, 1, max(0, m - max(0, loss_from - start - n)))
                    scale[k] = need[k] / self.limits
            self.next += 1
        self.pool = [p for p, keep in zip(pool, live, strict=True) if keep]

    def finish(self) -> None:
        """The rest goes into sequences whose lengths are powers of two, as long as can be."""
        self.pack(1)
        rest = sorted(self.pool, key=lambda p: -len(p[2]))
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            room, offset, segments, loss = 1 << (min(left, int(self.limits[0])).bit_length() - 1), 0, 0, 0
            while room:
                doc, start, ids, loss_from = rest[0]
                # a piece may not pass the limit of tokens that bear loss
                n = int(min(room, len(ids) // 4, max(0, loss_from - start) + self.limits[2] - loss))
                if segments == self.limits[1] or n <= 0:  # too many short pieces or loss-bearing tokens: this sequence ends and is padded
                    break
                self._place(self.next, offset, doc, start, ids[: 4 * n], loss_from)
                room, offset, segments, left = room - n, offset + n, segments + 1, left - n
                loss += max(0, start + n - max(start, loss_from))
                rest[:1] = [(doc, start + n, ids[4 * n :], loss_from)] if 4 * n < len(ids) else []
            self.next += 1
        self.pool = []

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) if self.out else [[]] * 8
        self.out = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, end_id: int = END_ID, loss_from: str | None = None) -> DataFrame:
    """docs (doc_id long, text, ...) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids and end_id; a null text is empty and has end_id alone. loss_from may name a column with the number
    of leading tokens that bear no loss (null: 0); without it all tokens do. Each id lies in exactly one piece. A sequence takes at most
    max_tokens tokens, max_segments pieces and max_loss loss-bearing tokens. Repeated rows are packed as often as they come; rows
    keep their doc_id, null too; other columns are not read. An empty table gives no rows. The task's partition number
    leads its sequence ids, so a rerun of a lost task gives the same rows.
    """
    short_batches(docs.sparkSession)
    fields = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")).alias("loss_from")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, (max_tokens, max_segments, max_loss))
        for batch in batches:
            texts = pc.cast(pc.fill_null(batch.column(1), ""), pa.binary())
            for i, text, loss in zip(batch.column(0).to_pylist(), texts.to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                packer.give((i, len(ids) // 4), ids, loss)
                if len(packer.pool) >= POOL:
                    packer.pack(LOW_POOL)
                if len(packer.out) >= 20_000:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return docs.select(*fields).mapInArrow(run, SCHEMA)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
