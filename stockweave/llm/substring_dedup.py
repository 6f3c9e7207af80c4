"""Substring dedup by sliding spans of sentences.

A sentence is a stretch of words up to a mark that ends sentences, or a line's end; after fewer than SENTENCE_WORDS words a mark ends none: it is one
of an abbreviation, a number or a scrap, which goes with the sentence that follows. Every run of SENTENCES consecutive sentences is a
span. So that a passage is found too where it begins and ends within sentences, or has no marks, further spans run between words
that are the least by hash of some window of words, which a passage has in common wherever it stands.

Spans are hashed. Of the occurrences that a task has gathered all but the first of a hash are repeats whatever others hold, so only the first goes on to the owner of
a range of hashes: a span that very many documents share reaches its owner as a few entries. Owners decide among those. What repeats cover is merged for each document
and removed: sentences, or, of a sentence that a passage covers in part, the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_part, mix, partitions, short_batches, stage, sums_between, text_chunks, word_spans

#: Sentences of a span; words that a mark must follow to end one.
SENTENCES, SENTENCE_WORDS = 3, 6
#: Windows of so many words choose the words between which further spans run, each of at least so many words: a common passage of 51 words holds one.
WINDOW, CHOSEN_WORDS = 8, 28
#: Spans that a task gathers before it deals them; documents to a range of hashes and to an owner of documents.
GATHER, RANGE_ROWS = 1_000_000, 8000
#: Order of rows without doc_id: after all others.
LAST = 2**63 - 1

# Marks that end a sentence, and quotes and brackets that may follow one.
MARKS = ".!?…。！？।؟"
CLOSERS = "\"')]}»”’"


def _ends_with(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: str) -> np.ndarray:
    """For words raw[starts:ends] the bytes of the last character if it is one of marks, else 0."""
    size = np.zeros(len(ends), np.int64)
    for mark in marks:
        code = mark.encode()
        hit = ends - starts >= len(code)
        for k, byte in enumerate(reversed(code)):
            hit &= raw[np.maximum(ends - 1 - k, 0)] == byte
        size[hit] = len(code)
    return size


def _sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, byte where each word starts, first word of each sentence, first sentence of each row and the end)."""
    h, counts, starts, ends = word_spans(raw, offsets)
    n = len(h)
    if not n:
        return h, starts, np.zeros(0, np.int64), np.zeros(len(counts) + 1, np.int64)
    inner = ends - _ends_with(raw, starts, ends, CLOSERS)
    begins = np.zeros(n, bool)
    begins[1:] = (_ends_with(raw, starts, inner, MARKS) > 0)[:-1]
    lines = np.r_[0, np.cumsum(raw == 10)]
    begins[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    heads = np.cumsum(counts) - counts
    begins[heads[counts > 0]] = True
    at = np.flatnonzero(begins)
    whole = np.r_[True, np.diff(at) >= SENTENCE_WORDS]
    begins[at[~whole]] = False
    begins[heads[counts > 0]] = True
    at = np.flatnonzero(begins)
    return h, starts, at, np.searchsorted(at, np.r_[heads, n])


def _chosen(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words that are the least by hash in some window of WINDOW words of one row, the last of equal ones."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(h) - WINDOW + 1] == row[WINDOW - 1 :])
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(mix(h), WINDOW)[:, ::-1], axis=1)
    return np.unique(at + WINDOW - 1 - least[at])


def _spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's spans, in row order: row, first word in the row, number of words, hash. Equal spans of one place appear once."""
    h, _, at, rows = _sentences(raw, offsets)
    m = len(at)
    none = np.zeros(0, np.int64)
    if not m:
        return none, none, none, np.zeros(0, np.uint64)
    stop = np.r_[at[1:], len(h)]  # words before the end of each sentence
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    of_word = np.repeat(row, stop - at)
    run = np.flatnonzero(row[: m - SENTENCES + 1] == row[SENTENCES - 1 :]) if m >= SENTENCES else none
    c = _chosen(h, of_word)
    k = np.searchsorted(c, c + CHOSEN_WORDS)
    c, d = c[k < len(c)], c[k[k < len(c)]]
    whole = of_word[c] == of_word[d]
    a, b = np.concatenate((at[run], c[whole])), np.concatenate((stop[run + SENTENCES - 1], d[whole]))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b = a[once], b[once]
    r = of_word[a]
    return r, a - np.searchsorted(of_word, r), b - a, sums_between(h, a, b)


def _first_and_others(doc: np.ndarray, text: np.ndarray, first: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences of spans (indexes of the first one of each hash, of those that repeat it). The first goes by doc, text and place; the same place of an identical row given again is neither."""
    order = np.argsort(hashed, kind="stable")
    g = hashed[order]
    same = g[1:] == g[:-1]
    shared = np.zeros(len(g), bool)
    shared[1:] |= same
    shared[:-1] |= same
    o = order[shared]  # few: only these are put in the order of documents and places
    o = o[np.lexsort((first[o], text[o], doc[o], hashed[o]))]
    head = np.r_[True, hashed[o[1:]] != hashed[o[:-1]]] if len(o) else np.zeros(0, bool)
    lead = o[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(o) else o
    again = (doc[o] != doc[lead]) | (text[o] != text[lead]) | (first[o] != first[lead])
    return np.concatenate((order[~shared], o[head])), o[again]


def _merged(doc: np.ndarray, text: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of words (doc, text, first, words), in any order -> those that overlap or touch in one text as one, by doc and text."""
    if not len(doc):
        return doc, text, first, words
    order = np.lexsort((first, text, doc))
    doc, text, a = doc[order], text[order], first[order].astype(np.int64)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    shift = np.cumsum(new) << 32  # so that ends of one text lie under the starts of the next
    end = np.maximum.accumulate(a + words[order].astype(np.int64) + shift)
    at = np.flatnonzero(np.r_[True, (a + shift)[1:] > end[:-1]])
    last = np.r_[at[1:], len(a)] - 1
    return doc[at], text[at], a[at], end[last] - shift[last] - a[at]


_NAMES = ["part", "docs", "texts", "lens", "firsts", "words", "hashes"]
_DEALT = "part int, docs binary, texts binary, lens binary, firsts binary, words binary, hashes binary"


def _packed(part: np.ndarray, doc: np.ndarray, text: np.ndarray, first: np.ndarray, words: np.ndarray, hashed: np.ndarray | None) -> list[tuple]:
    """A row for each part: doc and text once for a run of places in it."""
    if not len(part):
        return []
    order = np.lexsort((text, doc, part))
    part, doc, text = part[order], doc[order], text[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = []
    for lo, hi in zip(edges, np.r_[edges[1:], len(part)], strict=True):
        d, t, o = doc[lo:hi], text[lo:hi], order[lo:hi]
        head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        lens = np.diff(np.r_[head, hi - lo]).astype(np.uint32)
        rows.append((int(part[lo]), d[head].tobytes(), t[head].tobytes(), lens.tobytes(), first[o].astype(np.uint32).tobytes(), words[o].astype(np.uint32).tobytes(), b"" if hashed is None else hashed[o].tobytes()))
    return rows


def _unpacked(rows: list[tuple]) -> list[np.ndarray]:
    doc, text, lens, first, words, hashed = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate((np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint64)))
    return [np.repeat(doc, lens), np.repeat(text, lens), first.astype(np.int64), words.astype(np.int64), hashed]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=_NAMES)


def _owner(doc: np.ndarray, owners: int) -> np.ndarray:
    """Parts under zero belong to owners of documents, all others are ranges of hashes."""
    with np.errstate(over="ignore"):
        return -1 - (mix(doc.view(np.uint64)) % np.uint64(owners)).astype(np.int32)


def _dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """Each task's spans, gathered: the first of each hash to its range of hashes, what all others cover to the owners of their documents."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, text, first, words, hashed = (np.concatenate(c) for c in zip(*held, strict=True))
        lead, again = _first_and_others(doc, text, first, hashed)
        part = (((hashed[lead] >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int32)
        rows = _packed(part, doc[lead], text[lead], first[lead], words[lead], hashed[lead])
        gone = _merged(doc[again], text[again], first[again], words[again])
        yield _batch(rows + _packed(_owner(gone[0], ranges), *gone, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, raw, offsets in text_chunks(batch.column(2)):
                row, first, words, hashed = _spans(raw, offsets)
                held.append((ids[at + row], texts[at + row], first, words, hashed))
                n += len(row)
                if n >= GATHER:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return docs.mapInArrow(run, _DEALT)


def _decided(owners: int):
    """One range of hashes at a time: what all but the first of each hash cover, to the owners of their documents; what is there already goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            if part < 0:
                yield _batch([(part, *r) for r in rows])
                continue
            doc, text, first, words, hashed = _unpacked(rows)
            _, again = _first_and_others(doc, text, first, hashed)
            if len(again):
                gone = _merged(doc[again], text[again], first[again], words[again])
                yield _batch(_packed(_owner(gone[0], owners), *gone, None))

    return run


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of one owner at a time: doc__, text__, cut__ (first word and end of each covered stretch, in turn)."""
    for _, rows in by_part(batches):
        doc, text, first, words = _merged(*_unpacked(rows)[:4])
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
        offsets = pa.array((2 * np.r_[head, len(doc)]).astype(np.int32))
        cut = pa.ListArray.from_arrays(offsets, pa.array(np.c_[first, first + words].reshape(-1).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(text[head]), cut], names=["doc__", "text__", "cut__"])


def _repeats(docs: DataFrame) -> DataFrame:
    """docs (doc, hash, text) -> staged doc__, text__, cut__: what repeats cover of each document."""
    n = partitions(docs.sparkSession)
    ranges = max(n, docs.count() // RANGE_ROWS)
    dealt = _dealt(docs, ranges).repartition(n, "part").sortWithinPartitions("part")
    decided = dealt.mapInArrow(_decided(ranges), _DEALT).repartition(n, "part").sortWithinPartitions("part")
    return stage(decided.mapInArrow(_cuts, "doc__ long, text__ long, cut__ array<int>"), "cuts")


def _cleaned(names: list[str]):
    place, cuts = names.index("text"), names.index("cut__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(cuts).to_pylist()
            texts, total, gone, gone_words = batch.column(place).to_pylist(), [], [], []
            for at, raw, offsets in text_chunks(batch.column(place)):
                h, starts, sentences, rows = _sentences(raw, offsets)
                heads = np.r_[sentences, len(h)]
                for k in range(len(offsets) - 1):
                    lo, hi = int(rows[k]), int(rows[k + 1])
                    total.append(hi - lo)
                    cut = marks[at + k] or []
                    if not cut:
                        gone.append(0)
                        gone_words.append(0)
                        continue
                    first, sizes = int(heads[lo]), np.diff(heads[lo : hi + 1])
                    out = np.zeros(int(heads[hi]) - first, bool)
                    for a, b in zip(cut[::2], cut[1::2], strict=True):
                        out[a:b] = True
                    full = np.add.reduceat(out.astype(np.int64), heads[lo:hi] - first) == sizes
                    gone.append(int(full.sum()))
                    gone_words.append(int(out.sum()))
                    edges = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                    keep, here = [], int(offsets[k])
                    for a, b in edges.reshape(-1, 2):
                        keep.append(raw[here : starts[first + a]].tobytes())
                        here = int(starts[first + b]) if b < len(out) else int(offsets[k + 1])
                    keep.append(raw[here : offsets[k + 1]].tobytes())
                    texts[at + k] = b"".join(keep).decode()
            cols = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns) if k != cuts]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.int64()) for x in (total, gone, gone_words)]], names=[n for n in names if n != "cut__"] + ["n_sentences__", "n_removed__", "words_removed__"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> its rows and columns with repeated sentences gone from text, and n_sentences__, n_removed__, words_removed__.

    Of equal spans the one with the smallest doc_id, then text hash and place, is the first; the words that others cover are removed, with
    the white space after them; n_removed__ counts the sentences of which no word is left. All else stays as it is. Repeats within a document count too. Identical rows (doc_id and text) are one
    occurrence and get equal results; rows without doc_id come last. Null texts stay null and have no sentences; an empty table gives no rows.
    Words are compared by 64-bit hashes with A-Z lowered.
    """
    short_batches(docs.sparkSession)
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    cuts = _repeats(docs.select(doc.alias("doc"), text.alias("hash"), F.coalesce("text", F.lit("")).alias("text")))
    bytes_ = cuts.agg(F.coalesce(F.sum(F.size("cut__") * 4 + 40), F.lit(0))).first()[0]
    side = F.broadcast(cuts) if bytes_ <= BROADCAST_BYTES else cuts
    keyed = docs.withColumns({"doc_key__": doc, "text_key__": text})
    marked = keyed.join(side, (F.col("doc_key__") == F.col("doc__")) & (F.col("text_key__") == F.col("text__")), "left").select(*docs.columns, "cut__")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return marked.mapInArrow(_cleaned(marked.columns), f"{schema}, n_sentences__ long, n_removed__ long, words_removed__ long")
