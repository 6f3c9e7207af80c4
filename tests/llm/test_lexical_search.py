import math
import random
import re

import numpy as np
import pytest

from stockweave.llm import lexical_search
from stockweave.llm.lexical_search import Best, Shard, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, all_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        found = []
        for i, t in held:
            m = 75 + 25 * len(t) * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 12 * m)) for x in terms(text) if x in t)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    """Words by a steep law, so that some lists are long and most are short."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 500}"
    return [" ".join(rng.choice([word(), word().upper(), "É1-" + word()]) for _ in range(rng.choice([0, 3, 20, 80]))) for _ in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(1, 30)] + [f"w{k}" for k in range(200, 260)] + ["É1"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(30)]
    rows += [(30, None), (31, "--"), (32, "w1 w1 w1"), (33, "nowhere"), (34, "w2"), (34, "w3"), (35, "w9"), (35, "w9")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, doc_id int, score string")


@pytest.mark.parametrize("short,size,block", [(1 / 8, 1 << 20, 128), (0.0, 60, 4), (1.0, 1 << 20, 4), (0.02, 1 << 20, 4)])
def test_against_brute_force(spark, make_docs, odd_docs, asked, monkeypatch, short, size, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    texts = corpus(1, 300)
    for docs in (make_docs(texts + texts[:40] + [None, "", "-"]), odd_docs):
        got = lexical_search.rank_documents(docs, asked, item_bytes=size if size < 100 else 1 << 20, short_part=short)
        want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in asked.collect()])
        assert sorted(map(tuple, got.collect()), key=str) == want


def shard_of(rng, n, vocabulary):
    counts = rng.integers(0, 4, (n, vocabulary)) * (rng.random((n, vocabulary)) < np.linspace(0.9, 0.01, vocabulary))
    doc, term = np.nonzero(counts)
    sizes = np.bincount(doc, minlength=n)
    return Shard(np.arange(n), np.zeros(n, bool), counts.sum(1).astype(np.int64), sizes, term.astype(np.int64), counts[doc, term].astype(np.int64), n, int(counts.sum()), vocabulary)


def test_long_lists_are_skipped_and_thresholds_carry_over():
    rng = np.random.default_rng(4)
    shard = shard_of(rng, 20_000, 40)
    terms_, weights = np.array([0, 1, 30, 38, 39]), np.array([3, 5, 900, 2000, 2500])
    best = Best(20)
    scored = search(shard, terms_, weights, best)
    assert 20 <= scored < 2000
    whole = np.zeros(20_000, np.int64)
    for t, w in zip(terms_, weights, strict=True):
        places, gives = shard.list(t)
        whole[places] += w * gives
    order = np.lexsort((np.arange(20_000), -whole))[:20]
    assert (best.docs == order).all() and (best.scores == whole[order]).all()
    again = search(shard, np.array([0, 1]), np.array([3, 5]), best)  # can't reach what is there already
    assert again == 0


def test_shards_of_one_task_agree_with_one_shard(spark, make_docs, asked, monkeypatch):
    docs = make_docs(corpus(2, 200)).coalesce(1)
    want = sorted(map(tuple, lexical_search.rank_documents(docs, asked).collect()), key=str)
    monkeypatch.setattr(lexical_search, "SHARD_ENTRIES", 50)
    monkeypatch.setattr(lexical_search, "short_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16))
    assert sorted(map(tuple, lexical_search.rank_documents(docs, asked).collect()), key=str) == want


def test_nothing_to_rank(spark, make_docs, asked):
    docs = make_docs(["w1 w2"])
    assert lexical_search.rank_documents(docs.where("false"), asked).count() == 0
    assert lexical_search.rank_documents(docs, asked.where("false")).count() == 0
