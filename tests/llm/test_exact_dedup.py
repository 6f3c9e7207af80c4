import hashlib
import random
import re

from pyspark.sql import functions as F

from stockweave.llm import exact_dedup as X
from stockweave.llm import mixing as M


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        known = [x for x in g if x is not None]
        out.append((i, min(known) if known else None, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = X.exact_groups(odd_docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    # of every text exactly one row is kept
    assert sum(r.kept for r in got) == len({norm(t) for _, t in rows})


def test_split_directory_gives_the_same(spark, make_docs):
    rng = random.Random(3)
    texts = [f"t {rng.randint(0, 300)}" for _ in range(800)]
    docs = make_docs(texts)
    groups = lambda capacity: sorted(map(tuple, X.exact_groups(docs, capacity).select("doc_id", "keep_id", "group_size").collect()))
    assert groups(X.BUCKET_CHAINS) == groups(3) == groups(1)
    chains = docs.select(F.xxhash64("text").alias("key")).distinct()
    for capacity in (1, 3, 40):
        index = X.build_index(docs.select("doc_id", F.xxhash64("text").alias("key")), capacity).collect()
        buckets = {}
        for r in index:
            buckets.setdefault((r.depth, r.bucket), []).append(r.key)
        assert len(index) == chains.count() and max(map(len, buckets.values())) <= capacity
        bits = X.directory(chains, capacity).first().bits
        for (depth, bucket), keys in buckets.items():
            assert len({(k % 2**64) >> (64 - depth) if depth else 0 for k in keys}) == 1 and bucket >> (bits - depth) == ((keys[0] % 2**64) >> (64 - depth) if depth else 0)


def test_chains_of_clashing_hashes(spark, make_docs, monkeypatch):
    """With a hash of very few values every chain holds many texts: their bytes tell them apart."""
    monkeypatch.setattr(X.F, "xxhash64", lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(7)).cast("long"))
    texts = [f"t {k % 50}" for k in range(200)]
    rows = list(enumerate(texts))
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in X.exact_groups(make_docs(texts), 2).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_rows_are_found_through_the_directory(spark, make_docs, monkeypatch):
    docs = make_docs([f"t {k % 50}" for k in range(200)])
    directory = X.directory
    monkeypatch.setattr(X, "directory", lambda chains, capacity: directory(chains, capacity).where("cell % 2 = 0"))
    assert 0 < X.exact_groups(docs, 3).count() < 200


def test_drop_copies(spark, odd_docs):
    kept = X.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in odd_docs.collect()})


def test_empty(spark, make_docs):
    assert X.exact_groups(make_docs([])).count() == 0 and M.mix_documents(make_docs([])).count() == 0


def test_mixing_against_rules(spark, make_docs):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 50) for _ in range(300)] + [None]
    sources = [("big" if rng.random() < 0.5 else rng.choice(["a", "b", None])) for _ in texts]
    out = M.mix_documents(make_docs(texts, sources=sources)).collect()
    src = dict(enumerate(sources))
    size = {r.doc_id: len((texts[r.doc_id] or "").split()) for r in out}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in out)
    total = sum(size.values())
    got = {}
    for r in out:
        got.setdefault(src[r.doc_id], [r.target, 0, r.source_size])[1] += r.taken
    assert abs(sum(t for t, _, _ in got.values()) - 1.5 * total) < 1e-6 * total
    for t, taken, n in got.values():
        assert abs(t - taken) <= 0.5 and t <= 2 * n
    # free sources share by weight
    weights = dict(zip(sorted((s for s in set(sources) if s is not None)) + [None], [5, 2, 1, 5], strict=True))
    levels = {round(t / weights[s], 6) for s, (t, _, n) in got.items() if t < 2 * n - 1e-9}
    assert len(levels) <= 1


def test_mixed_documents(spark, make_docs):
    docs = make_docs(["a b  c", "d e\tf g", "", None, "h"], sources=["x", "x", "x", "y", "y"])
    plan = {r.doc_id: r.taken for r in M.mix_documents(docs).collect()}
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in plan.items() if v}


def test_mixed_documents_with_odd_rows(spark, odd_docs):
    out = M.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    plan = {}
    for r in M.mix_documents(odd_docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == {k: v for k, v in plan.items() if v}


def test_rows_without_or_with_one_doc_id_are_spread(spark, make_docs):
    docs = make_docs(["w " * k for k in range(200)], ids=[None] * 100 + [7] * 100)
    out = M.mix_documents(docs).collect()
    assert len(out) == 200 and all(0 <= r.taken <= 2 * r.size for r in out)
    targets = {(r.source_size, r.target) for r in out}
    assert abs(sum(r.taken for r in out) - sum(t for _, t in targets)) <= 0.5 * len(targets)
