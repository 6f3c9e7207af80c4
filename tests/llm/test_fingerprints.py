import hashlib
import random
import re

import xxhash

from stockweave.llm import syncmers
from stockweave.llm.syncmers import K, S, WORD_CHARS

from .conftest import words

UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff"
LETTER = re.compile(rf"[^\x20\x09-\x0D{UNSPACED}]{{1,{WORD_CHARS}}}|[{UNSPACED}]")


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def xx(*values):
    """Spark's xxhash64 of strings and longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return signed(seed)


def plain_codes(text):
    letters = [xx(x) for x in LETTER.findall(text or "")]
    found = []
    if len(letters) >= K:
        inner = [xx(*letters[i : i + S]) for i in range(len(letters) - S + 1)]
        for i in range(len(letters) - K + 1):
            window = inner[i : i + K - S + 1]
            if min(window) in (window[0], window[-1]):
                found.append((i, xx(*[inner[i + j] for j in (0, 2, 3)])))
    elif letters:
        h = 0
        for x in letters:
            h = xx(h, x)
        found = [(0, h)]
    return [((h & (2**28 - 1)) << 4) | min(p - (found[n - 1][0] if n else 0), 15) for n, (p, h) in enumerate(found)]


def plain_rows(docs):
    """docs: (doc_id, text), rows equal in both once."""
    docs = sorted(set((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, r[0] or 0, xx(r[1])))
    out = {}
    for n, (i, t) in enumerate(docs):
        other = docs[(n + 1) % len(docs)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + other[:m]
        codes = [plain_codes(x) for x in (t, edited, other)]
        near = [len(set(codes[0]) & set(c)) / len(set(codes[0]) | set(c)) if codes[0] or c else 1.0 for c in codes[1:]]
        out[i, t] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *["".join(f"{x:08x}" for x in c) for c in codes[:2]], *near)
    return out


def test_fingerprints_against_brute_force(spark, make_docs, odd_docs):
    rng = random.Random(3)
    texts = [words(rng, rng.choice([0, 1, 3, 5, 6, 30, 300, 3000])) for _ in range(90)] + ["一二三四五六七 x \U00020001\U00020002 กขฃ", "a" * 5000, "x y " * 400, None, "", " \n"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    for docs in (make_docs(texts, ids), odd_docs):
        given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = plain_rows(given)
        for rows in (64, 3):
            got = syncmers.fingerprint_documents(docs, rows).collect()
            assert sorted(map(tuple, got), key=str) == sorted((want[i, t or ""] for i, t in given), key=str)


def test_a_shared_passage_shares_its_anchors_wherever_it_stands(spark, make_docs):
    rng = random.Random(4)
    passage = words(rng, 200)
    docs = make_docs([words(rng, 37) + " " + passage + " " + words(rng, 50), passage, words(rng, 200)])
    a, b, c = [r.codes for r in docs.orderBy("doc_id").select(syncmers.fingerprint(docs.text).alias("codes")).collect()]
    assert len(set(a) & set(b)) >= len(b) - 2 and not set(c) & set(b)
    gaps = [x & 15 for x in b]
    assert max(gaps) <= K - S and 0.35 * 196 < len(b) < 0.65 * 196


def test_edits_are_near_and_other_documents_are_not(spark, make_docs):
    rng = random.Random(5)
    rows = syncmers.fingerprint_documents(make_docs([words(rng, 40 + k) for k in range(60)])).collect()
    assert min(r.near_edited for r in rows) > 0.3 and max(r.near_next for r in rows) < 0.05
    assert sum(r.near_edited for r in rows) / len(rows) > 0.5


def test_rows_given_twice_and_one_document(spark, make_docs):
    docs = make_docs(["one two three four five six seven eight nine ten", "b " * 20, "b " * 20], [1, 2, 2])
    rows = syncmers.fingerprint_documents(docs).collect()
    assert [r.doc_id for r in sorted(rows)] == [1, 2, 2] and len(set(r for r in rows)) == 2
    (only,) = syncmers.fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"one two three four five six seven eione two thre").hexdigest()


def test_no_documents(spark, make_docs):
    out = syncmers.fingerprint_documents(make_docs(["x"]).where("false"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
