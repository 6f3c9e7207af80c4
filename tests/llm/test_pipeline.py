import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as CP
from stockweave.llm import queries as Q
from stockweave.llm import toxicity as T
from stockweave.llm.sql import ORACLES
from tests.llm.conftest import words
from tests.llm.test_exact_dedup import norm
from tests.llm.test_joins import brute_jaccard


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    before = docs.count()
    for name, f in CP.STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= 2 * before
        docs = out
    assert CP.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def mixed(rows):
    """rows (doc_id, text, source) -> how often each (doc_id, text) is in the mix, by the rules of the mixing stage."""
    size = {i: len(t.split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    own = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    total, target = 1.5 * sum(own.values()), {}
    while len(target) < len(sources):  # the excess of those above their cap goes to the others by weight
        left, free = total - sum(target.values()), [s for s in sources if s not in target]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level >= 2 * own[s]]
        target |= {s: 2.0 * own[s] for s in over} if over else {s: weight[s] * level for s in free}
    out = Counter()
    for s in sources:
        budget, before = math.floor(target[s] + 0.5), 0
        if not own[s]:
            continue
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{r[0]}:{size[r[0]]}".encode()).hexdigest()):
            rest = min(max(budget % own[s] - before, 0), size[i])
            taken, before = budget // own[s] * size[i] + rest, before + size[i]
            while taken > 0:
                out[i, " ".join(t.split()[:taken])] += 1
                taken -= size[i]
    return out


def test_run_against_brute_force(spark, make_docs, tmp_path):
    rng = random.Random(21)
    texts = [words(rng, rng.randint(3, 60)) for _ in range(150)]
    texts += [rng.choice(texts[:60]).replace(" ", "  ", 1) for _ in range(40)]
    for k in range(60, 90):
        w = texts[k].split()
        w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    for k in range(100):
        w = words(rng, rng.randint(5, 40)).split()
        w.insert(rng.randrange(len(w)), rng.choice(["grubble", "zorkish", "vilk"]))
        texts.append(" ".join(w))
    texts += ["", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = make_docs([texts[k] for k in order], sources=[rng.choice(["a", "a", "a", "b", None]) for _ in order])
    labels = [(i, 1, int(any(b in (texts[k] or "") for b in ("grubble", "zorkish", "vilk")))) for i, k in enumerate(order)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = CP.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    marked = {r.doc_id: r.predicted for r in T.score_documents(docs, T.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert sum(marked[i] != y for i, _, y in labels) < 0.1 * len(labels)
    rows = sorted(((r.doc_id, r.text, r.source) for r in docs.collect() if not marked[r.doc_id]), key=lambda r: r[0])
    first = {}
    for i, t, _ in rows:
        first.setdefault(norm(t), i)
    rows = [r for r in rows if first[norm(r[1])] == r[0]]
    group = brute_jaccard([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if group[r[0]][1] == r[0]]
    assert 100 < len(rows) < 200
    want = mixed([(i, t or "", s) for i, t, s in rows])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    tokens, copies = Counter(), Counter()
    for (i, t), n in want.items():
        k = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        tokens[i, k] += n * k
        copies[i, k] += n
    have, begun, places = Counter(), Counter(), {}
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
        begun[r.doc_id, r.doc_tokens] += r.start == 0
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == tokens and begun == copies
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, make_docs):
    for name, f in CP.STAGES[:-1]:
        out = f(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns and out.count() > 0, name
        ids = {(r.doc_id, norm(r.text)) for r in out.collect()} if name != "mixing sources" else set()
        assert ids <= {(r.doc_id, norm(r.text)) for r in odd_docs.collect()}
        assert f(spark, make_docs([]), sf_dir).count() == 0, name
    assert CP.STAGES[-1][1](spark, odd_docs, sf_dir).count() > 0 and CP.STAGES[-1][1](spark, make_docs([]), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_as_in_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = Q.QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    rnd = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert rnd(map(tuple, df.select(*cols).collect())) == rnd(cur.fetchall())
