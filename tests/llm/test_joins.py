import random
import re

import numpy as np

from stockweave.llm import embedding_dedup as E
from stockweave.llm import jaccard as J
from stockweave.llm import substring_dedup as S
from stockweave.llm.common import connected_components, sums_between, word_hashes
from tests.llm.conftest import words


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    comp = components([i for i, _ in sets], links)
    return {i: (len(s), comp[i]) for i, s in sets}


def near_groups(rng):
    texts = [words(rng, 80) for _ in range(20)]
    passage = words(rng, 60)
    for _ in range(25):
        w = texts[0].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    texts += [passage + " " + words(rng, rng.randint(3, 30)) for _ in range(25)]
    texts += [texts[1], texts[1].upper(), "a b", "A  b", "a b c", "", None, " \n"]
    rng.shuffle(texts)
    return texts


def test_jaccard_against_brute_force(spark, make_docs):
    for seed in range(3):
        texts = near_groups(random.Random(seed))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(make_docs(texts)).collect()}
        assert got == brute_jaccard(list(enumerate(texts)))


def test_jaccard_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    texts = near_groups(random.Random(9))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(make_docs(texts)).collect()}
    assert got == brute_jaccard(list(enumerate(texts)))


def test_jaccard_odd_rows(spark, odd_docs, make_docs):
    rows = J.jaccard_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[8].component_id == 6
    assert [r.component_id for r in rows if r.doc_id is None] == [6]
    assert J.jaccard_groups(make_docs([])).count() == 0
    kept = J.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns


def test_of_each_component_one_stays(spark, make_docs):
    rng = random.Random(4)
    base, other, third = words(rng, 80), words(rng, 80), words(rng, 60)
    texts = [base, base + " tail", other, other + " end", third, third + " x", base + " more", None, ""]
    ids = [1, 5, 5, 9, None, None, None, 7, 8]
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one_of_each(make_docs(texts, ids=ids)).collect()), key=str)
    assert kept[:-1] == sorted([(1, base), (5, other), (7, None), (8, "")], key=str) and kept[-1][0] is None and kept[-1][1] in texts[4:6]
    got = sorted(((r.doc_id, r.component_id) for r in J.jaccard_groups(make_docs(texts, ids=ids)).collect()), key=str)
    assert got == sorted([(1, 1), (5, 1), (5, 5), (9, 5), (None, None), (None, None), (None, 1), (7, 7), (8, 8)], key=str)


def test_links_by_halves_of_hashes_and_by_whole_ones_agree(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 60)
    rows = []
    for k in range(40):
        s = base.copy()
        s[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(-(2**62), 2**62)
        s = sorted({int(x) for x in s})
        rows.append((k, len(s), s, np.array(s).astype(np.uint64).astype(np.uint32).view(np.int32).tolist()))
    sets = spark.createDataFrame(rows, "rep long, n long, grams array<long>, halves array<int>")
    rest = spark.createDataFrame([(0, k, k, 0, 40, 39, 60) for k in range(40)], "tile long, rep long, comp long, main long, members long, others long, longest long")
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    every = [(a, b) for a, _, x, _ in rows for b, _, y, _ in rows if a < b and link(set(x), set(y))]
    for whole in (False, True):
        got = [tuple(r) for r in J._links_in_tiles(rest, sets, 75, whole).collect()]
        assert len(got) <= 39 and components(range(40), got) == components(range(40), every)


def test_word_hashes_do_not_depend_on_the_chunk():
    a, b = b"Foo bar\tbaz", b"xx foo  BAR baz"
    ha, ca = word_hashes(np.frombuffer(a, np.uint8), np.array([0, len(a)]))
    both = a + b
    hb, cb = word_hashes(np.frombuffer(both, np.uint8), np.array([0, len(a), len(both)]))
    assert list(ca) == [3] and list(cb) == [3, 4] and (hb[:3] == ha).all() and (hb[4:] == ha).all()
    assert sums_between(hb, np.array([0]), np.array([3]))[0] == sums_between(hb, np.array([4]), np.array([7]))[0]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300, k) for k in range(301, 400)] + [(k, k + 1) for k in range(500, 560)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n, dim=16):
    g = np.random.default_rng(rng.randint(0, 999))
    out = []
    base = g.standard_normal((6, dim))
    for i in range(n):
        v = base[i % 6] + g.standard_normal(dim) * rng.choice([0.0, 0.05, 0.25, 3.0])
        out.append((i, [float(np.float32(x)) for x in v], i % 2))
    return out


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = vectors(random.Random(1), 240)
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [], 0), (n + 5, rows[0][1], None), (n + 6, [float("inf")] * 16, 0), (n + 7, [1.0, 0.0], 0), (n + 8, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    ok = {i: (np.array(v, dtype=np.float64), y) for i, v, y in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a, (x, y) in ok.items() for b, (u, w) in ok.items() if a < b and y == w and len(x) == len(u) and cos(x, u) >= 0.93]
    comp = components([r[0] for r in rows], links)
    deg = {r[0]: 0 for r in rows}
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, miss=1e-6).collect()}
    assert got == {i: (deg[i], comp[i], comp[i] == i) for i in deg}
    # a single table: what is found is right, and counted once
    some = {r.vec_id: r.n_links for r in E.near_duplicates(df, bits=2, tables=3).collect()}
    assert all(some[i] <= deg[i] for i in deg)


def test_embeddings_without_or_with_one_id(spark):
    v, near, far = [1.0, 0.0, 0.2], [1.0, 0.01, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (2, near, 0), (None, far, 0), (3, far, 1)]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), bits=4, tables=64).collect()
    got = sorted(map(tuple, out), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (2, 3, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)


def test_most_pairs_are_found(spark):
    rows = vectors(random.Random(3), 400, 32)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = int(((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum()) - len(rows)
    found = sum(r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert 0.99 * links <= found <= links


def test_embeddings_of_an_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- substring dedup ----


def sentences(text):
    """(words as matches, first word of each sentence)."""
    out, starts = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if not out or re.search(r"[.!?…。！？।؟][\"')\]}»”’]?$", out[-1][0]) or "\n" in text[out[-1].end() : m.start()]:
            starts.append(len(out))
        out.append(m)
    return out, [k for i, k in enumerate(starts) if i == 0 or k - starts[i - 1] >= S.SENTENCE_WORDS]


def spans(text):
    """(first word, end, words) of each run of sentences, and of each stretch between words that are least in a window."""
    ws, st = sentences(text)
    stop = st[1:] + [len(ws)]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in ws]
    found = {(st[k], stop[k + S.SENTENCES - 1]) for k in range(len(st) - S.SENTENCES + 1)}
    order = [int(S.mix(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0])[0]) for w in low]
    least = sorted({max(range(k, k + S.WINDOW), key=lambda i: (-order[i], i)) for k in range(len(ws) - S.WINDOW + 1)})
    for k in least:
        if far := [x for x in least if x >= k + S.CHOSEN_WORDS]:
            found.add((k, far[0]))
    return ws, st, [(a, e, tuple(low[a:e])) for a, e in found]


def brute_removed(rows):
    first, every = {}, []
    for i, t in sorted(rows):
        for a, e, k in spans(t or "")[2]:
            every.append((i, a, e, k))
            first[k] = min(first.get(k, (i, a)), (i, a))
    gone = {}
    for i, a, e, k in every:
        if first[k] != (i, a):
            gone.setdefault(i, set()).update(range(a, e))
    out = {}
    for i, t in rows:
        ws, st, _ = spans(t or "")
        cut, text = gone.get(i, set()), t
        for w in sorted(cut, reverse=True):
            text = text[: ws[w].start()] + text[ws[w + 1].start() if w + 1 < len(ws) else len(t) :]
        whole = sum(set(range(a, e)) <= cut for a, e in zip(st, [*st[1:], len(ws)], strict=False))
        out[i] = (len(st), whole, len(cut), text)
    return out


def prose(rng, n):
    out = []
    for k in range(n):
        w = words(rng, rng.randint(2, 14)).split()
        w[0] = w[0].capitalize() if rng.random() < 0.8 else w[0]
        out.append(" ".join(w) + rng.choice([".", ",", "!", '?"', "\n", "", "。", " …"]))
    return " ".join(out)


def test_substrings_against_brute_force(spark, make_docs):
    rng = random.Random(6)
    passages = [prose(rng, 12) for _ in range(3)] + ["Éa " + words(rng, 60) + "."]
    texts = []
    for _ in range(60):
        t = prose(rng, rng.randint(0, 15))
        if rng.random() < 0.6:
            t += rng.choice([" ", "\n"]) + rng.choice(passages) + " " + prose(rng, rng.randint(0, 5))
        texts.append(t)
    texts += [texts[0], None, "", "  ", passages[0] + "\n" + passages[0], "Yes. No. Maybe so.", "Aa bb. Yes. No. Maybe so. Cc dd."] + [f"{words(rng, 3)}. One two three four five six. Seven eight nine ten eleven twelve. A b. C d e f g h i. {words(rng, 9)}" for _ in range(2)]
    got = {r.doc_id: (r.n_sentences__, r.n_removed__, r.words_removed__, r.text) for r in S.remove_repeats(make_docs(texts)).collect()}
    assert got == brute_removed(list(enumerate(texts)))


def test_passages_go_and_clean_text_stays(spark, make_docs):
    rng = random.Random(8)
    passage = "The " + words(rng, 25) + ", " + words(rng, 20) + ". And " + words(rng, 12) + "."
    clean = [words(rng, 150).capitalize() for _ in range(20)]
    texts = clean + [f"Aa {words(rng, 40)} {passage} {words(rng, 30)}" for _ in range(5)]
    got = {r.doc_id: r for r in S.remove_repeats(make_docs(texts)).collect()}
    assert all(got[i].text == t for i, t in enumerate(clean))
    assert passage in got[20].text and all(passage not in got[i].text and got[i].words_removed__ >= 42 for i in range(21, 25))


def test_passages_without_marks_or_cut_within_sentences(spark, make_docs):
    rng = random.Random(12)
    plain = words(rng, 70)  # no marks and no capitals anywhere
    texts = [f"{words(rng, 90)} {plain} {words(rng, 80)}" for _ in range(3)]
    tail, whole, head = words(rng, 12) + ".", "Aa " + words(rng, 29) + ".", "Bb " + words(rng, 12)
    texts += [f"Cc {words(rng, 9)} {tail} {whole} {head} {words(rng, 8)}." for _ in range(3)]
    marks = words(rng, 60).replace(" ", "। ")  # marks that are not ASCII
    texts += [f"{words(rng, 60)} {marks} {words(rng, 60)}" for _ in range(2)]
    got = {r.doc_id: r for r in S.remove_repeats(make_docs(texts)).collect()}
    assert all(got[i].text == texts[i] and got[i].words_removed__ == 0 for i in (0, 3, 6))
    for i in (1, 2):
        assert 54 <= got[i].words_removed__ <= 70 and len(got[i].text.split()) == 240 - got[i].words_removed__
        assert got[i].text.split()[:90] == texts[i].split()[:90] and got[i].text.split()[-80:] == texts[i].split()[-80:]
    assert all(whole not in got[i].text and got[i].n_removed__ >= 1 and got[i].words_removed__ >= 37 for i in (4, 5))
    assert got[7].words_removed__ >= 52


def test_substrings_odd_rows(spark, odd_docs, make_docs):
    out = S.remove_repeats(odd_docs)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and out.count() == odd_docs.count()
    assert S.remove_repeats(make_docs([])).count() == 0
