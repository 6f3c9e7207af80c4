import random

from pyspark.sql import functions as F

from stockweave.functions import scalars as S
from stockweave.operators import consolidate as K
from stockweave.operators import imports as I
from stockweave.operators import matching as M
from stockweave.operators import reconcile as R
from tests.test_catalog import products

ROW = "position bigint, product_name string, quantity int, contributing_source_record_ids array<string>, authoritative_source_product_names map<string,string>, preview_item_ids array<string>, source_identity_review_required boolean"


def rows(spark, *data):
    return spark.createDataFrame([(i, n, q, ids, names, [f"i{i}"], False) for i, (n, q, ids, names) in enumerate(data)], ROW)


def result(df):
    return [(r.product_name, r.quantity, r.error) for r in K.consolidate_import(df).orderBy("first_position").collect()]


def test_two_spellings_add_up(spark):
    assert result(rows(spark, ("Pil Yuvarlak", 10, None, None), ("pil_yuvarlak", 15, None, None))) == [("Pil Yuvarlak", 25, None)]


def test_repeat_counts_once(spark):
    assert result(rows(spark, ("a", 10, ["x:2"], None), ("a", 10, ["x:2"], None))) == [("a", 10, None)]


def test_other_rows_add_up_and_repeats_do_not(spark):
    assert result(rows(spark, ("a", 10, ["x:2"], None), ("a", 5, ["x:3"], None), ("a", 10, ["x:2"], None))) == [("a", 15, None)]


def test_authoritative_names_stay_apart(spark):
    r = rows(spark, *[("Beyaz", q, [f"x:{i}"], {f"x:{i}": f"Tuval_{i}"}) for i, q in ((1, 400), (2, 450), (3, 500))])
    assert result(r) == [("Tuval_1", 400, None), ("Tuval_2", 450, None), ("Tuval_3", 500, None)]
    assert K.validate_provenance(r, K.consolidate_import(r)).count() == 0


def test_partial_overlap_is_an_error(spark):
    assert result(rows(spark, ("a", 1, ["x:1"], None), ("a", 2, ["x:1", "x:2"], None)))[0][2] is not None
    assert result(rows(spark, ("a", 3, ["x:1", "x:2"], None), ("a", 1, ["x:1"], None))) == [("a", 3, None)]


FULL = ROW + ", resolved_source_record_ids array<string>, resolved_source_record_id string"


def walk(data):
    """The rules row by row: (position, name, quantity, ids, names, resolved, one) -> (name, quantity, ids, resolved, error) by first position."""
    groups, through = {}, []
    for i, name, q, ids, names, several, one in data:
        resolved = list(dict.fromkeys([x for x in [*(several or []), one] if x is not None]))
        own = list(dict.fromkeys(x for x in [*(ids or []), *resolved] if x and x.strip()))
        trusted = {k: v.strip() for k, v in (names or {}).items() if k.strip() and v and v.strip()}
        bad = "a trusted name is of no source row of this row" if set(trusted) - set(own) else "two trusted names in one row" if len({v.lower() for v in trusted.values()}) > 1 else None
        if trusted and not bad:
            name = next(iter(trusted.values()))
        if bad or q is None or not name:
            through.append((i, name, q, own, resolved, bad))
            continue
        g = groups.setdefault(name.lower(), [i, name, 0, [], [], {}, None])
        if not (own and g[3] and set(own) <= set(g[3])):
            if own and g[3] and set(own) & set(g[3]):
                g[6] = g[6] or "a source row contributes twice"
            g[2] += q
        if any(g[5].get(k, v) != v for k, v in trusted.items()):
            g[6] = g[6] or "a source row has two names"
        for k, v in trusted.items():
            g[5].setdefault(k, v)
        g[3] += [x for x in own if x not in g[3]]
        g[4] += [x for x in resolved if x not in g[4]]
    return sorted([(g[0], g[1], g[2], g[3], g[4], g[6]) for g in groups.values()] + through)


def test_consolidation_against_a_walk(spark):
    rng = random.Random(4)
    for _ in range(3):
        data = []
        for i in range(150):
            pick = lambda k: [f"x:{rng.randint(1, 30)}" for _ in range(k)]
            ids = pick(rng.choice([0, 1, 1, 1, 2])) + rng.choice([[], [], [" "]])
            resolved = rng.choice([None, None, None, pick(1)])
            name = rng.choice(["a", "b", "c", "d", "e"] + [f"n{i}"] * 5)
            names = {ids[0]: rng.choice([name, name, " ", name + "2"])} if ids and ids[0].strip() and rng.random() < 0.3 else rng.choice([None, None, {"y:1": "z"}, {}]) if rng.random() < 0.1 else None
            if ids and len(set(ids)) > 1 and all(x.strip() for x in ids) and rng.random() < 0.2:
                names = dict(zip(ids, ["p", "q"]))
            data.append((i, name, rng.choice([None, 1, 2, 3]) if rng.random() < 0.2 else rng.randint(1, 9), ids or None, names, resolved, rng.choice([None, None, None, f"x:{rng.randint(1, 30)}"])))
        df = spark.createDataFrame([(i, n, q, ids, names, [f"i{i}"], False, several, one) for i, n, q, ids, names, several, one in data], FULL)
        for part in (df, df.repartition(5)):
            got = [(r.first_position, r.product_name, r.quantity, r.source_ids, r.resolved_ids, r.error) for r in K.consolidate_import(part).collect()]
            assert sorted(got) == walk(data)
            groups, members = K.consolidate_groups(part)
            assert sorted((r.first_position, r.product_name, r.quantity, r.sources, r.error) for r in groups.collect()) == [(a, b, c, len(d), f) for a, b, c, d, _, f in walk(data)]
            for kind, at in (("source", 3), ("resolved", 4)):
                held = sorted((r.first_position, r.position, r.place, r.id) for r in members.where(F.col("kind") == kind).collect())
                assert [(r[0], r[3]) for r in held] == [(r[0], x) for r in walk(data) for x in r[at]]


def test_a_group_of_most_rows_is_no_list(spark):
    n = 6000
    df = spark.range(n).select(F.col("id").alias("position"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("product_name"), F.lit(1).alias("quantity"), F.array(F.concat(F.lit("x:"), (F.col("id") % 4000).cast("string"))).alias("contributing_source_record_ids"), F.lit(None).cast("map<string,string>").alias("authoritative_source_product_names"), F.lit(None).cast("array<string>").alias("preview_item_ids"), F.lit(False).alias("source_identity_review_required"))
    groups, members = K.consolidate_groups(df)
    hot = groups.where("key = 'hot'").first()
    ids = {k % 4000 for k in range(n) if k % 3}
    assert (hot.quantity, hot.sources, hot.members) == (len(ids), len(ids), 4000)
    assert members.where("first_position = 1 AND kind = 'source'").count() == len(ids)
    for frame in (groups, members):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Python" not in plan


def test_rows_that_resolve_one_gap_count_once(spark):
    df = spark.createDataFrame([(0, "a", 5, None, None, None, False, ["g1"], None), (1, "a", 5, None, None, None, False, None, "g1"), (2, "a", 2, ["x:1"], None, None, False, None, None)], FULL)
    r = K.consolidate_import(df).first()
    assert (r.quantity, r.source_ids, r.resolved_ids, r.members) == (7, ["g1", "x:1"], ["g1"], 3)


def test_order_of_input_partitions_does_not_matter(spark):
    data = [(f"n{i % 7}", i, [f"x:{i % 13}"], None) for i in range(60)]
    want = result(rows(spark, *data))
    assert result(rows(spark, *data).repartition(5)) == want == result(rows(spark, *data).orderBy(F.desc("position")))


def test_fold_equals_single_id_path(spark):
    r = rows(spark, *[(f"n{i % 7}", i, [f"x:{i % 13}"], None) for i in range(60)])
    single = K.consolidate_single(r.withColumn("source_identity", F.get("contributing_source_record_ids", F.lit(0))))
    assert {(x.key, x.quantity) for x in single.collect()} == {(x.key, x.quantity) for x in K.consolidate_import(r).collect()}


def test_gap_coverage(spark):
    r = spark.createDataFrame([(None, ["g1", "g1"]), ("g2", ["g2"]), (None, ["g2", "gx"])], "resolved_source_record_id string, resolved_source_record_ids array<string>")
    g = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "id string")
    assert {(x.id, x.problem) for x in K.gap_coverage(r, g).collect()} == {("g2", "duplicate"), ("gx", "unexpected"), ("g3", "missing")}
    assert [x.id for x in K.unresolved_gaps(g, r).collect()] == ["g3"]


def test_restore_preview(spark):
    r = rows(spark, ("a", 3, ["x:1"], None), ("b", 4, None, None)).withColumns({"resolved_source_record_id": F.lit(None).cast("string"), "resolved_source_record_ids": F.array().cast("array<string>")})
    snap = K.register_preview_snapshot(r, "p", F.current_timestamp())
    sub = spark.createDataFrame([(1, 3, ["item-0"], None), (2, 9, ["item-0x"], None), (3, 9, ["item-1"], None), (4, 1, [], ["g1"]), (5, 1, [], ["gx"])], "row_id int, quantity int, preview_item_ids array<string>, resolved_source_record_ids array<string>")
    got = {x.row_id: x.reason for x in K.restore_preview(sub, snap, spark.createDataFrame([("g1",)], "id string")).collect()}
    assert got == {1: None, 2: "unknown item", 3: None, 4: None, 5: "no item and no single known gap"}
    locked = spark.createDataFrame([(1, 4, ["item-0"], None)], sub.schema)
    assert K.restore_preview(locked, snap, spark.createDataFrame([("g1",)], "id string")).first().reason == "quantity was changed"


def confirm(spark, data, prods):
    cols = "batch_id string, position bigint, product_name string, product_code string, quantity int, price double, imported_quantity int, canonical_name string, resolution_type string, selected_product_id bigint, match_fingerprint string, is_valid boolean, review_required boolean, match_review_required boolean"
    r = spark.createDataFrame([("b", i, n, None, q, None, q, None, t, s, f, True, False, False) for i, (n, q, t, s, f) in enumerate(data)], cols)
    return I.confirm_import(I.decide(r, prods, "T3").withColumn("source", F.lit("T3")), prods)


def test_confirm_adds_to_the_stock(spark):
    out = confirm(spark, [("Pil_Yuvarlak", 25, None, None, None), ("Yeni", 1, None, None, None)], products(spark, {"id": 1, "name": "pil yuvarlak", "quantity": 51, "source": "T3"}))
    assert out["stocks"].first().new_stock == 76
    b = out["batches"].first()
    assert (b.created, b.updated, b.accepted) == (1, 1, True) and out["history"].count() == 2


def test_one_bad_row_rejects_the_import(spark):
    p = products(spark, {"id": 1, "name": "a", "quantity": 1, "source": "Belediye"})
    out = confirm(spark, [("a", 1, None, None, None), ("Yeni", 1, None, None, None)], p)
    assert not out["batches"].first().accepted and out["products"].count() == out["history"].count() == out["stocks"].count() == 0


def test_stale_fingerprint(spark):
    p = products(spark, {"id": 1, "name": "a", "quantity": 1, "source": "T3"})
    assert confirm(spark, [("a", 1, "EXISTING", 1, "old")], p)["batches"].first().reason == "matches have changed"
    rows_ = spark.createDataFrame([("a", 1, False, None)], "product_name string, quantity int, review_required boolean, review_message string")
    live = M.match_preview(rows_, p, "T3").first().match_fingerprint
    assert confirm(spark, [("a", 1, "EXISTING", 1, live)], p)["batches"].first().accepted


def test_extraction_json(spark):
    texts = ['```json\n[{"productName":" A ","quantity":"4 bidon","price":"12,5"},{"quantity":-5},{"quantity":2.5},{"quantity":null}]\n```', "", "text", '[{"quantity": 3000000000}]', "[]"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, response string")
    got = R.extraction_json(df).orderBy("chunk_id", "position").collect()
    assert [(r.product_name, r.quantity) for r in got if r.chunk_id == "0"] == [("A", 4), (None, -5), (None, 3), (None, None)]
    assert sorted(r.chunk_id for r in got if r.malformed) == ["1", "2", "3"] and not any(r.chunk_id == "4" for r in got)


def test_rows_and_sources_of_a_chunk_meet_on_one_shuffle(spark):
    s = spark.createDataFrame([("c", 0, "r1", "Kalem", 5), ("c", 1, "r2", "Defter", 7), ("c", 2, "r2", "Silgi", 7), ("c", 3, None, "Kutu", None), ("d", 0, "r1", "Kalem", 5), ("d", 1, "r3", " ", 5)], "chunk_id string, position int, source_identity string, product_name string, quantity int")
    e = spark.createDataFrame([("c", 0, "r1", "x", 5), ("c", 1, "r2", "x", 5), ("c", 2, " ", "KALEM", 5), ("c", 3, None, "Kutu", None), ("d", 0, None, "Defter", 7), ("d", 1, "r9", "Kalem", 5)], "chunk_id string, position int, source_record_id string, product_name string, quantity int")
    got = R.assign_source_identity(e, s)
    assert {(r.chunk_id, r.position): (r.source_identity, r.identity_review, r.review_message is None) for r in got.collect()} == {("c", 0): ("r1", False, True), ("c", 1): (None, True, False), ("c", 2): ("r1", False, True), ("c", 3): (None, True, False), ("d", 0): (None, True, False), ("d", 1): (None, True, False)}
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    absent = spark.createDataFrame([("c", True), ("d", True)], "chunk_id string, code_absent boolean")
    rows = R.reconcile_source_rows(s.where("position < 3"), got.withColumns({"product_code": F.lit("k"), "price": F.lit(None).cast("decimal(38,18)")}), absent)
    assert sorted((r.chunk_id, r.position, r.recovered, r.duplicates, r.product_code) for r in rows.collect()) == [("c", 0, False, 1, "k"), ("c", 1, True, 0, None), ("c", 2, True, 0, None)]
    assert "Join" not in plan(got) and plan(rows).count("Join") == 1


def test_responses_are_read_in_one_pass(spark):
    df = spark.createDataFrame([("a", '[{"quantity": 1.5}, {"quantity": "2"}]'), ("b", '[{"quantity": 3000000000}, {"quantity": 1}]')], "chunk_id string, response string")
    got = R.extraction_json(df)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window", "Union"))
    assert sorted((r.chunk_id, r.position, r.quantity, r.malformed) for r in got.where("NOT malformed").collect()) == [("a", 0, 2, False), ("a", 1, 2, False)]
    assert [(r.chunk_id, r.position, r.raw_quantity) for r in got.where("malformed").collect()] == [("b", None, None)]


def test_reconcile(spark):
    s = spark.createDataFrame([("c", i, f"r{i}", f"Ad {i}", i) for i in (1, 2, 3)], "chunk_id string, position int, source_identity string, product_name string, quantity int")
    e = spark.createDataFrame([("c", 1, "r2", None, None, False), ("c", 2, "r2", "K", None, False), ("c", 3, None, None, None, True)], "chunk_id string, position int, source_identity string, product_code string, price double, identity_review boolean")
    absent = lambda x: spark.createDataFrame([("c", x)], "chunk_id string, code_absent boolean")
    got = {r.source_identity: (r.recovered, r.duplicates) for r in R.reconcile_source_rows(s, e, absent(True)).collect()}
    assert got == {"r1": (True, 0), "r2": (False, 1), "r3": (True, 0)}
    assert [r.source_identity for r in R.reconcile_source_rows(s, e, absent(False)).collect()] == ["r2"]


def test_align_records(spark):
    rec = spark.createDataFrame([("c", 1, 1, "Kalem", 5), ("c", 2, 2, "Defter", 7), ("c", 3, 3, None, 9)], "chunk_id string, position int, record_id int, name_anchor string, quantity_anchor int")
    out = lambda *d: spark.createDataFrame([("c", i + 1, n, q) for i, (n, q) in enumerate(d)], "chunk_id string, position int, product_name string, quantity int")
    ok = {r.position: (r.product_name, r.error) for r in R.align_records(out(("1. kalem", 5), ("Defter A4", 7), ("Silgi", 9)), rec).collect()}
    assert ok == {1: ("Kalem", None), 2: ("Defter", None), 3: ("Silgi", None)}
    bad = {r.position: r.error for r in R.align_records(out(("Defter", 5), ("Defter", 5), ("x", 9)), rec).collect()}
    assert bad[1] == "fits record 2" and bad[2] == "quantity of another record"


def test_alignment_against_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["vida", "kalem", "m3", "uzun kablo", "x" * 9, "ab", "kutu mavi"])
    names = [rng.choice([None, " ".join(word() for _ in range(rng.randint(1, 4)))]) for _ in range(120)]
    rec = [("c", i, 1000 + i, n, rng.choice([None, 1, 2, i])) for i, n in enumerate(names)]
    out = [("c", i, rng.choice([names[i], rng.choice(names), " ".join(word() for _ in range(2)), None]), rng.choice([1, 2, i, 500])) for i in range(120)]
    r = spark.createDataFrame(rec, "chunk_id string, position int, record_id int, name_anchor string, quantity_anchor int")
    e = spark.createDataFrame(out, "chunk_id string, position int, product_name string, quantity int")
    fits = lambda a, b: a == b or len(a) >= 4 and a in b or len(b) >= 4 and b in a
    got = {x.position: x.error for x in R.align_records(e, r).collect()}
    seen = 0
    for (_, i, name, q), (_, _, _, src, own) in zip(out, rec, strict=True):
        if src and not (name and fits(src, name)):
            hit = [x[2] for x in rec if x[1] != i and x[3] and name and fits(x[3], name)]
            assert got[i] == (f"fits record {hit[0]}" if hit else "name does not fit")
            seen += bool(hit)
        elif own is not None and q != own and any(x[4] == q for x in rec if x[1] != i):
            assert got[i] == "quantity of another record"
        else:
            assert got[i] in (None, "one name for two records")
    assert seen > 10


def test_few_records_meet_without_an_index(spark, monkeypatch):
    rec = spark.createDataFrame([("c", 1, 1, "Kalem", 5), ("c", 2, 2, "Defter", 7), ("c", 3, 3, "Defter A4", 9)], "chunk_id string, position int, record_id int, name_anchor string, quantity_anchor int")
    out = spark.createDataFrame([("c", 1, "Defter A4 mavi", 5), ("c", 2, "kalem", 7), ("c", 3, "Silgi", 9)], "chunk_id string, position int, product_name string, quantity int")
    want = {1: "fits record 2", 2: "fits record 1", 3: "name does not fit"}
    asked = spark.createDataFrame([("c", 1, "defter a4 mavi", 3), ("c", 2, "kalem", 3), ("c", 3, "silgi", 3)], "chunk_id string, position int, out string, records int")
    keyed = rec.withColumn("k", S.alignment_key(F.col("name_anchor")))
    assert {r.position: r.other for r in R._fitting(asked, keyed, few=0).collect()} == {1: 2, 2: 1}
    monkeypatch.setattr(R, "_pieces", None)
    assert {r.position: r.error for r in R.align_records(out, rec).collect()} == want


def test_split_failed_chunks(spark):
    r = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 0, 0)], "chunk_id string, position int, record_id int")
    halves, lone = R.split_failed_chunks(r, spark.createDataFrame([("a",), ("b",)], "chunk_id string"))
    assert [x.half for x in halves.orderBy("position").collect()] == [1, 1, 2, 2, 2] and lone.count() == 1


def test_suppress_invented_codes(spark):
    e = spark.createDataFrame([("p", 1, "X"), ("p", 2, "X"), ("q", 1, "X"), ("r", 1, "X")], "chunk_id string, position int, product_code string")
    rec = spark.createDataFrame([("p", 1, "P-1", False), ("p", 2, None, True)], "chunk_id string, position int, code_anchor string, code_absent boolean")
    ch = spark.createDataFrame([("p", False), ("q", True), ("r", False)], "chunk_id string, code_absent boolean")
    assert {(r.chunk_id, r.position): r.product_code for r in R.suppress_invented_codes(e, rec, ch).collect()} == {("p", 1): "P-1", ("p", 2): None, ("q", 1): None, ("r", 1): "X"}


def test_name_review_outcome(spark):
    r = spark.createDataFrame([(1, "5 mm çap", "Kalem", True), (2, "5 mm çap", None, False), (3, "5 mm çap", None, False), (4, "Kalem", None, False)], "row_id int, product_name string, source_name string, trusted_name boolean")
    d = spark.createDataFrame([(2, "CORRECTED", "Defter", None), (3, "CORRECTED", "7 mm çap", None)], "row_id int, status string, product_name string, reason string")
    got = {x.row_id: (x.product_name, x.outcome) for x in R.name_review_outcome(r, d).collect()}
    assert got == {1: ("Kalem", "SOURCE"), 2: ("Defter", "CORRECTED"), 3: ("5 mm çap", "BAD_CORRECTION")}


def test_names_are_judged_once_each(spark, monkeypatch):
    staged = {}
    real = R.stage
    monkeypatch.setattr(R, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    names = [("5 mm çap", None), ("Kalem", "Defter"), ("Kalem", None), ("  ", None), (None, "Kalem"), ("x. y, z; 12V 5mm", "x")]
    r = spark.createDataFrame([(i, *names[i % 6]) for i in range(600)], "position int, n string, c string")
    got = R.with_suspicion(r, {"rules": ("n", "c")}).select("position", S.suspicion(F.col("rules")).alias("s"))
    want = r.select("position", S.name_suspicion(F.col("n"), F.col("c")).alias("w"))
    assert staged["judged"].count() == 5 and got.count() == 600
    both = got.join(want, "position").where("position < 6").orderBy("position").collect()
    assert [x.s for x in both] == [x.w for x in both]
    assert [(x.s.suspicious, x.s.score) for x in both] == [(True, 5), (True, 4), (False, 0), (False, 0), (False, 0), (True, 9)]


def test_renumber_with_gaps(spark):
    p = spark.createDataFrame([("d", 0), ("d", 1)], "document string, position int")
    m = spark.createDataFrame([("d", 1, 0), ("d", 1, 1)], "document string, insertion_index int, gap_ordinal int")
    assert [(r.is_manual) for r in R.renumber_with_gaps(p, m).orderBy("row_number").collect()] == [False, True, True, False]
