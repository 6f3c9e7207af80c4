import random
import re

from pyspark.sql import functions as F

from stockweave.operators import documents as D


def cells(spark, sheet, grid, start=1):
    data = [("d", sheet, r + start, c + 1, str(v)) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(data, "document string, sheet string, row int, col int, value string")


def test_full_table(spark):
    grid = [["Sıra No", "Malzeme Adı", "Teknik Özellikler", "Toplam Adet"]] + [[i, f"Ürün {i}", "12V", i] for i in range(1, 302)]
    rows = D.sheet_rows(cells(spark, "FULL-301", grid))
    rec = D.table_records(rows, D.detect_header(rows)).collect()
    assert {r.source_identity for r in rec} == {f"xlsx:FULL-301:row:{i}" for i in range(2, 303)} and {r.quantity for r in rec} == set(range(1, 302))


def test_sheets_into_chunks(spark):
    df = None
    for s, n in enumerate((61, 60, 60, 60, 60)):
        c = cells(spark, f"S{s}", [["Malzeme Adı", "Genel Toplam"]] + [[f"Ad {i}", i + 1] for i in range(n)])
        df = c if df is None else df.unionByName(c)
    rows = D.sheet_rows(df)
    chunks = D.excel_chunks(rows, D.table_records(rows, D.detect_header(rows)))
    assert chunks.count() == 35 and chunks.agg(F.sum("candidate_count")).first()[0] == 301


def test_split_header_rows(spark):
    rows = D.sheet_rows(cells(spark, "EK-1", [["Malzeme Adı", ""], ["", "Genel Toplam"], ["Tuval_1", "450"]]))
    h = D.detect_header(rows).first()
    assert (h.name_col, h.quantity_col, h.header_row) == (0, 1, 2)
    assert [r.source_identity for r in D.table_records(rows, D.detect_header(rows)).collect()] == ["xlsx:EK-1:row:3"]


def test_notes_are_not_trusted(spark):
    grid = [["Liste"], ["Not: bilgi"], [""], ["Sıra No", "Malzeme Adı", "Adet"]] + [[i, f"Ad {i}", i] for i in range(1, 11)]
    df = cells(spark, "A", grid).unionByName(cells(spark, "Notlar", [["a"], ["b"], ["c"], ["d"]]))
    rows = D.sheet_rows(df)
    rec = D.table_records(rows, D.detect_header(rows))
    assert sorted(r.source_row for r in rec.collect()) == list(range(5, 15))
    notes = D.detect_header(rows).where("sheet = 'Notlar'").first()
    assert notes.header_row is None and notes.content == "a\nb\nc"


def test_files_of_several_splits(spark, tmp_path):
    rng = random.Random(2)
    texts = {}
    for name in ("a.csv", "b.csv", "empty.csv"):
        rows = [";".join(rng.choice(["", "ürün", "x" * 30, " "]) for _ in range(rng.randint(0, 4))) for _ in range(0 if name[0] == "e" else 400)]
        texts[name] = "".join(r + rng.choice(["\n", "\r\n", "\r", "\n\n"]) for r in rows) + ("" if name[0] != "a" else "end;1")
        (tmp_path / name).write_bytes(texts[name].encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        out = D.delimited_rows(spark, str(tmp_path))
        got = sorted((r.document.rsplit("/", 1)[1], r.line_no, r.text, r.is_header) for r in out.collect())
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for name, text in texts.items():
        kept = [(k, line) for k, line in enumerate(re.split(r"\r\n|\r|\n", text), 1) if line.strip()]
        want += [(name, k, line, k == kept[0][0]) for k, line in kept]
    assert got == sorted(want)


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ad;Adet\n\nKalem;3\r\nDefter;4\nSilgi;5\n", encoding="utf-8")
    rows = D.delimited_rows(spark, str(tmp_path))
    got = rows.orderBy("line_no").collect()
    assert [(r.line_no, r.delimiter, r.is_header) for r in got] == [(1, ";", True), (3, ";", False), (4, ";", False), (5, ";", False)]
    assert D.row_chunks(rows, ["document"], "line_no", 2).count() == 2
    assert rows.where("line_no = 3").select(D.split_delimited_cells(F.col("text"), F.col("delimiter"))).first()[0] == ["Kalem", "3"]


def brute_blocks(text, most):
    trim = lambda s: s.strip("".join(map(chr, range(33))))
    out = []
    for p in re.split(r"\n\s*\n+", trim(re.sub(r"\r\n|\r", "\n", text))):
        p = trim(p)
        if not p:
            continue
        if len(p) <= most:
            out.append(p)
            continue
        now = ""
        for line in p.split("\n"):
            if len(line) > most:
                if now:
                    out.append(now)
                now, at = "", 0
                while at < len(line):
                    end = min(at + most, len(line))
                    if end < len(line):
                        space = line.rfind(" ", 0, end + 1)
                        end = space if space > at else end
                    out.append(trim(line[at:end]))
                    at = end
                    while at < len(line) and line[at].isspace():
                        at += 1
            elif now and len(now) + 1 + len(line) > most:
                out.append(now)
                now = line
            else:
                now = f"{now}\n{line}" if now else line
        if now:
            out.append(now)
    return out


def brute_pack(blocks, most):
    out, now = [], ""
    for b in blocks:
        if now and len(now) + 2 + len(b) > most:
            out.append(now)
            now = ""
        now = f"{now}\n\n{b}" if now else b
    return out + [now] if now else out


def test_blocks_and_packing_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select(F.col("doc_id").alias("document"), "text")
    texts = {r.document: r.text for r in docs.collect()}
    texts[-1] = "a\n\nb\n \n" + "x" * 75 + " yy zz\n" + "kısa\n" + "w " * 40
    docs = docs.unionByName(spark.createDataFrame([(-1, texts[-1])], docs.schema))
    for most in (30, 200):
        b = D.text_blocks(docs, most)
        got = {}
        for r in b.orderBy("document", "position").collect():
            got.setdefault(r.document, []).append(r.block)
        assert got == {k: v for k, t in texts.items() if (v := brute_blocks(t, most))}
        packed = {}
        for r in D.pack_blocks(b, 3 * most).orderBy("document", "chunk_index").collect():
            packed.setdefault(r.document, []).append(r.content)
        assert packed == {k: brute_pack(v, 3 * most) for k, v in got.items()}


def fold(texts, glue, most):
    """Contents of consecutive texts, one text after the other."""
    out, now, size = [], [], 0
    for x in texts:
        if size and size + len(glue) + len(x) > most:
            out.append(glue.join(now))
            now, size = [], 0
        if not size:
            now = []
        size += len(glue) + len(x) if size else len(x)
        now.append(x)
    return out + [glue.join(now)] if size else out


def test_contents_equal_the_fold(spark):
    rng = random.Random(8)
    texts = {d: ["x" * rng.choice([0, 0, 1, 3, 9, 30]) for _ in range(rng.choice([1, 2, 5, 400]))] for d in range(12)} | {99: ["", ""], 100: ["", "a", ""]}
    rows = spark.createDataFrame([(d, 3 * i, x) for d, t in texts.items() for i, x in enumerate(t)], "d int, at int, x string")
    for glue, most, few in (("\n\n", 20, 100), ("-", 30, 0), ("", 7, 500)):
        got = {}
        for r in D.pack(rows, ["d"], "at", "x", glue, most, few).orderBy("d", "k").collect():
            got.setdefault(r.d, []).append((r.k, r.content))
        assert got == {d: list(enumerate(f)) for d, t in texts.items() if (f := fold(t, glue, most))}


def test_a_giant_document_equals_the_fold_and_needs_no_python(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("document"), F.col("id").alias("position"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("block"))
    out = D.pack_blocks(rows, 40)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    giant = [r.content for r in out.where("document = -1").orderBy("chunk_index").collect()]
    assert giant == fold(["x" * (k % 7 + 1) for k in range(6000) if k % 3], "\n\n", 40)


def test_paragraphs_are_not_split(spark):
    docs = spark.createDataFrame([(1, "a" * 700 + "\n\n" + "b" * 700)], "document int, text string")
    assert [len(r.content) for r in D.pack_blocks(D.text_blocks(docs, 1000), 1000).orderBy("chunk_index").collect()] == [700, 700]


def page(spark, *lines):
    return spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(lines)], "document string, page int, line_no int, text string")


def test_three_styles_of_records(spark):
    text = []
    for i in range(1, 23):
        text += [f"{i}) Defter {i} | Miktar: {i}"] if i % 3 == 1 else [f"Ürün Adı: Kalem {i}", f"Miktar: {i}"]
    p = page(spark, *text)
    rec = D.segment_records(p)
    c = D.page_confidence(p).first()
    assert (c.confidence, c.mixed, c.markers) == ("RELIABLE", True, 22)
    assert [r.record_id for r in rec.orderBy("ordinal").collect()] == list(range(1, 23))
    assert [r.record_count for r in D.record_chunks(rec).orderBy("chunk_index").collect()] == [5, 5, 5, 5, 2]


def test_technical_numbers_are_no_records(spark):
    p = page(spark, "12V adaptör", "5mm uç", "300 adet", "20x15mm levha", "2020 profil", "2 metre kablo")
    assert D.segment_records(p).count() == 0 and D.page_confidence(p).first().confidence == "UNKNOWN"


def test_codes(spark):
    p = page(spark, "Ürün Adı: A", "Ürün Kodu: P-1", "Miktar: 2", "Ürün Adı: B", "Ürün Kodu: Belirtilmemiş", "Miktar: 3")
    assert [(r.code_anchor, r.code_absent) for r in D.segment_records(p).orderBy("ordinal").collect()] == [("P-1", False), (None, True)]


def test_names_before_descriptions(spark):
    p = page(spark, "1 Boya su bazlı 10", "2 Kablo 5 metre kablo 3", "3 Kutu | mavi | 4", "4 Uzun - açıklama 5", "5 Belirsiz ad 6")
    got = [(r.name_anchor, r.quantity_anchor) for r in D.segment_records(p).orderBy("ordinal").collect()]
    assert got == [("Boya", 10), ("Kablo", 3), ("Kutu", 4), ("Uzun", 5), (None, 6)]


def test_footers_are_cut(spark):
    p = page(spark, "1 Kalem | 1", "2 Silgi | 2", "3 Defter | 3", "Toplam: 6")
    assert [r.source_text for r in D.segment_records(p).orderBy("ordinal").collect()] == ["1 Kalem | 1", "2 Silgi | 2", "3 Defter | 3"]


def test_reliable_candidates(spark):
    p = page(spark, "Sıra No | Ürün Kodu | Malzeme Adı | Miktar", *[f"{i} | Ad {i} | {i}" for i in range(26, 51)], "99 | Ad | 1")
    r = D.reliable_candidates(p).first()
    assert (r.reliable, r.matched, r.outliers) == (25, 26, 1)


def test_runs(spark):
    df = spark.createDataFrame([("d", n) for n in (1, 2, 4, 5, 6, 6, 9, 10, 11, 12)], "document string, number int")
    assert sorted(r.number for r in D.consecutive_runs(df, ["document"], "number").collect()) == [4, 5, 6, 9, 10, 11, 12]


def brute_name(line, kind):
    line = line.strip()
    if kind == "EXPLICIT_LABEL":
        cut = min((k for k in (line.find(":"), line.find("|")) if k >= 0), default=-1)
        return (line[cut + 1 :].strip() or None) if cut >= 0 else None
    rest = re.sub(r"^[.)\-:|;]\s*", "", re.sub(r"^\d{1,4}", "", line).strip())
    for mark in ("|", " - "):
        if mark in rest:
            return rest.split(mark)[0].strip() or None
    return None


def brute_code(text):
    fold = lambda v: v.lower().translate(str.maketrans("ıİşŞçÇğĞüÜöÖ", "iissccgguuoo"))
    values = [m.strip() for m in re.findall(r"(?im)(?:^|\|)\s*(?:kod|ürün\s+kodu|urun\s+kodu|stok\s+kodu|malzeme\s+kodu)\s*[:|]\s*([^|\n]+)", text)]
    real = [v for v in values if fold(v) not in ("-", "yok") and not any(p in fold(v) for p in ("belirtilmemis", "bulunmuyor"))]
    return real[0] if real else None, not real


def test_anchors_of_the_page_view_against_brute_force(spark, sf_dir):
    from stockweave.sources.views import frame

    rows = D.segment_records(frame(spark, sf_dir, "page_lines")).collect()
    assert len(rows) > 1000
    for r in rows:
        assert r.name_anchor == brute_name(r.source_text.split("\n")[0], r.start_kind), r
        assert (r.code_anchor, r.code_absent) == brute_code(r.source_text), r


def test_header_of_a_sheet_that_begins_with_records(spark):
    cells = spark.createDataFrame([("d", "s", r, c, x) for r, line in enumerate([("1", "Kalem", "3"), ("2", "Defter", "4")], 1) for c, x in enumerate(line, 1)], "document string, sheet string, row int, col int, value string")
    h = D.detect_header(D.sheet_rows(cells)).first()
    assert (h.content, h.name_col, h.header_row, h.code_absent) == (D.NO_HEADER, None, None, False)


def test_line_patterns_run_once(spark):
    lines = spark.createDataFrame([("d", 1, 1, "1. vida 5")], "document string, page int, line_no int, text string").repartition(1)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lines.select(D.is_header_line(F.col("text")).alias("header"))).count("lower(") == 1
    assert plan(D.numbered_lines(lines)).count(r"(?=.*\p{L})") == 1
    assert plan(D.reliable_candidates(lines)).count("regexp_extract(") == 1
    assert plan(D.page_ids_per_chunk(lines)).count("regexp_extract(") == 1


def test_table_lines_of_a_page(spark):
    head = "Sıra No | Malzeme Adı | Birim | Toplam Adet"
    texts = ["1. vida 5", "2. vida 5", "3 | kutu | 7 adet", "3. vida 9", "9. vida 5", "not a record", f"4. {head} 12", "12", None]
    lines = spark.createDataFrame([("d", 1, n, t) for n, t in enumerate(texts)] + [("e", 1, 1, "no number"), ("h", 1, 1, f"1. {head} 2")], "document string, page int, line_no int, text string")
    got = {r.document: (r.reliable, r.matched, r.header_lines, r.outliers) for r in D.reliable_candidates(lines).collect()}
    assert got == {"d": (3, 4, 1, 1), "h": (0, 0, 1, 0)}
    chunks = sorted((r.chunk_index, r.ids, r.first_id, r.last_id) for r in D.page_ids_per_chunk(lines, 2).collect())
    assert chunks == [(1, 2, 1, 2), (2, 1, 3, 3)]


def test_records_of_cells_take_their_header_without_a_join(spark):
    sheets = {"a": [("Sıra No", "Malzeme Adı", "Toplam Adet"), ("1", "Kalem", "3"), (None, " ", ""), ("2", " ", "4"), ("3", "Defter", "yok"), ("4", "Silgi", "5")], "b": [("1", "Kalem", "3"), ("2", "Defter", "4")]}
    cells = spark.createDataFrame([("d", s, r, c, x) for s, lines in sheets.items() for r, line in enumerate(lines, 1) for c, x in enumerate(line, 1)], "document string, sheet string, row int, col int, value string")
    got = D.cell_records(cells)
    assert sorted((r.sheet, r.source_row, r.source_text, r.product_name, r.quantity) for r in got.collect()) == [("a", 2, "1 | Kalem | 3", "Kalem", 3), ("a", 6, "4 | Silgi | 5", "Silgi", 5)]
    rows = D.sheet_rows(cells)
    assert sorted(got.collect()) == sorted(D.table_records(rows, D.detect_header(rows)).collect())
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
