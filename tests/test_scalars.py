import re
import unicodedata

from pyspark.sql import functions as F

from stockweave.functions import scalars as S


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_canonical_name_spellings(spark):
    same = ["Pil_Yuvarlak", "  Pil   Yuvarlak  ", "pil_yuvarlak", "PİL YUVARLAK", "Pil-Yuvarlak"]
    assert set(values(spark, same, S.canonical_name)) == {"pil yuvarlak"}
    other = ["Pil Yuvası 4xAA", "Pil Yuvası 2xAA", "M3 Vida", "M4 Vida", "Kablo 1m", "Kablo 2m"]
    assert len(set(values(spark, other, S.canonical_name))) == 6


def test_canonical_name_edges(spark):
    assert values(spark, ["", "   ", None, "---", "IŞIK", "İz"], S.canonical_name)[:5] == [None, None, None, " ", "ışık"]


def test_semantic_key_matches_unicodedata(spark):
    texts = ["Ａ１ ﬁ", "Pil-Yuvası", "é é", "①②"]
    low = lambda t: re.sub(r"[\W_]", "", unicodedata.normalize("NFKC", t).replace("İ", "i").replace("I", "ı").lower())
    assert values(spark, texts, S.semantic_key) == [low(t) for t in texts]


def test_coerce_texts(spark):
    assert values(spark, ["4 bidon", "200 pcs", "yok", "-5", "2x3", "99999999999"], S.coerce_quantity_text) == [4, 200, None, 5, 23, None]
    assert [None if x is None else float(x) for x in values(spark, ["12,50 TL", "x", "-1.5"], S.coerce_price)] == [12.5, None, -1.5]
    assert values(spark, ["12", " 7 ", "0", "-3", "1.5", "99999999999", None], S.positive_int_cell) == [12, 7, None, None, None, None, None]


def test_structural_errors(spark):
    df = spark.createDataFrame([(" ", None, None, None), ("a", "A", 0, -1.0), ("x" * 256, "k\n1", 1, 1.0), ("ok", None, 1, None)], "n string, k string, q int, p double")
    out = [r[0] for r in df.select(S.structural_errors(*[F.col(c) for c in "nkqp"])).collect()]
    assert out[0] == ["Ürün adı boş olamaz", "Geçersiz miktar: güvenilir bir miktar belirlenemedi"]
    assert out[1] == ["Ürün kodu, ürün adından kopyalanamaz", "Miktar 0'dan büyük olmalıdır (alınan: 0)", "Fiyat 0'dan küçük olamaz"]
    assert out[2] == ["Ürün adı en fazla 255 karakter olabilir (alınan: 256)", "Ürün kodu satır sonu veya kontrol karakteri içeremez"]
    assert out[3] == []


def test_name_suspicion(spark):
    rows = [
        ("Silikon Tabancası", "Silikon Tabancası"),
        ("Bu ürün dayanıklı malzemeden üretilmiştir ve okullarda uzun süre kullanılabilir.", None),
        ("Uzun Ama Yalnızca Bir Etiket Olan Eğitim Seti Kutusu Büyük Boy", None),
        ("Makas", "Cetvel"),
        ("5 mm çap", None),
        ("100 ml plastik şişe", None),
        ("10'lu paket", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, s string")
    got = [r[0] for r in df.select("i", S.name_suspicion(F.col("n"), F.col("s"))["suspicious"].alias("x")).orderBy("i").select("x").collect()]
    assert got == [False, True, False, True, True, True, True]


def test_name_uuid_is_version_3(spark):
    import hashlib
    import uuid

    texts = ["a|T3|", "pil|null|1:x:null|", ""]
    want = [str(uuid.UUID(bytes=hashlib.md5(t.encode()).digest(), version=3)) for t in texts]
    assert values(spark, texts, S.name_uuid) == want


def test_labels_and_cells(spark):
    assert values(spark, ["STOK_CIKIS", "X"], lambda c: S.operation_label(c)["sign"]) == ["−", "+"]
    assert values(spark, ["KARMA_ISLEM", "X"], S.history_type_label) == ["Karma İşlem", "X"]
    assert values(spark, ["x" * 41, "kısa"], S.truncate_cell) == ["x" * 39 + "…", "kısa"]
    assert values(spark, ["", None, "a"], S.null_to_dash) == ["—", "—", "a"]
    long = "k" * 200
    assert values(spark, [long, " "], lambda c: S.review_message_160(c, F.lit("yedek"))) == ["k" * 157 + "...", "yedek"]
    assert values(spark, ["xlsx:A:row:b:row:12", "pdf:page:1:record:2"], lambda c: S.parse_source_identity(c)["row"]) == [12, None]
