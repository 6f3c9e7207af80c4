import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from stockweave.operators import catalog as C
from stockweave.operators.ordering import numbered
from stockweave.operators import matching as M
from stockweave.plans import QUERIES

PRODUCT = "id bigint, code string, name string, category_id bigint, category string, quantity int, unit string, min_stock_level int, shelf_location string, source string"


def products(spark, *rows):
    base = {"code": None, "category_id": None, "category": None, "unit": "Adet", "min_stock_level": 5, "shelf_location": None, "source": "Belediye"}
    cols = [c.split()[0] for c in PRODUCT.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(c) for c in cols) for r in rows], PRODUCT)


def test_get_by_id_missing_is_an_error(spark):
    p = products(spark, {"id": 1, "name": "a", "quantity": 1})
    assert C.get_by_id(p, 1).count() == 1
    with pytest.raises(Exception, match="not found"):
        C.get_by_id(p, 2).collect()


def test_search_wildcards(spark):
    p = products(spark, {"id": 1, "name": "a_b", "quantity": 1}, {"id": 2, "name": "axb", "quantity": 1})
    assert C.search_products(p, "A_B").count() == 2
    assert C.search_products(p, "A_B", literal=True).count() == 1


def test_groups(spark):
    p = products(spark, {"id": 8, "name": "Pil_Yuvarlak", "quantity": 51}, {"id": 3, "name": "PİL YUVARLAK", "quantity": 20})
    r = M.match_group_resolution(p).first()
    assert (r.safe, r.target_id, r.total_stock) == (True, 3, 71)
    assert M.match_conflict_details(p).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "fields", "message"),
    [
        ({"category_id": 1, "category": "A"}, {"category_id": 2, "category": "B"}, ["Kategori"], "Kategori farklı: A / B"),
        ({"source": "Belediye"}, {"source": None}, ["Kaynak"], "Kaynak farklı: Belediye / Belirtilmemiş"),
        ({"unit": "Adet"}, {"unit": "Paket"}, ["Birim"], "Birim farklı: Adet / Paket"),
        ({"category_id": 1, "category": "A", "shelf_location": "R1"}, {"category_id": 2, "category": "B", "shelf_location": "R2"}, ["Kategori", "Raf konumu"], "Kategori ve Raf konumu farklı."),
    ],
)
def test_conflicts(spark, a, b, fields, message):
    p = products(spark, {"id": 1, "name": "x", "quantity": 1} | a, {"id": 2, "name": "X", "quantity": 2} | b)
    r = M.match_conflict_details(p).first()
    assert (r.fields, r.message) == (fields, message)
    g = M.match_group_resolution(p).first()
    assert (g.safe, g.target_id, g.total_stock) == (False, None, 0)


def test_source_filter(spark):
    p = products(spark, *[{"id": i, "name": n, "quantity": 1, "source": s} for i, n, s in ((1, "Silikon Tabancası", "Belediye"), (2, "silikon_tabancası", "T3"), (3, "SİLİKON TABANCASI", "Belediye"))])
    rows = spark.createDataFrame([("Silikon Tabancası",)], "product_name string")
    n = lambda s: M.source_filtered_match(rows, p, s).first().matches
    assert (M.canonical_match(rows, p).first().matches, n("T3"), n("Belediye"), n("Tubitak"), n(None)) == (3, 1, 2, 0, 0)
    options = lambda s: sorted((r.id, r.allow_new) for r in M.manual_resolution_options(p, s).collect())
    assert options("Belediye") == [(1, False), (3, False)] and options(None) == [(i, True) for i in (1, 2, 3)]


def test_a_match_names_all_its_products(spark, sf_dir):
    p = products(spark, *[{"id": i, "name": n, "quantity": 1} for i, n in ((10, "Pil_A"), (9, "pil a"), (100, "PİL A"), (3, "b"))])
    rows = spark.createDataFrame([("Pil-A",), ("b",), ("c",), (None,)], "product_name string")
    assert {r.product_name: (r.matches, r.first_id, r.ids) for r in M.canonical_match(rows, p).collect()} == {"Pil-A": (3, 9, "9,10,100"), "b": (1, 3, "3"), "c": (0, None, ""), None: (0, None, "")}
    got = QUERIES["canonical_match"](spark, sf_dir).collect()
    assert got and all(len(r.ids.split(",")) == r.matches and r.ids.split(",")[0] == str(r.first_id) if r.matches else r.ids == "" for r in got)


def test_a_match_of_a_source_names_all_its_products(spark, sf_dir):
    p = products(spark, *[{"id": i, "name": n, "quantity": 1, "source": s} for i, n, s in ((10, "Pil_A", None), (9, "pil a", "T3"), (8, "PİL A", None))])
    rows = spark.createDataFrame([("Pil-A",)], "product_name string")
    assert [M.source_filtered_match(rows, p, s).first().ids for s in (None, "T3", "x")] == ["8,10", "9", ""]
    got = QUERIES["source_filtered_match"](spark, sf_dir).collect()
    assert got and all(len(r.ids.split(",")) == r.matches and r.ids.split(",")[0] == str(r.first_id) if r.matches else r.ids == "" for r in got)


def test_a_name_of_very_many_products(spark):
    """A third of all products and rows have one name: facts go with the rows, products stay a table, and the fingerprint is that of the whole list."""
    p = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("n"), (F.col("id") % 500).cast("string"))).alias("name"), F.lit(None).cast("int").alias("category_id"), F.lit(None).cast("string").alias("category"), F.lit(1).alias("quantity"), F.lit(None).cast("string").alias("unit"), F.lit(0).alias("min_stock_level"), F.lit(None).cast("string").alias("shelf_location"), F.when(F.col("id") == 9, "T3").alias("source"))
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("n"), (F.col("id") % 700).cast("string"))).alias("product_name"), F.lit(2).alias("quantity"), F.lit(False).alias("review_required"), F.lit(None).cast("string").alias("review_message"))
    m = M.match_preview(rows, p, "T3")
    hot = m.where("key = 'hot'").select("match_status", "selected_product_id", "projected_stock", "match_fingerprint", F.array_join("conflict_fields", "|").alias("fields")).distinct().collect()
    assert m.count() == 9_000 and len(hot) == 1 and tuple(hot[0])[:3] == ("Mevcut ürün", 9, 3) and hot[0].fields == "Kaynak"
    items = "".join(f"{i}:Hot:{'T3' if i == 9 else 'null'}:null:null:0:null:1|" for i in range(0, 30_000, 3))
    assert hot[0].match_fingerprint == str(uuid.UUID(bytes=hashlib.md5(("hot|T3|" + items).encode()).digest(), version=3))
    assert not [f.name for f in m.schema if "struct" in f.dataType.simpleString()]
    assert M.matched_products(rows, p).where("key = 'hot'").count() == 10_000


def test_fingerprint_without_source_or_match(spark):
    p = products(spark, {"id": 1, "name": "a", "quantity": 5, "source": None}, {"id": 2, "name": "b", "quantity": 5})
    rows = spark.createDataFrame([("a", 2), ("d", 1), ("b", 1)], "product_name string, quantity int").withColumns({"review_required": F.lit(False), "review_message": F.lit(None).cast("string")})
    got = {r.product_name: r for r in M.match_preview(rows, p, None).collect()}
    assert got["a"].match_status == "Mevcut ürün" and "kaynak null ile" in got["b"].review_message
    assert got["d"].match_fingerprint == str(uuid.UUID(bytes=hashlib.md5(b"d|null|").digest(), version=3))


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"))
    for n in (1, 3, 9):
        got = numbered(df.repartition(5), [F.col("k")], partitions=n)
        assert got.where("row_no <> k + 1").count() == 0 and got.count() == 500


def test_match_preview_states(spark):
    p = products(spark, {"id": 1, "name": "a", "quantity": 5, "source": "T3"}, {"id": 2, "name": "b", "quantity": 1}, {"id": 3, "name": "b", "quantity": 2, "source": "T3"}, {"id": 4, "name": "B", "quantity": 2, "source": "T3"}, {"id": 5, "name": "c", "quantity": 1})
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1), ("", 1), ("a", None)], "product_name string, quantity int").withColumns({"review_required": F.lit(False), "review_message": F.lit(None).cast("string")})
    got = {(r.product_name, r.quantity): (r.match_status, r.resolution_type, r.projected_stock, r.match_review_required) for r in M.match_preview(rows, p, "T3").collect()}
    assert got[("a", 2)] == ("Mevcut ürün", "EXISTING", 7, False)
    assert got[("b", 1)][0] == got[("c", 1)][0] == "Kontrol gerekli"
    assert got[("d", 1)] == ("Yeni ürün", "NEW", None, False)
    assert got[("", 1)] == got[("a", None)] == (None, None, None, False)


def test_matches_come_by_name(spark):
    """Long lists of ids are written once for the rows of a name, which come together, however small the catalogue is."""
    p = spark.range(400).select("id", F.concat(F.lit("Vida "), (F.col("id") % 4).cast("string")).alias("name"))
    rows = spark.range(2000).select(F.col("id").alias("position"), F.concat(F.lit("vida_"), (F.col("id") % 5).cast("string")).alias("product_name"))
    got = M.canonical_match(rows, p)
    keys = got.select("key", "ids", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    runs = [x for k, x in enumerate(keys) if not k or (x.key, x.at) != (keys[k - 1].key, keys[k - 1].at)]
    assert len(runs) == 5 and "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("matches = 100 AND size(split(ids, ',')) = 100").count() == 1600
