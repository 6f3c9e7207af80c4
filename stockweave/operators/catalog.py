"""Catalogue operators: products, categories, users — lookups, filters, checks and set-based changes.

Every operator takes and returns DataFrames. Rejected requests are data: a frame with a `reason`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scalars import IMPORT_SOURCES, canonical_name, java_trim, normalize_source, stock_status, trim_to_null

ALL = "Tümü"


def scan_products(products: DataFrame) -> DataFrame:
    """The whole catalogue with its category as a struct, null when there is none."""
    category = F.when(F.col("category_id").isNotNull(), F.struct(F.col("category_id").alias("id"), F.col("category").alias("name")))
    return products.withColumn("category", category).drop("category_id")


def product_with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """products left join categories on category_id: category_name and category_description."""
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("description").alias("category_description"))
    return products.join(c, "category_id", "left")


def scan_users(users: DataFrame) -> DataFrame:
    return users.drop("password")


def get_by_id(table: DataFrame, key: int, what: str = "row") -> DataFrame:
    """The row of an id; a missing id raises when the row is read, it is never an empty result."""
    hit = table.where(F.col("id") == key)
    n = hit.agg(F.count("*").alias("n"))
    found = F.when(F.col("n") > 0, True).otherwise(F.raise_error(F.lit(f"{what} {key} not found")).cast("boolean"))
    return n.where(found).drop("n").join(hit, F.lit(True), "left")


def search_products(products: DataFrame, q: str, literal: bool = False) -> DataFrame:
    """Substring of name, code or shelf, whatever the case; % and _ in q are wildcards unless literal."""
    if literal:
        hit = lambda c: F.contains(F.lower(c), F.lower(F.lit(q)))
    else:
        hit = lambda c: F.lower(c).like(f"%{q.lower()}%")
    return products.where(hit(F.col("name")) | hit(F.col("code")) | hit(F.col("shelf_location")))


def critical_stock(products: DataFrame) -> DataFrame:
    return products.where("quantity <= min_stock_level")


def with_stock_status(products: DataFrame) -> DataFrame:
    return products.withColumn("status", stock_status(F.col("quantity"), F.col("min_stock_level")))


def filter_products(products: DataFrame, search: str = "", category: str = ALL, source: str = ALL, stock: str = ALL) -> DataFrame:
    """All facets together; the value Tümü leaves a facet out."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(search)))
    out = products.where(has(F.col("name")) | has(F.col("code")))
    if category != ALL:
        out = out.where(F.col("category") == category)
    if source != ALL:
        out = out.where(normalize_source(F.col("source")) == source)
    if stock != ALL:
        out = out.where(stock_status(F.col("quantity"), F.col("min_stock_level")) == stock)
    return out


def search_categories(categories: DataFrame, q: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(q)))
    return categories.where(has(F.col("name")) | has(F.col("description")))


def search_users(users: DataFrame, q: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(c), F.lower(F.lit(q)))
    return users.where(has(F.col("username")) | has(F.col("full_name")))


def category_product_counts(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products of each category, zero included."""
    n = products.where("category_id IS NOT NULL").groupBy("category_id").agg(F.count("*").alias("n"))
    return categories.join(n, F.col("id") == F.col("category_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("product_count"))


def validate_import_source(requests: DataFrame) -> DataFrame:
    """requests (source, ...) with accepted and reason."""
    ok = F.coalesce(F.col("source").isin(*IMPORT_SOURCES), F.lit(False))
    return requests.withColumn("accepted", ok).withColumn("reason", F.when(~ok, F.concat(F.lit("Geçersiz ürün kaynağı: "), F.coalesce("source", F.lit("null")))))


def validate_product_requests(requests: DataFrame) -> DataFrame:
    """requests (name, quantity, min_stock_level, ...) with accepted and the first reason against."""
    reason = F.when(trim_to_null(F.col("name")).isNull(), "name is blank").when(F.col("quantity").isNull(), "quantity is missing").when(F.col("quantity") < 0, "quantity is negative").when(F.col("min_stock_level") < 0, "minimum level is negative")
    return requests.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def taken_by_other(requests: DataFrame, owned: DataFrame, column: str, key: Column | None = None) -> DataFrame:
    """requests (request_id, id, column, ...) whose value another row of owned (id, column) has: duplicates of a code or name. id null: a new row."""
    theirs = owned.select(F.col("id").alias("owner__"), (F.col(column) if key is None else key).alias("value__"))
    mine = requests.withColumn("value__", F.col(column) if key is None else key)
    return mine.join(theirs, (mine["value__"] == theirs["value__"]) & ~mine["id"].eqNullSafe(theirs["owner__"]), "left_semi").drop("value__")


def duplicate_canonical_names(requests: DataFrame, products: DataFrame) -> DataFrame:
    """New products whose canonical name some product has; changes of products are not checked."""
    return taken_by_other(requests.where("id IS NULL"), products, "name", canonical_name(F.col("name")))


def create_products(requests: DataFrame, products: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (request_id, code, name, category_id, quantity, unit, min_stock_level, shelf_location, source) -> (new rows, rejected with reason).

    Blank codes are made from the request's id, so that reruns repeat; unit and minimum level have defaults. Two requests of one code
    or canonical name: the smaller request_id wins.
    """
    code = F.coalesce(trim_to_null(F.col("code")), F.concat(F.lit("PRD-"), F.upper(F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 8))))
    r = validate_product_requests(requests).withColumn("code", code).withColumn("key__", canonical_name(F.col("name")))
    codes = products.where("code IS NOT NULL").select(F.col("code").alias("c__")).distinct()
    names = products.select(canonical_name(F.col("name")).alias("n__")).where("n__ IS NOT NULL").distinct()
    known = categories.select(F.col("id").alias("cat__"))
    r = r.join(codes, F.col("code") == F.col("c__"), "left").join(names, F.col("key__") == F.col("n__"), "left").join(known, F.col("category_id") == F.col("cat__"), "left")
    reason = F.coalesce("reason", F.when(F.col("c__").isNotNull(), "code exists"), F.when(F.col("n__").isNotNull(), "name exists"), F.when(F.col("category_id").isNotNull() & F.col("cat__").isNull(), "category missing"))
    r = r.withColumn("reason", reason)
    first = lambda k: r.where("reason IS NULL").groupBy(F.col(k).alias(f"{k}_f")).agg(F.min("request_id").alias(f"first_{k}"))
    r2 = r.join(first("code"), F.col("code") == F.col("code_f"), "left").join(first("key__"), F.col("key__") == F.col("key___f"), "left")
    late = F.when((F.col("first_code") < F.col("request_id")) | (F.col("first_key__") < F.col("request_id")), "repeated request")
    r2 = r2.withColumn("reason", F.coalesce("reason", late))
    rows = r2.where("reason IS NULL").select("request_id", "code", java_trim(F.col("name")).alias("name"), "category_id", "quantity", F.coalesce("unit", F.lit("Adet")).alias("unit"), F.coalesce("min_stock_level", F.lit(5)).alias("min_stock_level"), "shelf_location", "source")
    return rows, r2.where("reason IS NOT NULL").select("request_id", "reason")


def update_products(requests: DataFrame, products: DataFrame) -> DataFrame:
    """products with requests (id, code, name, category_id, quantity, unit, min_stock_level, shelf_location, source) applied: all fields are
    overwritten, but unit and minimum level stay when the request has none; a null category clears it. One request per id."""
    new = requests.select(F.col("id").alias("id__"), *[F.col(c).alias(f"{c}__") for c in ("code", "name", "category_id", "quantity", "unit", "min_stock_level", "shelf_location", "source")])
    hit = F.col("id__").isNotNull()
    over = {c: F.when(hit, F.col(f"{c}__")).otherwise(F.col(c)) for c in ("code", "name", "category_id", "quantity", "shelf_location", "source")}
    kept = {c: F.coalesce(f"{c}__", c) for c in ("unit", "min_stock_level")}
    return products.join(new, F.col("id") == F.col("id__"), "left").withColumns(over | kept).select("id", "code", "name", "category_id", "quantity", "unit", "min_stock_level", "shelf_location", "source")


def upsert_categories(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """categories after requests (id, name, description): known ids are changed, others added; a request whose name another category keeps is left out."""
    ok = requests.join(taken_by_other(requests, categories, "name").select("id").distinct(), "id", "left_anti")
    new = ok.select(F.col("id").alias("id__"), java_trim(F.col("name")).alias("name__"), F.col("description").alias("description__"))
    both = categories.join(new, F.col("id") == F.col("id__"), "full")
    hit = F.col("id__").isNotNull()
    return both.select(F.coalesce("id__", "id").alias("id"), F.when(hit, F.col("name__")).otherwise(F.col("name")).alias("name"), F.when(hit, F.col("description__")).otherwise(F.col("description")).alias("description"))


def update_user_attributes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """users (id, username, full_name, role) after requests (id null: new, username, full_name, role): a new row's username is trimmed and its role USER by default; a null role keeps the old one. New rows take ids after the largest, by username."""
    changed = requests.where("id IS NOT NULL").select(F.col("id").alias("id__"), *[F.col(c).alias(f"{c}__") for c in ("username", "full_name", "role")])
    old = users.join(changed, F.col("id") == F.col("id__"), "left").select("id", *[F.coalesce(f"{c}__", c).alias(c) for c in ("username", "full_name", "role")])
    new = requests.where("id IS NULL").select(F.lit(None).cast("bigint").alias("id"), java_trim(F.col("username")).alias("username"), "full_name", F.coalesce("role", F.lit("USER")).alias("role"))
    return old.unionByName(new)


def referential_delete_category(products: DataFrame, ids: DataFrame) -> DataFrame:
    """products after the categories of ids (id) are deleted: their category becomes null."""
    gone = ids.select(F.col("id").alias("gone__")).distinct()
    return products.join(gone, F.col("category_id") == F.col("gone__"), "left").withColumn("category_id", F.when(F.col("gone__").isNull(), F.col("category_id"))).drop("gone__")


def referential_delete_product(movements: DataFrame, history: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(movements without those of the deleted products, history with their product_id null)."""
    gone = ids.select(F.col("id").alias("gone__")).distinct()
    rest = movements.join(gone, F.col("product_id") == F.col("gone__"), "left_anti")
    kept = history.join(gone, F.col("product_id") == F.col("gone__"), "left").withColumn("product_id", F.when(F.col("gone__").isNull(), F.col("product_id"))).drop("gone__")
    return rest, kept


def referential_delete_user(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows of movements (created_by) or history (user_id) after users are deleted: the column becomes null."""
    gone = ids.select(F.col("id").alias("gone__")).distinct()
    return rows.join(gone, F.col(column) == F.col("gone__"), "left").withColumn(column, F.when(F.col("gone__").isNull(), F.col(column))).drop("gone__")


def unknown_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    """ids that the table lacks: an error of a delete or lookup."""
    return ids.join(table.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown id"))
