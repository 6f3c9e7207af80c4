"""Matching import rows to the catalogue by canonical name, and what a group of matches means."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scalars import INT_MAX, canonical_name, fingerprint_item, historical_summary, name_uuid, trim_to_null

# Conflict fields in order, the placeholder for blanks, states of a preview row.
UNSTATED = "Belirtilmemiş"
CONFLICTS = (("Kategori", "category_id", "category"), ("Kaynak", "source", "source"), ("Birim", "unit", "unit"), ("Minimum stok", "min_stock_level", "min_stock_level"), ("Raf konumu", "shelf_location", "shelf_location"))
STATUS = {"new": "Yeni ürün", "existing": "Mevcut ürün", "review": "Kontrol gerekli"}
FIELDS = ("id", "name", "category_id", "category", "quantity", "unit", "min_stock_level", "shelf_location", "source")


def _named(source: str | None) -> str:
    """The source in messages and fingerprints, where null prints as null."""
    return "null" if source is None else source


def keyed_products(products: DataFrame) -> DataFrame:
    """products with key, their canonical name; products without one match nothing and are left out."""
    return products.withColumn("key", canonical_name(F.col("name"))).where("key IS NOT NULL")


def canonical_match(rows: DataFrame, products: DataFrame, name: str = "product_name") -> DataFrame:
    """rows with key, matches, first_id (the least id that matches) and ids (of all products that match, ascending, joined by commas; empty if none); a null key matches nothing.

    Facts of a name are aggregates that merge before their shuffle; the list of ids is made once a name, not once a row. The products' other fields stay a table by key: matched_products.
    Rows come sorted by key, with each key in one task (a skewed one in a few): a written file then holds a long list once for all rows that have it, where lists in the order of the
    rows would be written again and again. So this join is never a broadcast.
    """
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    facts = keyed_products(products).groupBy(F.col("key").alias("key__")).agg(F.count("*").alias("matches"), F.min("id").alias("first_id"), ids.alias("ids"))
    keyed = rows.withColumn("key", canonical_name(F.col(name)))
    joined = keyed.join(facts.hint("merge"), F.col("key") == F.col("key__"), "left")
    return joined.withColumns({"matches": F.coalesce("matches", F.lit(0)), "ids": F.coalesce("ids", F.lit(""))}).drop("key__")


def source_filtered_match(rows: DataFrame, products: DataFrame, source: str | None, name: str = "product_name") -> DataFrame:
    """As canonical_match, of the products of exactly the selected source, null matching null."""
    return canonical_match(rows, products.where(F.col("source").eqNullSafe(F.lit(source))), name)


def matched_products(rows: DataFrame, products: DataFrame, name: str = "product_name") -> DataFrame:
    """key, FIELDS and summary of every product that some row matches, each product once however many rows have its name."""
    asked = rows.select(canonical_name(F.col(name)).alias("key")).where("key IS NOT NULL").distinct()
    members = keyed_products(products).select("key", *FIELDS, historical_summary(F.col("name"), F.col("source"), F.col("unit"), F.col("quantity")).alias("summary"))
    return members.join(asked, "key", "left_semi")


def fingerprints(products: DataFrame, source: str | None) -> DataFrame:
    """key, fingerprint: the version-3 UUID over key, source and every product of the name, in id order.

    A digest in a stated order is sequential, so a name is one task; but its products stream by, sorted by Spark, which spills, and only the digest is kept.
    """
    head = f"|{_named(source)}|"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, out = [], []
            for k, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if digest:
                        keys.append(key)
                        out.append(str(uuid.UUID(bytes=digest.digest(), version=3)))
                    key, digest = k, hashlib.md5((k + head).encode(), usedforsecurity=False)
                digest.update(item.encode())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "fingerprint"])
        if digest:
            yield pa.record_batch([pa.array([key]), pa.array([str(uuid.UUID(bytes=digest.digest(), version=3))])], names=["key", "fingerprint"])

    p = keyed_products(products)
    items = p.select("key", "id", fingerprint_item({c: F.col(c) for c in p.columns}).alias("item")).repartition("key").sortWithinPartitions("key", "id", "item")
    return items.select("key", "item").mapInArrow(run, "key string, fingerprint string")


def group_facts(products: DataFrame, source: str | None) -> DataFrame:
    """key__, n_all, n_own (products of the source, null matching null), own_id and own_stock (of the only one, where n_own is 1), printed (fingerprint): per canonical name."""
    own = F.col("source").eqNullSafe(F.lit(source))
    counts = keyed_products(products).groupBy("key").agg(F.count("*").alias("n_all"), F.count_if(own).alias("n_own"), F.min(F.when(own, F.col("id"))).alias("own_id"), F.min(F.when(own, F.col("quantity"))).alias("own_stock"))
    return counts.join(fingerprints(products, source), "key", "left").withColumnsRenamed({"key": "key__", "fingerprint": "printed"})


def no_match(source: str | None) -> Column:
    """The fingerprint of a name that nothing in the catalogue has."""
    return name_uuid(F.concat(F.coalesce("key", F.lit("null")), F.lit(f"|{_named(source)}|")))


def match_group_resolution(products: DataFrame) -> DataFrame:
    """Per canonical name: matches, safe (no field has two values, null being one), target_id (least id) and total stock of safe groups; a total beyond int is not safe.

    One pass of mergeable aggregates: a value set of at most two would do, so sizes are compared through min, max and nulls.
    """
    keyed = keyed_products(products)
    one_value = lambda c: F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))
    safe = one_value("category_id")
    for _, c, _ in CONFLICTS[1:]:
        safe = safe & one_value(c)
    g = keyed.groupBy("key").agg(F.count("*").alias("matches"), safe.alias("alike"), F.min("id").alias("least_id"), F.sum(F.col("quantity").cast("bigint")).alias("stock"))
    ok = F.col("alike") & (F.col("stock") <= INT_MAX)
    return g.select("key", "matches", ok.alias("safe"), F.when(ok, F.col("least_id")).alias("target_id"), F.when(ok, F.col("stock")).otherwise(0).alias("total_stock"))


def conflict_sentence(conflicts: Column) -> Column:
    names = F.transform(conflicts, lambda c: c["field"])
    n = F.size(conflicts)
    many = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" ve "), F.element_at(names, -1), F.lit(" farklı."))
    one = F.concat(F.get(names, F.lit(0)), F.lit(" farklı: "), F.array_join(F.get(conflicts, F.lit(0))["values"], " / "))
    return F.when(n == 1, one).when(n > 1, many)


def conflict_values(products: DataFrame) -> DataFrame:
    """key, place (of the field in CONFLICTS), field, value, first_id: a row for every distinct value, as shown, of a field in which the products of a name differ; a blank is a value.

    All by aggregates that merge before their shuffle: no list of a name's products is built.
    """
    keyed = keyed_products(products)
    shown = lambda c: F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.col(c).cast("string")).otherwise(UNSTATED)
    each = [F.struct(F.lit(n).alias("place"), F.lit(field).alias("field"), F.col(identity).cast("string").alias("identity"), shown(text).alias("value")) for n, (field, identity, text) in enumerate(CONFLICTS)]
    values = keyed.select("key", "id", F.explode(F.array(*each)).alias("f")).select("key", "id", "f.*").groupBy("key", "place", "field", "identity", "value").agg(F.min("id").alias("first_id"))
    # from here on a row per distinct value
    of_field = values.groupBy("key", "place").agg(F.min("identity").alias("least"), F.max("identity").alias("most"), F.count("identity").alias("stated"), F.count("*").alias("all"))
    differ = of_field.where("least <> most OR (stated > 0 AND stated < all)").select("key", "place")
    return values.join(differ, ["key", "place"], "left_semi").groupBy("key", "place", "field", "value").agg(F.min("first_id").alias("first_id"))


def match_conflict_details(products: DataFrame) -> DataFrame:
    """key, fields, message of every group that differs. A message lists values only where a single field differs; each once, in the order of the least id that has it."""
    v = conflict_values(products)
    fields = v.groupBy("key", "place", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "value"))), lambda x: x["value"]).alias("values"))
    c = fields.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "field", "values"))), lambda x: F.struct(x["field"].alias("field"), x["values"].alias("values"))).alias("conflicts"))
    return c.select("key", F.transform("conflicts", lambda x: x["field"]).alias("fields"), conflict_sentence(F.col("conflicts")).alias("message"))


def match_preview(rows: DataFrame, products: DataFrame, source: str) -> DataFrame:
    """rows (product_name, quantity, review_required, review_message, ...) with the match of the selected source.

    Rows without name or positive quantity are passed through unmatched. No match: new. One match in the source: existing, with its stock and
    the projected one. Otherwise a review with its reason; a review that the document asked for stays beside it. Rows carry key, facts of its group and conflicts;
    the matches themselves, with their summaries, are matched_products, by key.
    """
    eligible = trim_to_null(F.col("product_name")).isNotNull() & F.coalesce(F.col("quantity") >= 1, F.lit(False))
    keyed = rows.withColumn("key", canonical_name(F.col("product_name"))).withColumn("eligible", eligible)
    conflicts = match_conflict_details(products).select(F.col("key").alias("key__"), F.col("fields").alias("conflict_fields"), F.col("message").alias("conflict_message"))
    facts = group_facts(products, source).join(conflicts, "key__", "left")
    m = keyed.join(facts, F.col("key") == F.col("key__"), "left").withColumns({
        "n_all": F.coalesce("n_all", F.lit(0)), "n_own": F.coalesce("n_own", F.lit(0)), "printed": F.coalesce("printed", no_match(source)), "conflict_fields": F.coalesce("conflict_fields", F.array().cast("array<string>")),
    })
    fresh, one = F.col("n_all") == 0, F.col("n_own") == 1
    state = F.when(~F.col("eligible"), None).when(fresh, "new").when(one, "existing").otherwise("review")
    m = m.withColumn("state", state)
    target = lambda c: F.when(F.col("state") == "existing", F.col(c))
    none_own = F.concat(F.lit("Bu ürün adıyla mevcut kayıtlar bulundu ancak seçilen kaynak "), F.lit(_named(source)), F.lit(" ile eşleşen kayıt yok."))
    many_own = F.concat(F.lit("Seçilen kaynak "), F.lit(_named(source)), F.lit(" için "), F.col("n_own").cast("string"), F.lit(" mevcut kayıt bulundu; hedef kayıt seçilmelidir."))
    review = F.col("state") == "review"
    return m.withColumns({
        "match_status": F.when(F.col("state") == "new", STATUS["new"]).when(F.col("state") == "existing", STATUS["existing"]).when(review, STATUS["review"]),
        "resolution_type": F.when(F.col("state") == "new", "NEW").when(F.col("state") == "existing", "EXISTING"),
        "selected_product_id": target("own_id"),
        "existing_stock": target("own_stock"),
        "projected_stock": target("own_stock").cast("bigint") + F.col("quantity"),
        "match_review_required": F.coalesce(review, F.lit(False)),
        "document_review_required": F.col("review_required"),
        "review_message": F.when(review, F.when(F.col("n_own") == 0, none_own).otherwise(many_own)).otherwise(F.col("review_message")),
        "review_required": F.col("review_required") | F.coalesce(review, F.lit(False)),
        "match_fingerprint": F.when(F.col("eligible"), F.col("printed")),
    }).drop("eligible", "own_id", "own_stock", "state", "n_all", "n_own", "printed", "key__")


def manual_resolution_options(products: DataFrame, source: str | None) -> DataFrame:
    """key, id, allow_new: what a user may choose for a name. Products of the selected source if there are any; else all of them, and a new product."""
    p = keyed_products(products).select("key", "id", F.col("source").eqNullSafe(F.lit(source)).alias("own"))
    groups = p.groupBy("key").agg((F.count_if("own") == 0).alias("allow_new"))
    return p.join(groups, "key").where("own OR allow_new").select("key", "id", "allow_new")
