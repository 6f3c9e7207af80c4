"""Consolidation of import rows: one logical row per canonical name, every source row counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scalars import INT_MAX, canonical_name, structural_errors, trim_to_null
from stockweave.sources.shared import stage

#: Minutes that a preview lives.
PREVIEW_MINUTES = 30


def contribution_overlap(first: Column, other: Column) -> Column:
    """How a row's source ids relate to those already counted: contained, overlapping, disjoint; without ids always disjoint."""
    known = (F.size(first) > 0) & (F.size(other) > 0)
    return F.when(known & (F.size(F.array_except(other, first)) == 0), "contained").when(known & F.arrays_overlap(first, other), "overlapping").otherwise("disjoint")


def _clean(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0))


def consolidate_single(rows: DataFrame) -> DataFrame:
    """The common case, one source id per row: rows (position, product_name, quantity, source_identity) -> key, quantity, sources, first_position.

    A repeated id of a group is ignored, the first one's quantity counts. All aggregates merge before their shuffle.
    """
    keyed = rows.withColumn("key", canonical_name(F.col("product_name"))).where("key IS NOT NULL AND quantity IS NOT NULL")
    once = keyed.groupBy("key", "source_identity").agg(F.min_by("quantity", "position").alias("quantity"), F.min("position").alias("position"))
    g = once.groupBy("key").agg(F.sum(F.col("quantity").cast("bigint")).alias("quantity"), F.count("*").alias("sources"), F.min("position").alias("first_position"))
    return g.withColumn("accepted", F.col("quantity") <= INT_MAX)


NONE = "array<string>"
ENTRY = "array<struct<key: string, value: string>>"


def _given(rows: DataFrame, name: str, kind: str) -> Column:
    """A column that rows may lack."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def resolved_ids(rows: DataFrame) -> Column:
    """resolved_source_record_ids and then resolved_source_record_id, each once; rows may lack both."""
    several, one = _given(rows, "resolved_source_record_ids", NONE), _given(rows, "resolved_source_record_id", "string")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(several, F.array().cast(NONE)), F.array(one))))


def contribution_ids(rows: DataFrame) -> Column:
    """What a row counts for: its contributing ids and the ids that it resolves, blanks left out."""
    return _clean(F.array_union(F.coalesce("contributing_source_record_ids", F.array().cast(NONE)), resolved_ids(rows)))


def trusted_names(names: Column) -> Column:
    """Entries of the authoritative names with an id and a name that are not blank, names trimmed."""
    entries = F.map_entries(F.coalesce(names, F.create_map().cast("map<string,string>")))
    kept = F.filter(entries, lambda e: (F.length(F.trim(e["key"])) > 0) & trim_to_null(e["value"]).isNotNull())
    return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), trim_to_null(e["value"]).alias("value")))


#: What a row of members says of its group: an id that it counts for, one that it resolves, an item of a preview, an id with its trusted name.
KINDS = ("source", "resolved", "item", "name")


def _prepared(rows: DataFrame) -> DataFrame:
    """Staged import rows with ids, trusted names, key and own errors, and at__: their order, by position; rows of one position by name and quantity."""
    names = trusted_names(F.col("authoritative_source_product_names"))
    r = rows.withColumns({"ids__": contribution_ids(rows), "resolved__": resolved_ids(rows), "names__": names, "items__": _clean(F.col("preview_item_ids")), "quantity": F.col("quantity").cast("bigint")})
    canonical = F.array_distinct(F.filter(F.transform("names__", lambda e: canonical_name(e["value"])), lambda x: x.isNotNull()))
    foreign = F.size(F.array_except(F.transform("names__", lambda e: e["key"]), F.col("ids__"))) > 0
    named = F.size("names__") > 0
    r = r.withColumn("error__", F.when(named & foreign, "a trusted name is of no source row of this row").when(named & (F.size(canonical) != 1), "two trusted names in one row"))
    r = r.withColumn("product_name", F.when(named & F.col("error__").isNull(), F.get("names__", F.lit(0))["value"]).otherwise(F.col("product_name")))
    r = r.withColumn("key", canonical_name(trim_to_null(F.col("product_name"))))
    through = F.coalesce("source_identity_review_required", F.lit(False)) | F.col("key").isNull() | F.col("quantity").isNull() | F.col("error__").isNotNull()
    at = F.struct("position", "product_name", "quantity", F.monotonically_increasing_id().alias("row"))
    return stage(r.select("position", "key", "product_name", "quantity", "ids__", "resolved__", "names__", "items__", "error__", through.alias("through__"), at.alias("at__")), "consolidate")


def consolidate_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows as for consolidate_import -> (groups, members); no list is built, so a group may have any number of rows.

    groups: first_position, key, product_name, quantity, sources (distinct ids), members, error, passed_through. members: first_position, kind (one of KINDS), id, value (a trusted name), position and place
    of its first occurrence: each once per group.
    """
    groups, members, _ = _groups(_prepared(rows))
    return groups, members


def _groups(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, members of the groups alone by key).

    A row is decided by where its ids first occur in its group: before it all of them (contained: it adds nothing), some (an error of the group) or none. A contained row brings no new id
    and every other brings all of its own, so the first occurrences are least positions, whatever was decided about the rows between: an aggregate that merges before its shuffle.
    """
    good = r.where("NOT through__")
    entry = lambda kind, ids: F.transform(ids, lambda x, k: F.struct(F.lit(kind).alias("kind"), x.alias("id"), F.lit(None).cast("string").alias("value"), k.alias("place")))
    trusted = F.transform("names__", lambda e, k: F.struct(F.lit("name").alias("kind"), e["key"].alias("id"), e["value"].alias("value"), k.alias("place")))
    entries = F.concat(entry("source", F.col("ids__")), entry("resolved", F.col("resolved__")), entry("item", F.col("items__")), trusted)
    given = good.select("key", "at__", F.explode(entries).alias("e")).select("key", "at__", "e.*")
    first = stage(given.groupBy("key", "kind", "id").agg(F.min(F.struct("at__", "place")).alias("first"), F.min_by("value", F.struct("at__", "place")).alias("value"), F.count("*").alias("n")), "members")
    # rows that hold an id which an earlier row has; only ids of several rows are joined back
    again = first.where("kind = 'source' AND n > 1").select("key", "id", "first.at__")
    uses = good.select("key", "at__", F.explode("ids__").alias("id"))
    late = uses.join(again.withColumnRenamed("at__", "first_at"), ["key", "id"]).where("first_at < at__").groupBy("key", "at__").agg(F.count("*").alias("earlier"))
    decided = good.join(late, ["key", "at__"], "left").withColumn("earlier", F.coalesce("earlier", F.lit(0)))
    contained = (F.col("earlier") > 0) & (F.col("earlier") == F.size("ids__"))
    overlapping = (F.col("earlier") > 0) & (F.col("earlier") < F.size("ids__"))
    g = decided.groupBy("key").agg(F.min("at__").alias("first_at"), F.sum(F.when(contained, 0).otherwise(F.col("quantity"))).alias("quantity"), F.count("*").alias("members"), F.min(F.when(overlapping, F.col("at__"))).alias("overlap_at"))
    # the first row that gives an id another name than the id's first row
    other = given.where("kind = 'name'").groupBy("key", "id", "value").agg(F.min("at__").alias("at__"))
    names = first.where("kind = 'name' AND n > 1").select("key", "id", F.col("value").alias("first_value"))
    clash = other.join(names, ["key", "id"]).where("value <> first_value").groupBy("key").agg(F.min("at__").alias("clash_at"))
    counts = first.where("kind = 'source'").groupBy("key").agg(F.count("*").alias("sources"))
    j = g.join(counts, "key", "left").join(clash, "key", "left")
    twice = F.when(F.col("overlap_at").isNotNull() & (F.col("clash_at").isNull() | (F.col("overlap_at") <= F.col("clash_at"))), "a source row contributes twice")
    error = F.coalesce(twice, F.when(F.col("clash_at").isNotNull(), "a source row has two names"), F.when(F.col("quantity") > INT_MAX, "quantity beyond int"))
    groups = j.select("first_at.position", "key", "first_at.product_name", "quantity", F.coalesce("sources", F.lit(0)).alias("sources"), "members", error.alias("error"), F.lit(False).alias("passed_through")).withColumnRenamed("position", "first_position")
    rest = r.where("through__")
    alone = rest.select(F.col("position").alias("first_position"), "key", "product_name", "quantity", F.size("ids__").cast("bigint").alias("sources"), F.lit(1).cast("bigint").alias("members"), F.col("error__").alias("error"), F.lit(True).alias("passed_through"))
    own = first.select("key", "kind", "id", "value", "first.at__", "first.place")
    of_groups = own.join(g.select("key", F.col("first_at.position").alias("first_position")), "key").select("first_position", "kind", "id", "value", "at__.position", "place")
    of_rest = rest.select(F.col("position").alias("first_position"), F.explode(entries).alias("e"), "position").select("first_position", "e.kind", "e.id", "e.value", "position", "e.place")
    return groups.unionByName(alone), of_groups.unionByName(of_rest), own


def consolidate_import(rows: DataFrame) -> DataFrame:
    """rows (position, product_name, quantity, contributing_source_record_ids, authoritative_source_product_names, preview_item_ids, source_identity_review_required, and maybe resolved_source_record_ids, resolved_source_record_id)
    -> one row per group, then the rows that pass through (identity review, no key or no quantity, or in error by themselves): first_position, key, product_name, quantity, source_ids, resolved_ids, names, item_ids, members, error, passed_through.

    A row counts for its contributing and its resolved ids. Its trusted names must be of such ids, and have one canonical name, which goes before its own; else it is in error.
    In a group, in order, a row whose ids are all counted already adds nothing, one that overlaps them in part, or that gives an id another name, is an
    error of the group, any other is added. The lists are built last, of distinct ids; consolidate_groups gives them as rows, for groups whose lists would be too long for one.
    """
    r = _prepared(rows)
    groups, _, own = _groups(r)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at__", "place", "id", "value")))), lambda x: x["id"])
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "name", F.struct("at__", "place", "id", "value")))), lambda x: F.struct(x["id"].alias("key"), x["value"].alias("value")))
    lists = own.groupBy("key").agg(listed("source").alias("source_ids"), listed("resolved").alias("resolved_ids"), named.alias("names"), listed("item").alias("item_ids"))
    none = {"source_ids": F.array().cast(NONE), "resolved_ids": F.array().cast(NONE), "names": F.array().cast(ENTRY), "item_ids": F.array().cast(NONE)}
    columns = ["first_position", "key", "product_name", "quantity", *none, "members", "error", "passed_through"]
    out = groups.where("NOT passed_through").join(lists, "key", "left").withColumns({c: F.coalesce(c, e) for c, e in none.items()}).select(*columns)
    rest = r.where("through__").select(F.col("position").alias("first_position"), "key", "product_name", "quantity", F.col("ids__").alias("source_ids"), F.col("resolved__").alias("resolved_ids"), F.col("names__").alias("names"), F.col("items__").alias("item_ids"), F.lit(1).cast("bigint").alias("members"), F.col("error__").alias("error"), F.lit(True).alias("passed_through"))
    return out.unionByName(rest)


def validate_provenance(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_id and problem for every trusted id (a key of authoritative names) that was lost, appeared, or is in more than one row after consolidation. Empty: provenance holds.

    after: rows of consolidate_import, or members of consolidate_groups.
    """
    trusted = before.select(F.explode(F.transform(trusted_names(F.col("authoritative_source_product_names")), lambda e: e["key"])).alias("source_id")).distinct().withColumn("was", F.lit(True))
    held = after.where("kind = 'name'").select(F.col("id").alias("source_id")) if "kind" in after.columns else after.select(F.explode(F.array_distinct("names.key")).alias("source_id"))
    now = held.groupBy("source_id").agg(F.count("*").alias("rows"))
    problem = F.when(F.col("rows").isNull(), "lost").when(F.col("was").isNull(), "unknown").when(F.col("rows") > 1, "counted more than once")
    return trusted.join(now, "source_id", "full").select("source_id", problem.alias("problem")).where("problem IS NOT NULL")


def consolidation_stats(consolidated: DataFrame) -> DataFrame:
    """Physical contributions, logical rows, groups of several sources, rows saved by them. consolidated: rows of consolidate_import, or groups of consolidate_groups."""
    n = F.col("sources") if "sources" in consolidated.columns else F.size("source_ids")
    return consolidated.agg(F.sum(n).alias("physical_contributions"), F.count("*").alias("logical_rows"), F.count_if(n > 1).alias("multi_source_groups"), F.sum(F.greatest(n - 1, F.lit(0))).alias("rows_reduced"))


def unresolved_gaps(gaps: DataFrame, rows: DataFrame) -> DataFrame:
    """gaps (id, ...) that no row claims in resolved_source_record_id or resolved_source_record_ids."""
    claimed = rows.select(F.explode(F.concat(F.array("resolved_source_record_id"), F.coalesce("resolved_source_record_ids", F.array().cast("array<string>")))).alias("id")).where("id <> ''").distinct()
    return gaps.join(claimed, "id", "left_anti")


def gap_coverage(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """id and problem: claimed but unknown, known but not claimed, or claimed by several rows; a row's repeats of an id count once."""
    every = F.array_distinct(F.filter(F.concat(F.array("resolved_source_record_id"), F.coalesce("resolved_source_record_ids", F.array().cast("array<string>"))), lambda x: F.length(F.trim(x)) > 0))
    claims = rows.select(F.explode(every).alias("id")).groupBy("id").agg(F.count("*").alias("claims"))
    known = gaps.select("id").distinct().withColumn("known", F.lit(True))
    problem = F.when(F.col("known").isNull(), "unexpected").when(F.col("claims").isNull(), "missing").when(F.col("claims") != 1, "duplicate")
    return known.join(claims, "id", "full").select("id", problem.alias("problem")).where("problem IS NOT NULL")


def can_confirm_import(rows: DataFrame, gaps: DataFrame, preview_id: str | None, source: str | None) -> DataFrame:
    """One row, can_confirm: a session and source, at least a row, no open gap, and every row valid, without error or review, resolved."""
    fine = F.col("is_valid") & (F.coalesce("error_message", F.lit("")) == "") & ~F.col("review_required") & (F.coalesce("resolution_type", F.lit("")) != "")
    r = rows.agg(F.count("*").alias("rows"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"))
    g = unresolved_gaps(gaps, rows).agg(F.count("*").alias("open_gaps"))
    return r.join(F.broadcast(g), F.lit(True)).select((F.lit(bool(preview_id) and bool(source)) & (F.col("rows") > 0) & F.coalesce("fine", F.lit(False)) & (F.col("open_gaps") == 0)).alias("can_confirm"))


def preview_counts(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    invalid = ((F.coalesce("error_message", F.lit("")) != "") | ~F.col("is_valid")) & ~F.col("review_required")
    r = rows.agg(F.count_if(invalid).alias("invalid"), F.count_if("review_required").alias("review"), F.count("*").alias("products"))
    return r.join(F.broadcast(gaps.agg(F.count("*").alias("unresolved"))), F.lit(True))


def register_preview_snapshot(rows: DataFrame, preview_id: str, now: Column) -> DataFrame:
    """What may not change until confirmation: a row per import row with its item id, quantity, ids, names, gaps, review flag, lock and expiry."""
    gaps = F.array_distinct(F.filter(F.concat(F.array("resolved_source_record_id"), F.coalesce("resolved_source_record_ids", F.array().cast("array<string>"))), lambda x: F.length(F.trim(x)) > 0))
    ids = _clean(F.col("contributing_source_record_ids"))
    return rows.select(
        F.lit(preview_id).alias("preview_id"), F.concat(F.lit("item-"), F.col("position").cast("string")).alias("item_id"), F.col("quantity").alias("imported_quantity"), ids.alias("contribution_ids"),
        F.map_entries(F.coalesce("authoritative_source_product_names", F.create_map().cast("map<string,string>"))).alias("authoritative_names"), gaps.alias("gap_ids"), F.col("source_identity_review_required").alias("review_required"),
        ((F.size(ids) > 0) | (F.size(gaps) > 0)).alias("locked"), (now + F.expr(f"INTERVAL {PREVIEW_MINUTES} MINUTES")).alias("expires_at"),
    )


def active_previews(snapshot: DataFrame, now: Column) -> DataFrame:
    return snapshot.where(F.col("expires_at") > now)


def restore_preview(submitted: DataFrame, snapshot: DataFrame, gaps: DataFrame) -> DataFrame:
    """submitted (row_id, quantity, preview_item_ids, resolved_source_record_ids) -> row_id, quantity, contribution_ids, gap_ids, review_required, reason (null: accepted).

    Every item must be known and submitted once. The quantity is the sum of the items' (null if one has none) and may change only for a single
    unlocked item. A row without items is accepted for exactly one registered gap. Conflicting names of an id are an error.
    """
    items = submitted.select("row_id", F.explode(F.filter(F.coalesce("preview_item_ids", F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)).alias("item_id"))
    times = items.groupBy("item_id").agg(F.count("*").alias("times"))
    j = items.join(times, "item_id").join(snapshot, "item_id", "left")
    names = F.flatten(F.collect_list("authoritative_names"))
    per = j.groupBy("row_id").agg(F.count("*").alias("items"), F.count_if(F.col("preview_id").isNull()).alias("unknown"), F.max("times").alias("times"), F.when(F.count("imported_quantity") == F.count("*"), F.sum(F.col("imported_quantity").cast("bigint"))).alias("total"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("contribution_ids")))).alias("contribution_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gap_ids")))).alias("gap_ids"), F.coalesce(F.bool_or("review_required"), F.lit(False)).alias("review_required"),
        F.coalesce(F.bool_and("locked"), F.lit(True)).alias("locked"), (F.size(F.array_distinct(names)) > F.size(F.array_distinct(F.transform(names, lambda e: e["key"])))).alias("two_names"))
    known = gaps.select(F.col("id").alias("gap__")).distinct()
    manual = submitted.where(F.size(F.coalesce("preview_item_ids", F.array().cast("array<string>"))) == 0).select("row_id", _clean(F.col("resolved_source_record_ids")).alias("claims")).withColumn("gap__", F.when(F.size("claims") == 1, F.get("claims", F.lit(0))))
    manual = manual.join(known.withColumn("has_gap", F.lit(True)), "gap__", "left").select(F.col("row_id").alias("manual__"), "has_gap", F.col("claims").alias("manual_gaps"))
    s = submitted.join(per, "row_id", "left").join(manual, F.col("row_id") == F.col("manual__"), "left")
    free = ~F.col("locked") & (F.col("items") == 1)
    reason = F.when(F.col("items").isNull(), F.when(F.col("has_gap").isNull(), "no item and no single known gap")).when(F.col("unknown") > 0, "unknown item").when(F.col("times") > 1, "item submitted twice").when(F.col("two_names"), "a source row has two names").when(F.col("total") > INT_MAX, "quantity beyond int").when(~free & ~F.col("quantity").cast("bigint").eqNullSafe(F.col("total")), "quantity was changed")
    none = F.array().cast("array<string>")
    return s.select("row_id", "quantity", F.coalesce("contribution_ids", none).alias("contribution_ids"), F.coalesce("gap_ids", "manual_gaps", none).alias("gap_ids"), F.coalesce("review_required", F.lit(False)).alias("review_required"), reason.alias("reason"))


def confirmed_row_errors(rows: DataFrame) -> DataFrame:
    """rows with error: the first rule that a row to be confirmed breaks — structure, changed quantity, changed name, match review, review, validity."""
    errors = structural_errors(F.col("product_name"), F.col("product_code"), F.col("quantity"), F.col("price"))
    error = F.when(F.size(errors) > 0, F.array_join(errors, "; ")).when(F.col("imported_quantity").isNotNull() & (F.col("imported_quantity") != F.col("quantity")), "quantity was changed").when(F.col("canonical_name").isNotNull() & ~F.col("canonical_name").eqNullSafe(canonical_name(F.col("product_name"))), "name was changed").when(F.col("match_review_required"), "match is open").when(F.col("review_required"), "name is to be reviewed").when(~F.col("is_valid"), "row is invalid")
    return rows.withColumn("error", error)
