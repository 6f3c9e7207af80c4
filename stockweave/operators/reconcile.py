"""Reconciling what a model extracted with the rows and records of its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockweave.functions.scalars import INT_MAX, MAX_NAME, alignment_key, bound, coerce_price, coerce_quantity, java_trim, review_message_160, suspicion, suspicion_message, suspicion_rules, trim_to_null
from stockweave.sources.shared import stage

from .ordering import BROADCAST_BYTES, numbered_within

# Review messages.
NO_IDENTITY = "Kaynak Excel satırı tek ve güvenilir biçimde belirlenemedi."
NAME_TOO_LONG = "Kaynak ürün adı izin verilen uzunluğu aşıyor; manuel kontrol gerekli."
BAD_CORRECTION = "Önerilen ürün adı güvenilir bulunamadı; manuel kontrol gerekli."


def extraction_json(responses: DataFrame) -> DataFrame:
    """responses (chunk_id, response) -> chunk_id, position, source_record_id, product_code, product_name, quantity, raw_quantity, price, malformed.

    Markdown fences go, and what stands outside the first [ and last ]. A response that is blank, has no array, or holds an integer beyond int
    gives one malformed row; an empty array none. A response is one pass: it is parsed once, and its rows are made within it, without a shuffle.
    """
    of = lambda item, k, kind: F.try_variant_get(item, f"$.{k}", kind)
    text = lambda item, k: bound(java_trim(of(item, k, "string")), lambda t: F.when(t != "", t))
    kinds = {"position": "int", "source_record_id": "string", "product_code": "string", "product_name": "string", "quantity": "int", "raw_quantity": "string", "price": "decimal(38,18)", "malformed": "boolean"}
    row = lambda *values: F.struct(*[x.cast(kind).alias(name) for x, (name, kind) in zip(values, kinds.items(), strict=True)])

    def array(clean: Column) -> Column:
        lo, hi = F.instr(clean, "["), F.length(clean) + 1 - F.instr(F.reverse(clean), "]")
        return F.when((lo > 0) & F.contains(clean, F.lit("]")) & (hi > lo), F.substring(clean, lo, hi - lo + 1))

    def big(item: Column) -> Column:
        whole = of(item, "quantity", "bigint")
        return F.coalesce((F.schema_of_variant(of(item, "quantity", "variant")) == "BIGINT") & ((whole > INT_MAX) | (whole < -INT_MAX - 1)), F.lit(False))

    def read(item: Column, position: Column) -> Column:
        quantity = bound(of(item, "quantity", "variant"), coerce_quantity)
        return row(position, text(item, "sourceRecordId"), text(item, "productCode"), text(item, "productName"), quantity, F.coalesce(of(item, "quantity", "string"), F.lit("null")), coerce_price(of(item, "price", "string")), F.lit(False))

    none = F.lit(None)
    malformed = F.array(row(*[none] * 7, F.lit(True)))
    rows = lambda items: F.when(items.isNull() | F.exists(items, big), malformed).otherwise(F.transform(items, read))
    clean = F.regexp_replace(F.coalesce("response", F.lit("")), r"```(?:json)?\s*", "")
    items = F.try_variant_get(F.try_parse_json(bound(clean, array)), "$", "array<variant>")
    return responses.select("chunk_id", F.explode(bound(items, rows)).alias("row")).select("chunk_id", "row.*")


def assign_source_identity(extracted: DataFrame, sources: DataFrame) -> DataFrame:
    """extracted (chunk_id, position, source_record_id, product_name, quantity) with source_identity or identity_review.

    sources (chunk_id, source_identity, product_name, quantity). A supplied reference must name exactly one source row of the chunk; without one, equal names
    (by alignment key) and quantities must. A chunk is what one answer was asked for, so it is one task: rows and sources of a chunk meet in windows, on a single shuffle.
    """
    asked = {"k__": alignment_key(F.col("product_name")), "q__": F.col("quantity")}
    s = sources.select("chunk_id", F.col("source_identity").alias("s__"), *[c.alias(k) for k, c in asked.items()], F.lit(True).alias("source__"))
    e = extracted.withColumns({"s__": trim_to_null(F.col("source_record_id")), **asked, "source__": F.lit(False)})
    both = e.unionByName(s, allowMissingColumns=True).repartition("chunk_id")
    source = F.col("source__")
    refs, names = Window.partitionBy("chunk_id", "s__"), Window.partitionBy("chunk_id", "k__", "q__")
    both = both.withColumn("ref_hits", F.count_if(source).over(refs)).withColumn("name_hits", F.count_if(source).over(names)).withColumn("named", F.min(F.when(source, F.col("s__"))).over(names))
    by_name = F.when(F.col("k__").isNotNull() & F.col("q__").isNotNull() & (F.col("name_hits") == 1), F.col("named"))
    found = F.when(F.col("s__").isNotNull(), F.when(F.col("ref_hits") == 1, F.col("s__"))).otherwise(by_name)
    out = both.where(~source).withColumn("source_identity", found).withColumn("identity_review", F.col("source_identity").isNull())
    return out.withColumn("review_message", F.when(F.col("identity_review"), NO_IDENTITY)).drop("s__", "k__", "q__", "source__", "ref_hits", "name_hits", "named")


def reconcile_source_rows(sources: DataFrame, extracted: DataFrame, code_absent: DataFrame) -> DataFrame:
    """A row per trusted source row, in its spelling and quantity, with the code and price of the first extracted row of its identity.

    sources (chunk_id, position, source_identity, product_name, quantity); extracted (chunk_id, position, source_identity, product_code, price, identity_review); code_absent (chunk_id, code_absent).
    Source rows that nothing matched are recovered only where the header has no code field. Chunks with a source row without name or
    positive quantity are left as they are, so they give no rows here. A chunk is one task, as in assign_source_identity.
    """
    good = trim_to_null(F.col("product_name")).isNotNull() & F.coalesce(F.col("quantity") >= 1, F.lit(False))
    s = sources.select("chunk_id", "source_identity", "position", "product_name", "quantity", good.alias("good__"))
    e = extracted.where("NOT identity_review AND source_identity IS NOT NULL").select("chunk_id", "source_identity", F.struct("position", "product_code", "price").alias("x__"))
    both = s.unionByName(e, allowMissingColumns=True).repartition("chunk_id")
    same, chunk = Window.partitionBy("chunk_id", "source_identity"), Window.partitionBy("chunk_id")
    both = both.withColumn("representations", F.count("x__").over(same)).withColumn("x", F.min("x__").over(same)).withColumn("good", F.bool_and("good__").over(chunk))
    j = both.where("good__ IS NOT NULL AND good").join(code_absent, "chunk_id").where("representations > 0 OR code_absent")
    return j.select("chunk_id", "position", "source_identity", "product_name", "quantity", F.col("x.product_code").alias("product_code"), F.col("x.price").alias("price"), (F.col("representations") == 0).alias("recovered"), F.greatest(F.col("representations") - 1, F.lit(0)).alias("duplicates"))


def chunk_completeness(chunks: DataFrame, extracted: DataFrame, strict: bool = False) -> DataFrame:
    """chunks (chunk_id, source_type, expected, trusted, confidence) and extracted (chunk_id, source_identity, error_message) -> extracted, severe, gap, distance.

    A sheet chunk with trusted rows counts distinct source ids, others rows. Strict mode looks at every sheet chunk with trusted rows that expects any, and wants equality and no error.
    """
    filled = F.when(F.length(F.trim("source_identity")) > 0, F.col("source_identity"))
    n = extracted.groupBy("chunk_id").agg(F.count("*").alias("rows"), F.count_distinct(filled).alias("ids"), F.bool_or(F.coalesce(F.length(F.trim("error_message")) > 0, F.lit(False))).alias("hard"))
    j = chunks.join(n, "chunk_id", "left").fillna({"rows": 0, "ids": 0, "hard": False})
    sheet, page = F.col("source_type") == "XLSX", F.col("source_type") == "PDF"
    got = F.when(sheet & F.col("trusted"), F.col("ids")).otherwise(F.col("rows"))
    j = j.withColumn("extracted", got)
    exp, got = F.col("expected"), F.col("extracted")
    look = F.lit(strict) & F.col("trusted") & (exp > 0)
    evidence = (sheet & ((exp >= 5) | look)) | (page & (exp > 0))
    severe = evidence & ((got == 0) | (got * 2 < exp))
    gap_sheet = sheet & (((exp >= 5) & (got < exp)) | (look & ((got != exp) | F.col("hard"))))
    gap_page = page & (exp > 0) & ((F.col("rows") != exp) | (F.coalesce(F.col("confidence") == "RELIABLE", F.lit(False)) & F.col("hard")))
    distance = F.when(exp <= 0, INT_MAX - F.col("rows")).otherwise(F.abs(exp - got))
    return j.select("chunk_id", "extracted", severe.alias("severe"), (gap_sheet | gap_page).alias("gap"), distance.cast("bigint").alias("distance"))


def low_yield_pages(chunks: DataFrame) -> DataFrame:
    """Page chunks (expected, rows, chars, lines, markers) without an expected count that gave suspiciously little."""
    nothing = (F.col("rows") == 0) & (F.col("chars") >= 1000) & (F.col("lines") >= 8)
    few = (F.col("markers") >= 8) & (F.col("rows") * 2 < F.col("markers"))
    return chunks.where((F.col("source_type") == "PDF") & (F.col("expected") <= 0) & (nothing | few))


def extraction_stats(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Per document and place: chunks, source rows, candidates, extracted, valid, review, invalid."""
    r = rows.groupBy("chunk_id").agg(F.count("*").alias("extracted"), F.count_if(F.col("is_valid")).alias("valid"), F.count_if("review_required").alias("review"), F.count_if(~F.col("is_valid") & ~F.col("review_required")).alias("invalid"))
    j = chunks.join(r, "chunk_id", "left").fillna(0, ["extracted", "valid", "review", "invalid"])
    return j.groupBy("document", "place").agg(F.count("*").alias("chunks"), F.sum("source_rows").alias("source_rows"), F.sum("expected").alias("candidates"), *[F.sum(c).alias(c) for c in ("extracted", "valid", "review", "invalid")])


def global_row_numbers(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows (document, chunk_index, position) of the given chunks, numbered from 1 through all chunks of their document in source order."""
    kept = rows.join(chunks.select("document", "chunk_index"), ["document", "chunk_index"], "left_semi")
    return numbered_within(kept, ["document"], [F.col("chunk_index"), F.col("position")], "row_number")


def renumber_with_gaps(parsed: DataFrame, manual: DataFrame) -> DataFrame:
    """Parsed rows (document, position) and manual rows (document, insertion_index, gap_ordinal) in one order, numbered from 1 per document.

    A row's place is its insertion index, else its position, else last; at one place manual rows stand first, then by gap.
    """
    p = parsed.select("document", F.col("position").cast("bigint").alias("place"), F.lit(1).alias("kind"), F.lit(0).alias("gap"), F.lit(False).alias("is_manual"))
    m = manual.select("document", F.col("insertion_index").cast("bigint").alias("place"), F.when(F.col("insertion_index").isNull(), 1).otherwise(0).alias("kind"), F.coalesce("gap_ordinal", F.lit(0)).alias("gap"), F.lit(True).alias("is_manual"))
    numbers = numbered_within(p.unionByName(m), ["document"], [F.col("place").asc_nulls_last(), F.col("kind"), F.col("gap")], "row_number")
    return numbers.select("document", "place", "is_manual", "gap", F.col("row_number").cast("int").alias("row_number"))


def suppress_invented_codes(extracted: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """extracted (chunk_id, position, product_code) with codes that the source does not have taken out.

    Where a page chunk has as many rows as records (chunk_id, position, code_anchor, code_absent), a code is the record's anchor, or null where the record says there is none. Otherwise
    all codes go if the chunk's header has no code field (chunks: chunk_id, code_absent).
    """
    n = extracted.groupBy("chunk_id").agg(F.count("*").alias("rows")).join(records.groupBy("chunk_id").agg(F.count("*").alias("records")), "chunk_id", "left").select("chunk_id", (F.col("rows") == F.col("records")).alias("paired"))
    r = records.select("chunk_id", "position", "code_anchor", F.col("code_absent").alias("record_absent"))
    j = extracted.join(n, "chunk_id").join(r, ["chunk_id", "position"], "left").join(chunks.select("chunk_id", "code_absent"), "chunk_id", "left")
    code = F.when(F.coalesce("paired", F.lit(False)), F.when(F.col("code_anchor").isNotNull(), F.col("code_anchor")).when(~F.col("record_absent"), F.col("product_code"))).when(~F.coalesce("code_absent", F.lit(False)), F.col("product_code"))
    return j.select("chunk_id", "position", code.alias("product_code"))


def _fits(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 4) & F.contains(b, a)) | ((F.length(b) >= 4) & F.contains(a, b))


#: Characters of the pieces by which keys that hold others are found: a key is looked up by its first piece, of the greatest length that it has.
PIECES = (16, 8, 4)


def _first_piece(key: Column) -> Column:
    return F.coalesce(*[F.when(F.length(key) >= n, F.left(key, F.lit(n))) for n in PIECES])


def _pieces(key: Column) -> Column:
    """Every piece of a key of one of the lengths, once."""
    of = lambda n: F.when(F.length(key) >= n, F.transform(F.sequence(F.lit(1), F.length(key) - (n - 1)), lambda i: F.substring(key, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in PIECES]))


#: Records of a chunk that a name is compared with one by one; those of larger chunks are found through an index.
FEW_RECORDS = 64


def _fitting(asked: DataFrame, records: DataFrame, few: int = FEW_RECORDS) -> DataFrame:
    """asked (chunk_id, position, out, records: how many its chunk has), records (chunk_id, position, record_id, k) -> chunk_id, position, other: the first other record of the chunk that fits the name.

    In a chunk of few records a name meets all of them. A larger chunk has an index by whole keys and by pieces: a key within another has its first piece among the other's, so only
    those that share it are compared.
    """
    r = records.where("k IS NOT NULL").select("chunk_id", F.col("position").alias("there"), "record_id", "k")
    columns = ["chunk_id", "position", "out", "there", "record_id", "k"]
    found = asked.where(F.col("records") <= few).join(r, "chunk_id").select(*columns)
    asked = asked.where(F.col("records") > few)
    if not asked.isEmpty():
        r = r.join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi")
        same = asked.join(r.withColumn("out", F.col("k")), ["chunk_id", "out"])
        within = asked.withColumn("piece", F.explode(_pieces(F.col("out")))).join(r.withColumn("piece", _first_piece(F.col("k"))), ["chunk_id", "piece"])
        around = asked.withColumn("piece", _first_piece(F.col("out"))).join(r.withColumn("piece", F.explode(_pieces(F.col("k")))), ["chunk_id", "piece"])
        found = reduce(DataFrame.unionByName, [x.select(*columns) for x in (same, within, around)], found)
    fit = found.where((F.col("there") != F.col("position")) & _fits(F.col("k"), F.col("out")))
    return fit.groupBy("chunk_id", "position").agg(F.min_by("record_id", "there").alias("other"))


def align_records(extracted: DataFrame, records: DataFrame) -> DataFrame:
    """extracted (chunk_id, position, product_name, quantity) of reliable page chunks beside records (chunk_id, position, record_id, name_anchor, quantity_anchor) -> product_name, error.

    Only chunks with as many rows as records. A row's own record number is cut off its name. The name must fit the anchor, which then replaces it; an error says which
    other record it fits. A wrong quantity that is another record's, or one name for different anchors, is an error too. Records meet only within their chunk, and there by equal quantities or pieces of keys.
    """
    n = extracted.groupBy("chunk_id").agg(F.count("*").alias("a")).join(records.groupBy("chunk_id").agg(F.count("*").alias("b")), "chunk_id").where("a = b").select("chunk_id", F.col("b").alias("records"))
    rec = stage(records.select("chunk_id", "position", "record_id", "name_anchor", "quantity_anchor", alignment_key(F.col("name_anchor")).alias("k")), "records")
    j = extracted.join(n, "chunk_id").join(rec.withColumnRenamed("k", "src"), ["chunk_id", "position"])
    name = trim_to_null(F.col("product_name"))
    cut = F.regexp_replace(name, F.concat(F.lit(r"^\s*"), F.col("record_id").cast("string"), F.lit(r"\s*[.)\-:]?\s+")), F.lit(""))
    j = j.withColumn("name", F.when(F.length(F.trim(cut)) > 0, cut).otherwise(name)).withColumn("out", alignment_key(F.col("name")))
    wrong = F.col("src").isNotNull() & ~F.coalesce(_fits(F.col("src"), F.col("out")), F.lit(False))
    j = stage(j.select("chunk_id", "position", "name", "name_anchor", "out", "src", "quantity", "quantity_anchor", "records", wrong.alias("wrong")), "aligned")
    other = _fitting(j.where("wrong AND out IS NOT NULL").select("chunk_id", "position", "out", "records"), rec)
    # its own anchor is another quantity, so a record that has this one is another
    quantities = rec.where("quantity_anchor IS NOT NULL").select("chunk_id", F.col("quantity_anchor").alias("quantity")).distinct().withColumn("held", F.lit(True))
    j = j.join(other, ["chunk_id", "position"], "left").join(quantities, ["chunk_id", "quantity"], "left")
    moved = F.coalesce("held", F.lit(False)) & F.coalesce(F.col("quantity_anchor") != F.col("quantity"), F.lit(False))
    j = j.withColumn("final", F.coalesce("src", "out"))
    earlier = Window.partitionBy("chunk_id", "final").orderBy("position")
    two = F.col("final").isNotNull() & F.coalesce(F.first("src").over(earlier) != F.col("src"), F.lit(False))
    error = F.when(F.col("wrong"), F.when(F.col("other").isNotNull(), F.concat(F.lit("fits record "), F.col("other").cast("string"))).otherwise("name does not fit")).when(moved, "quantity of another record").when(two, "one name for two records")
    return j.select("chunk_id", "position", F.coalesce("name_anchor", "name").alias("product_name"), error.alias("error"))


def split_failed_chunks(records: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the half that they go to, gap rows): a failed chunk is halved at n div 2; one of a single record becomes a gap."""
    w = Window.partitionBy("chunk_id")
    r = records.join(failed.select("chunk_id"), "chunk_id", "left_semi").withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("position")) - 1)
    halves = r.where("n > 1").select("chunk_id", "position", "record_id", F.when(F.col("nth") < F.floor(F.col("n") / 2), 1).otherwise(2).alias("half"))
    return halves, r.where("n = 1").select("chunk_id", "position", "record_id")


def with_suspicion(rows: DataFrame, names: dict[str, tuple[str, str]], composed: bool = False) -> DataFrame:
    """rows with the rules (bits, for scalars.suspicion) that names break: for each entry of names, a new column -> the columns of a name and of its source.

    A catalogue's names repeat, so each distinct name with its source is judged once, however many rows have it; rows and judgements are staged.
    """
    rows = stage(rows, "named")
    asked = [rows.select(F.col(n).alias("name__"), F.col(s).alias("source__")).where("name__ IS NOT NULL").distinct() for n, s in names.values()]
    pairs = reduce(DataFrame.unionByName, asked).distinct()
    judged = stage(pairs.withColumn("rules__", suspicion_rules(F.col("name__"), F.col("source__"), composed)), "judged")
    size = judged.agg(F.sum(F.octet_length("name__") + F.coalesce(F.octet_length("source__"), F.lit(0)) + 64)).first()[0] or 0
    for out, (n, s) in names.items():
        side = judged.select(F.col("name__").alias(f"{out}_n__"), F.col("source__").alias(f"{out}_s__"), F.col("rules__").alias(out))
        rows = rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, (F.col(n) == F.col(f"{out}_n__")) & F.col(s).eqNullSafe(F.col(f"{out}_s__")), "left").drop(f"{out}_n__", f"{out}_s__")
    return rows


def name_review_outcome(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (row_id, product_name, source_name, trusted_name boolean) and decisions (row_id, status, product_name, reason) -> product_name, review_required, review_message, outcome for suspicious rows.

    A trusted source name always wins if it is short enough. A correction is taken only if it is not suspicious itself.
    """
    d = decisions.select("row_id", "status", F.when(F.col("status") == "CORRECTED", trim_to_null(F.col("product_name"))).alias("correction"), "reason")
    met = rows.select("row_id", "product_name", "source_name", "trusted_name").join(d, "row_id", "left")
    s = with_suspicion(met, {"rules": ("product_name", "source_name"), "fixed": ("correction", "source_name")}, composed=True).withColumn("s", suspicion(F.col("rules"))).where("s.suspicious")
    fixed = suspicion(F.col("fixed"))["suspicious"]
    source = trim_to_null(F.col("source_name"))
    trusted = F.col("trusted_name") & source.isNotNull()
    take = (F.col("status") == "CORRECTED") & F.col("correction").isNotNull() & (F.length("correction") <= MAX_NAME) & ~fixed
    outcome = F.when(trusted & (F.length(source) <= MAX_NAME), "SOURCE").when(trusted, "SOURCE_TOO_LONG").when(F.col("status") == "CONFIRMED", "CONFIRMED").when(take, "CORRECTED").when(F.col("status") == "CORRECTED", "BAD_CORRECTION").otherwise("REVIEW")
    s = s.withColumn("outcome", outcome)
    o = F.col("outcome")
    name = F.when(o == "SOURCE", source).when(o == "CORRECTED", F.col("correction")).otherwise(F.col("product_name"))
    message = F.when(o == "SOURCE_TOO_LONG", NAME_TOO_LONG).when(o == "BAD_CORRECTION", BAD_CORRECTION).when(o == "REVIEW", review_message_160(F.col("reason"), suspicion_message(F.col("s.signals"))))
    return s.select("row_id", name.alias("product_name"), message.isNotNull().alias("review_required"), message.alias("review_message"), o.alias("outcome"))
