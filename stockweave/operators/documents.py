"""Documents as DataFrames of lines and cells: rows, headers, records, chunks.

Inputs are (document, page or sheet, line or row, text or cell). Whatever is called first is first by its stated position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockweave.functions.scalars import bound, fold, has_code_label, header_key, is_name_header, java_trim, positive_int_cell, quantity_header_score, source_identity, trim_to_null
from stockweave.sources.shared import stage

from .ordering import BROADCAST_BYTES, numbered_within, running

# Chunk sizes, scan limits, labels and patterns of documents.
ROWS_PER_CHUNK, RECORDS_PER_CHUNK = 10, 5
TEXT_CHARS, PDF_CHARS = 12000, 2000
HEADER_SCAN_ROWS, HEADER_CONTEXT_ROWS, FALLBACK_HEADER_ROWS = 50, 5, 3
# Fixed value: the content of a header that isn't there.
NO_HEADER = "No separate header row was reliably detected. Infer field semantics from DATA ROWS."
LEAST_RUN = 3
NUMBERED_START = r"(?iu)^\s*(\d{1,4})\s*(?:[.)\-:|;]\s*|\s+)(?=.*\p{L}).*$"
QUANTITY_ONLY = r"(?iu)^\s*\d{1,9}\s*(?:adet|ad\.?|pcs?)\.?\s*$"
TECHNICAL_START = r"(?iuU)^\s*\d+(?:[.,]\d+)?\s*(?:v|w|a|mm|cm|ml|kg|g|m|metre|meter|volt|adet|pieces?|parça|parca|profil|profile)\b.*$"
EXPLICIT_START = r"(?iu)^\s*(?:ürün|urun|malzeme|araç\s+gereç|arac\s+gerec|product|item)(?:\s+(?:adı|adi|name))?\s*[:|]\s*\S.*$"
STRONG_MIXED_START = r"(?iu)^\s*\d{1,4}\s*[.)\-:|;]\s*.*\|.*(?:toplam|miktar|quantity|qty)\s*[:|].*$"
TRAILING_QUANTITY = r"(?iu)^\s*(\d{1,4})\s*(?:[.)\-:|;]\s*|\s+)(?=.*\p{L}).*?(?:[|;]\s*|\s+)(\d{1,9})(?:\s*(?:adet|ad\.?|pcs?))?\s*$"
DESCRIPTION_START = r"(?iu)(?:yüzey\s+dayanım|set\s+içerisinde|paket\s+içerisinde|kalınlık\s+\d|su\s+bazlı(?:dır)?|çok\s+amaçlı\s+eğitim|\d+(?:[.,]\d+)?\s*mm\s+uç|\d+\s*parçalı\s+kutu|\d+(?:[.,]\d+)?\s*[x×]\s*\d+(?:[.,]\d+)?\s*mm\s+ölçüler|\d+(?:[.,]\d+)?\s*metre\s+kablo|\d+\s*v\s+adaptörlerle)"
LABELLED_QUANTITY = r"(?iu)(?:talep\s+edilen\s+stok\s+miktar[ıi]|istenen\s+miktar|genel\s+toplam|toplam(?:\s+miktar)?|miktar|adet|quantity|qty)\s*[:|]?\s*(\d{1,9})(?:\s*adet)?"
CODE_LABEL = r"(?iu)(?m)(?:^|\|)\s*(?:kod|ürün\s+kodu|urun\s+kodu|stok\s+kodu|malzeme\s+kodu)\s*[:|]\s*([^|\n]+)"
PAGE_FOOTER = r"(?iu)^\s*(?:(?:test\s+)?özet[i]?|(?:(?:genel|beklenen)\s+)?toplam)\s*[:：].*$"
BULLET_MARKER = r"(?iu)^\s*[-*•▪◦]\s+.*\p{L}.*$"
EXPLICIT_ITEM_LABEL = r"(?iu)^\s*(?:ürün|urun|malzeme|product|item)\s+(?:adı|adi|name)\s*[:|].*$"
NO_CODE_VALUES, NO_CODE_PARTS = ("-", "yok"), ("belgede belirtilmemis", "belirtilmemis", "bulunmuyor")
SEQUENCE_LABELS, NAME_LABELS = ("sira no", "sira numarasi"), ("urun adi", "malzeme adi", "urun / malzeme")
HEADER_FAMILIES = (("urun kod", "malzeme kod", "stok kod"), ("teknik ozellik", "teknik bilgi", "aciklama"), ("miktar", "toplam", "adet"))
STRICT_FAMILIES = (("sira no", "sira numarasi"), ("urun kod", "malzeme kod", "stok kod"), ("urun adi", "malzeme adi"), ("teknik ozellik", "spesifikasyon"), ("birim",), ("miktar", "toplam adet"), ("aciklama",))


def _any(c: Column, parts: tuple) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def _count(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])


# ---- delimited text ----


def file_lines(spark: SparkSession, paths: str) -> DataFrame:
    """UTF-8 files -> document, line_no (physical, from 1), text. A file is read by its splits, each line with the split it begins in; lines are numbered along the splits of their file."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return numbered_within(lines, ["document"], [F.col("block"), F.col("at")], "line_no").select("document", F.col("line_no").cast("int").alias("line_no"), "text")


def delimited_rows(spark: SparkSession, paths: str) -> DataFrame:
    """UTF-8 files -> document, line_no (physical, from 1), text, delimiter, is_header: blank lines are dropped but counted."""
    return with_delimiter(file_lines(spark, paths))


def with_delimiter(lines: DataFrame) -> DataFrame:
    """lines (document, line_no, text) that are not blank, with their document's delimiter: ; if its first kept line has one, else a comma. The first line is context and data."""
    kept = lines.where(F.length(java_trim(F.col("text"))) > 0)
    first = kept.groupBy("document").agg(F.min_by("text", "line_no").alias("head"), F.min("line_no").alias("head_line"))
    return kept.join(first, "document").select("document", "line_no", "text", F.when(F.contains("head", F.lit(";")), ";").otherwise(",").alias("delimiter"), (F.col("line_no") == F.col("head_line")).alias("is_header"))


def split_delimited_cells(text: Column, delimiter: Column) -> Column:
    """Trimmed cells of a line; quotes mean nothing."""
    return F.transform(F.when(delimiter == ";", F.split(text, ";")).otherwise(F.split(text, ",")), java_trim)


def _chunk(size: int) -> Column:
    """The chunk, from 1, of a row's number nth__."""
    return F.floor((F.col("nth__") - 1) / size).cast("int") + 1


def row_chunks(rows: DataFrame, keys: list[str], order: str, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows of each document or sheet in order -> chunk_index (from 1), first_row, last_row, row_count."""
    numbers = numbered_within(rows.select(*keys, order), keys, [F.col(order)], "nth__")
    return numbers.withColumn("chunk_index", _chunk(size)).groupBy(*keys, "chunk_index").agg(F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count("*").alias("row_count"))


# ---- sheets ----


def _filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, java_trim), lambda c: c != "")


def _content(cells: Column) -> Column:
    return F.array_join(_filled(cells), " | ")


def _numbered_rows(cells: DataFrame) -> DataFrame:
    """sheet_rows without content, which follows from cells."""
    g = cells.groupBy("document", "sheet", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda s: F.coalesce(s["value"], F.lit(""))).alias("cells"))
    number = lambda f: F.when(F.size(f) > 0, (F.size(f) >= 2) & F.get(f, F.lit(0)).rlike(r"^\s*\d+(?:[.,]\d+)?\s*$"))
    return g.withColumn("numbered", bound(_filled(F.col("cells")), number)).where("numbered IS NOT NULL")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """cells (document, sheet, row, col, value) -> rows that are not empty: content (cells joined by |), cells in column order, numbered: at least two cells filled and the first filled one a number."""
    return _numbered_rows(cells).select("document", "sheet", "row", _content(F.col("cells")).alias("content"), "cells", "numbered")


def header_scan_limit(rows: DataFrame, most: int = HEADER_SCAN_ROWS) -> DataFrame:
    """The first rows of each sheet in which its header may be: at most `most`, and none from the first numbered record on."""
    w = Window.partitionBy("document", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("nth", F.count("*").over(w)).withColumn("records", F.count_if("numbered").over(w))
    return seen.where((F.col("nth") <= most) & (F.col("records") == 0)).drop("nth", "records")


def _with_header(rows: DataFrame) -> DataFrame:
    """rows with nth and their sheet's name_col, quantity_col, header_row, header_nth, as detect_header says."""
    # every window is over a sheet: one shuffle serves all of them
    w = Window.partitionBy("document", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    sheet = Window.partitionBy("document", "sheet")
    seen = rows.withColumn("nth", F.count("*").over(w)).withColumn("scanned", (F.col("nth") <= HEADER_SCAN_ROWS) & (F.count_if("numbered").over(w) == 0))
    keys = F.transform("cells", header_key)
    named = F.array_min(F.array_compact(F.transform("keys", lambda k, i: F.when(is_name_header(k), i))))
    best = F.array_max(F.array_compact(F.transform("keys", lambda k, i: F.when(quantity_header_score(k) > 0, F.struct(quantity_header_score(k).alias("score"), i.alias("col"))))))
    read = seen.withColumn("keys", F.when(F.col("scanned"), keys)).withColumn("named", named).withColumn("best", best)
    n = F.min(F.when(F.col("named").isNotNull(), F.struct("row", F.col("named").alias("col")))).over(sheet)
    q = F.max(F.when(F.col("best").isNotNull(), F.struct(F.col("best.score").alias("score"), (-F.col("row")).alias("row"), F.col("best.col").alias("col")))).over(sheet)
    found = read.withColumn("n", n).withColumn("q", q).select(*rows.columns, "nth", F.col("n.row").alias("name_row"), F.col("n.col").alias("name_col"), (-F.col("q.row")).alias("quantity_row"), F.col("q.col").alias("quantity_col"))
    ranked = found.withColumn("header_row", F.greatest("name_row", "quantity_row"))
    both = F.col("name_row").isNotNull() & F.col("quantity_row").isNotNull()
    ranked = ranked.withColumn("header_row", F.when(both, F.col("header_row"))).withColumn("header_nth", F.max(F.when(F.col("row") <= F.col("header_row"), F.col("nth"))).over(sheet))
    return ranked


def detect_header(rows: DataFrame) -> DataFrame:
    """rows of sheet_rows -> per sheet: name_col, quantity_col (from 0), header_row, content, code_absent; columns null where the header is not certain.

    The name column is the first that reads like one. The quantity column has the best score, ties to the first row and there to the last column. With both, the header ends at the
    later of the two rows and its context is the last 5 rows up to there. Else it is up to 5 rows before the first numbered record among the first 5 rows, else the first 3 rows, without trust.
    Where the first row is a record already, content is a fixed sentence.
    """
    ranked = _with_header(rows)
    sheet = Window.partitionBy("document", "sheet")
    first_number = F.min(F.when(F.col("numbered") & (F.col("nth") <= HEADER_CONTEXT_ROWS), F.col("nth"))).over(sheet)
    ranked = ranked.withColumn("first_number", first_number)
    used = F.when(F.col("header_row").isNotNull(), (F.col("row") <= F.col("header_row")) & (F.col("nth") > F.col("header_nth") - HEADER_CONTEXT_ROWS)).when(F.col("first_number").isNotNull(), F.col("nth") < F.col("first_number")).otherwise(F.col("nth") <= FALLBACK_HEADER_ROWS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(used, F.struct("row", "content")))), lambda s: s["content"]), "\n")
    out = ranked.groupBy("document", "sheet").agg(F.first("name_col").alias("name_col"), F.first("quantity_col").alias("quantity_col"), F.first("header_row").alias("header_row"), F.first("first_number").alias("first_number"), text.alias("content"))
    certain = F.col("header_row").isNotNull()
    partly = F.col("first_number").isNotNull() & (F.col("content") != "")
    absent = F.when(certain | partly, ~has_code_label(F.col("content"))).otherwise(False)
    return out.select("document", "sheet", F.when(certain | partly, F.col("name_col")).alias("name_col"), F.when(certain, F.col("quantity_col")).alias("quantity_col"), "header_row", F.when(F.col("content") != "", F.col("content")).otherwise(NO_HEADER).alias("content"), absent.alias("code_absent"))


def _records(r: DataFrame, content: Column) -> DataFrame:
    cell = lambda k: F.coalesce(F.get("cells", F.col(k)), F.lit(""))
    r = r.where("row > header_row").withColumn("product_name", trim_to_null(cell("name_col"))).withColumn("quantity", positive_int_cell(cell("quantity_col"))).where("product_name IS NOT NULL AND quantity IS NOT NULL")
    return r.select("document", "sheet", F.col("row").alias("source_row"), source_identity(F.col("sheet"), F.col("row")).alias("source_identity"), content.alias("source_text"), "product_name", "quantity")


def table_records(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows under a certain header with a name and a positive whole quantity: the trusted source records."""
    h = headers.where("header_row IS NOT NULL").select("document", "sheet", "name_col", "quantity_col", "header_row")
    return _records(rows.join(h, ["document", "sheet"]), F.col("content"))


def cell_records(cells: DataFrame) -> DataFrame:
    """table_records of cells: rows take their sheet's header from the windows in which it is found, so they are made and dealt by sheet once, without their content."""
    return _records(_with_header(_numbered_rows(cells)), _content(F.col("cells")))


def excel_chunks(rows: DataFrame, records: DataFrame, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """Chunks of each sheet's rows with their records: candidate_count and record rows; a chunk without trusted records counts its numbered rows."""
    chunked = numbered_within(rows.select("document", "sheet", "row", "numbered"), ["document", "sheet"], [F.col("row")], "nth__").withColumn("chunk_index", _chunk(size))
    trusted = records.select("document", "sheet", F.col("source_row").alias("row"), F.lit(True).alias("trusted"))
    j = chunked.join(trusted, ["document", "sheet", "row"], "left")
    g = j.groupBy("document", "sheet", "chunk_index").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("row_count"), F.count_if("trusted").alias("trusted"), F.array_sort(F.collect_list(F.when(F.col("trusted"), F.col("row")))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("numbered"), F.col("row")))).alias("n"))
    use = F.when(F.col("trusted") > 0, F.col("t")).otherwise(F.col("n"))
    return g.select("document", "sheet", "chunk_index", "first_row", "last_row", "row_count", F.size(use).alias("candidate_count"), use.alias("record_rows"))


def render_chunk_fragment(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """A text per chunk: its header lines, then every record with its quantity and code evidence.

    chunks (chunk_id, document, source_type, place, chunk_index, first_row, last_row); records (chunk_id, position, record_id, quantity, code, source_text).
    """
    line = F.concat(
        F.lit("\nRECORD "), F.col("record_id").cast("string"), F.lit(":\n"), F.when(F.col("quantity").isNotNull(), F.concat(F.lit("SOURCE QUANTITY EVIDENCE: "), F.col("quantity").cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("SOURCE PRODUCT CODE EVIDENCE: "), F.coalesce("code", F.lit("NONE (no explicit source code)")), F.lit("\nSOURCE RECORD TEXT:\n"), F.col("source_text"),
    )
    body = records.withColumn("line", line).groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n").alias("body"), F.count("*").alias("n"))
    place = F.when(F.col("source_type") == "XLSX", F.concat(F.lit("WORKSHEET: "), F.col("place"), F.lit("\n"))).otherwise(F.concat(F.lit("PAGE: "), F.col("place"), F.lit("\n")))
    text = F.concat(
        F.lit("SOURCE DOCUMENT: "), F.col("document"), F.lit("\nSOURCE TYPE: "), F.col("source_type"), F.lit("\n"), place, F.lit("CHUNK: "), F.col("chunk_index").cast("string"), F.lit("\nSOURCE LOGICAL RECORD COUNT: "), F.col("n").cast("string"),
        F.lit("\nSOURCE ROWS: "), F.col("first_row").cast("string"), F.lit("-"), F.col("last_row").cast("string"), F.lit("\n\n--- FRAGMENT START ---"), F.col("body"), F.lit("\n--- FRAGMENT END ---"),
    )
    return chunks.join(body, "chunk_id").select("chunk_id", text.alias("fragment"))


# ---- text blocks ----


def normal_text(text: Column) -> Column:
    return java_trim(F.regexp_replace(text, r"\r\n|\r", "\n"))


def cut_long_line(line: Column, most: int) -> Column:
    """A line in pieces of at most `most` characters, cut at the last space within reach, white space after a cut skipped."""
    piece = rf"(?s)(.{{1,{most}}}(?= |\z)|.{{1,{most}}})\s*"
    return F.transform(F.regexp_extract_all(line, F.lit(piece), F.lit(1)), java_trim)


def _breaks(placed: DataFrame, keys: list[str], glue: int, most: int) -> DataFrame:
    """placed (keys, i, n characters, p: characters with glue up to and with this text) -> keys, i, stop, next for every text that is not empty: the first text that a content from i on can't take (null: it takes all), and the text with which the next content begins.

    A search in the sums: texts and what their contents may reach are put in one order of sums; from the greatest down, the least text seen so far is the first beyond.
    """
    texts = placed.select(*keys, F.col("p").alias("at"), F.lit(1).alias("kind"), "i", F.col("i").alias("j"), F.when(F.col("n") > 0, F.col("i")).alias("filled"))
    asked = placed.where("n > 0").select(*keys, (F.col("p") + F.greatest(F.lit(most) - F.col("n"), F.lit(0))).alias("at"), F.lit(0).alias("kind"), "i", F.lit(None).cast("bigint").alias("j"), F.lit(None).cast("bigint").alias("filled"))
    order = [F.col("at").desc(), F.col("kind"), F.col("i").desc()]
    return running(texts.unionByName(asked), keys, order, {"stop": ("min", F.col("j")), "next": ("min", F.col("filled"))}).where("kind = 0").select(*keys, "i", "stop", "next")


def _reached(firsts: DataFrame, jumps: DataFrame, keys: list[str]) -> DataFrame:
    """firsts (keys, i), jumps (keys, i, next) -> all (keys, i) that follow from the firsts by jumps. Jumps double in every round, so a key of n contents takes log(n) rounds of joins, however few tasks one key was in before."""
    reached = stage(firsts, "reached")
    jumps = stage(jumps.where("next IS NOT NULL"), "jumps")
    while True:
        more = stage(reached.join(jumps, [*keys, "i"]).select(*keys, F.col("next").alias("i")), "reached")
        if not more.take(1):
            return reached
        reached = reached.unionByName(more)
        further = jumps.select(*keys, F.col("i").alias("next"), F.col("next").alias("beyond"))
        jumps = stage(jumps.join(further, [*keys, "next"]).select(*keys, "i", F.col("beyond").alias("next")), "jumps")


#: Texts and characters of a key that are packed within one row; larger keys are searched.
FEW_TEXTS, FEW_CHARS = 512, 1 << 20


def _packed_few(rows: DataFrame, keys: list[str], glue: str, most: int) -> DataFrame:
    """rows (keys, place_of__, text_of__) of keys with few texts -> keys, k, content: one pass over each key's lengths gives the places at which contents begin."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place_of__", "text_of__"))), lambda x: x["text_of__"])
    g = rows.groupBy(*keys).agg(texts.alias("texts__"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.array().cast("array<struct<start: int, stop: int>>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        i, n = acc["i"] + 1, F.length(x)
        opens = (acc["size"] == 0) | (acc["size"] + len(glue) + n > most)
        size = F.when(opens, n).otherwise(acc["size"] + len(glue) + n)
        # an empty text begins nothing
        runs = F.when(opens & (n > 0), F.array_append(acc["runs"], F.struct(i.alias("start"), i.alias("stop")))).when(opens, acc["runs"])
        last = F.element_at(acc["runs"], -1)
        longer = F.array_append(F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1), F.struct(last["start"].alias("start"), i.alias("stop")))
        return F.struct(i.alias("i"), size.alias("size"), runs.otherwise(longer).alias("runs"))

    runs = g.select(*keys, "texts__", F.posexplode(F.aggregate("texts__", start, step)["runs"]).alias("k", "run__"))
    return runs.select(*keys, "k", F.array_join(F.slice("texts__", F.col("run__.start"), F.col("run__.stop") - F.col("run__.start") + 1), glue).alias("content"))


def pack(rows: DataFrame, keys: list[str], order: str, text: str, glue: str, most: int, few: int = FEW_TEXTS) -> DataFrame:
    """Consecutive texts of each key joined by glue as long as they stay within `most` -> keys, k (from 0), content. An empty text with which a content would begin is left out; keys are not null, and order is distinct within a key.

    A key of few texts is packed within one row. In a key of many, contents end where a search in the sums of lengths says, and the first text leads to all others by doubling jumps: no task holds a key.
    """
    plain = stage(rows.select(*keys, F.col(order).alias("place_of__"), F.col(text).alias("text_of__")), "texts")
    size = plain.groupBy(*keys).agg(F.count("*").alias("n__"), F.sum(F.length("text_of__")).alias("chars__"))
    large = stage(size.where((F.col("n__") > few) | (F.col("chars__") > FEW_CHARS)).select(*keys), "large")
    n = large.count()
    if not n:
        return _packed_few(plain, keys, glue, most)
    side = F.broadcast(large) if n * 256 <= BROADCAST_BYTES else large
    return _packed_few(plain.join(side, keys, "left_anti"), keys, glue, most).unionByName(_packed_many(plain.join(side, keys, "left_semi"), keys, "place_of__", "text_of__", glue, most))


def _packed_many(rows: DataFrame, keys: list[str], order: str, text: str, glue: str, most: int) -> DataFrame:
    g = len(glue)
    named = [F.col(k).alias(f"{k}__") for k in keys]
    own = [f"{k}__" for k in keys]
    lengths = rows.select(*named, F.col(order).alias("order__"), F.length(text).cast("bigint").alias("n"))
    placed = stage(running(lengths, own, [F.col("order__")], {"i": ("sum", F.lit(1).cast("bigint")), "p": ("sum", F.col("n") + g)}), "placed")
    ends = placed.groupBy(*own).agg(F.max("p").alias("total"), F.min(F.when(F.col("n") > 0, F.col("i"))).alias("first")).where("first IS NOT NULL")
    long = stage(ends.where(F.col("total") - g > most), "long")
    breaks = stage(_breaks(placed.join(long.select(*own), own, "left_semi"), own, g, most), "breaks")
    starts = _reached(long.select(*own, F.col("first").alias("i")), breaks.select(*own, "i", "next"), own).join(breaks, [*own, "i"]).select(*own, "i", "stop")
    starts = starts.unionByName(ends.where(F.col("total") - g <= most).select(*own, F.col("first").alias("i"), F.lit(None).cast("bigint").alias("stop")))
    begun = placed.join(starts.withColumn("begins", F.lit(1).cast("bigint")), [*own, "i"], "left").withColumn("stop", F.when(F.col("begins").isNotNull(), F.coalesce("stop", F.lit(2**62))))
    dealt = running(begun.drop("n", "p"), own, [F.col("i")], {"k__": ("sum", F.coalesce("begins", F.lit(0))), "until": ("max", F.col("stop"))}).where("k__ > 0 AND i < until").select(*own, "order__", "k__")
    met = rows.select(*keys, F.col(order).alias("place_of__"), F.col(text).alias("text_of__")).join(dealt, [F.col(k) == F.col(f"{k}__") for k in keys] + [F.col("place_of__") == F.col("order__")])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place_of__", "text_of__"))), lambda x: x["text_of__"]), glue)
    return met.groupBy(*keys, "k__").agg(joined.alias("content")).select(*keys, (F.col("k__") - 1).cast("int").alias("k"), "content")


def text_blocks(docs: DataFrame, most: int = TEXT_CHARS) -> DataFrame:
    """docs (document, text) -> document, position, block: paragraphs between blank lines; one over `most` is packed from its lines, and a line over it is cut."""
    paragraphs = F.filter(F.transform(F.split(normal_text(F.col("text")), r"\n\s*\n+"), java_trim), lambda p: F.length(p) > 0)
    p = docs.select("document", F.posexplode(paragraphs).alias("at", "paragraph"))
    first = [F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("k")]
    short = p.where(F.length("paragraph") <= most).select("document", "at", *first, F.col("paragraph").alias("block"))
    # lines of a long paragraph: runs of short lines are packed, a long line stands alone
    lines = F.split("paragraph", "\n")
    marked = F.transform(lines, lambda x, n: F.struct(x.alias("line"), (F.length(x) > most).alias("long"), (F.length(F.coalesce(F.get(lines, n - 1), F.lit(""))) > most).alias("after")))
    each = p.where(F.length("paragraph") > most).select("document", "at", F.posexplode(marked).alias("n", "m")).select("document", "at", "n", "m.line", "m.long", "m.after")
    each = running(each, ["document", "at"], [F.col("n")], {"run": ("sum", F.when(F.col("long") | F.col("after"), 1).otherwise(0).cast("bigint"))})
    cut = each.where("long").select("document", "at", "run", F.posexplode(cut_long_line(F.col("line"), most)).alias("k", "block"))
    packed = pack(each.where("NOT long"), ["document", "at", "run"], "n", "line", "\n", most).withColumnRenamed("content", "block")
    order = [F.col(c) for c in ("at", "run", "k")]
    blocks = numbered_within(short.unionByName(cut).unionByName(packed), ["document"], order, "position")
    return blocks.select("document", F.col("position").cast("int").alias("position"), "block")


def pack_blocks(blocks: DataFrame, most: int = TEXT_CHARS) -> DataFrame:
    """blocks (document, position, block) -> document, chunk_index, content: consecutive blocks joined by blank lines while they fit."""
    return pack(blocks, ["document"], "position", "block", "\n\n", most).select("document", (F.col("k") + 1).alias("chunk_index"), "content")


# ---- pages ----


def is_header_line(text: Column) -> Column:
    """A line with a sequence or name header and three of five label families."""

    def of(t: Column) -> Column:
        leads = [_any(t, SEQUENCE_LABELS), _any(t, NAME_LABELS)]
        return (leads[0] | leads[1]) & (_count([*leads, *[_any(t, f) for f in HEADER_FAMILIES]]) >= 3)

    return bound(fold(text), of)


def is_header_line_strict(text: Column) -> Column:
    """A line with three of seven label families."""
    return bound(fold(text), lambda t: _count([_any(t, f) for f in STRICT_FAMILIES]) >= 3)


def consecutive_runs(numbers: DataFrame, keys: list[str], number: str, least: int = LEAST_RUN) -> DataFrame:
    """Distinct numbers of each key that lie in runs of at least `least` consecutive ones: keys, number, run_start, run_length."""
    d = numbers.select(*keys, number).distinct()
    d = d.withColumn("run__", F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number)))
    w = Window.partitionBy(*keys, "run__")
    return d.withColumn("run_start", F.min(number).over(w)).withColumn("run_length", F.count("*").over(w)).where(F.col("run_length") >= least).drop("run__")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """lines (document, page, line_no, text) with number: the record number that the line begins with, null for bare quantities, technical figures and headers."""
    t = F.col("text")
    plain = ~t.rlike(QUANTITY_ONLY) & ~t.rlike(TECHNICAL_START) & ~is_header_line(t)
    # the number's pattern comes first and runs once: most lines are decided by it
    return lines.withColumn("number", bound(F.regexp_extract(t, NUMBERED_START, 1), lambda n: F.when((n != "") & plain, n.try_cast("int"))))


def record_starts(lines: DataFrame) -> DataFrame:
    """Lines with number, explicit, start_kind (null: no start) and the page's counts: explicit_count, reliable_count, numbered_count."""
    keys = ["document", "page"]
    marked = numbered_lines(lines).withColumn("explicit", F.col("text").rlike(EXPLICIT_START))
    # distinct consecutive numbers keep their distance to their rank: a run is as long as its numbers reach; all windows are over a page, on one shuffle
    ranked = marked.withColumn("run__", F.col("number") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("number")))
    run, page = Window.partitionBy(*keys, "run__"), Window.partitionBy(*keys)
    j = ranked.withColumn("reliable", F.coalesce(F.max("number").over(run) - F.min("number").over(run) + 1 >= LEAST_RUN, F.lit(False))).drop("run__")
    j = j.withColumn("explicit_count", F.count_if("explicit").over(page)).withColumn("numbered_count", F.count("number").over(page)).withColumn("reliable_count", F.size(F.collect_set(F.when(F.col("reliable"), F.col("number"))).over(page)))
    strong = (F.col("explicit_count") >= 2) & F.col("text").rlike(STRONG_MIXED_START)
    kind = F.when(F.col("explicit"), "EXPLICIT_LABEL").when(F.col("number").isNotNull() & (F.coalesce("reliable", F.lit(False)) | strong), "NUMBERED")
    return j.withColumn("start_kind", kind).drop("reliable")


def name_anchor(first_line: Column, kind: Column) -> Column:
    """The product name that a record's first line surely holds; null if its end is not certain."""
    rest = lambda line: F.regexp_replace(java_trim(F.regexp_replace(line, r"^\s*\d{1,4}", "")), r"^[.)\-:|;]\s*", "")
    told = lambda r: bound(F.regexp_instr(r, F.lit(DESCRIPTION_START)), lambda at: F.when(at > 1, F.substring(r, F.lit(1), at - 1)))
    cut = lambda r: F.when(F.contains(r, F.lit("|")), F.substring_index(r, "|", 1)).when(F.contains(r, F.lit(" - ")), F.substring_index(r, " - ", 1)).otherwise(told(r))

    def of(line: Column) -> Column:
        labelled = F.when(line.rlike("[:|]"), F.regexp_extract(line, r"(?s)^[^:|]*[:|](.*)$", 1))
        return F.when(kind == "EXPLICIT_LABEL", labelled).when(line.rlike(NUMBERED_START), bound(rest(line), cut))

    return bound(java_trim(bound(java_trim(first_line), of)), lambda name: F.when(name != "", name))


def quantity_anchor(text: Column, first_line: Column) -> Column:
    """The last labelled quantity of a record, else the number that ends its first line."""
    labelled = F.try_element_at(F.regexp_extract_all(text, F.lit(LABELLED_QUANTITY), F.lit(1)), F.lit(-1))
    return F.coalesce(labelled.try_cast("int"), F.regexp_extract(first_line, TRAILING_QUANTITY, 2).try_cast("int"))


def _codes(text: Column) -> Column:
    values = F.transform(F.regexp_extract_all(text, F.lit(CODE_LABEL), F.lit(1)), java_trim)
    return F.filter(values, lambda v: bound(fold(v), lambda t: ~(t.isin(*NO_CODE_VALUES) | _any(t, NO_CODE_PARTS))))


def code_absent(text: Column) -> Column:
    return F.size(_codes(text)) == 0


def segment_records(lines: DataFrame) -> DataFrame:
    """lines (document, page, line_no, text) -> a row per record: ordinal, record_id, start_kind, source_text, anchors, code_absent.

    A record runs from its start to the next one; footer lines at its end are cut off. Its id is the printed number if all of the page's
    starts are numbered, else its ordinal. Lines before the first start are the page's header.
    """
    keys = ["document", "page"]
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy(*keys)
    s = record_starts(lines).withColumn("ordinal", F.count("start_kind").over(w)).withColumn("all_numbered", F.coalesce(F.bool_and(F.col("start_kind") == "NUMBERED").over(page), F.lit(False)))
    s = s.where("ordinal > 0")
    body = Window.partitionBy(*keys, "ordinal").orderBy("line_no")
    # the last line that is no footer, the start itself at least
    s = s.withColumn("last_line", F.max(F.when(F.col("start_kind").isNotNull() | ~F.col("text").rlike(PAGE_FOOTER), F.col("line_no"))).over(body.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("line_no <= last_line")
    text = java_trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n"))
    first = F.min_by("text", "line_no")
    g = s.groupBy(*keys, "ordinal").agg(text.alias("source_text"), first.alias("first_line"), F.max("start_kind").alias("start_kind"), F.min_by("number", "line_no").alias("number"), F.first("all_numbered").alias("all_numbered"), F.first("explicit_count").alias("explicit_count"), F.first("reliable_count").alias("reliable_count"))
    first_line = F.substring_index(F.col("source_text"), "\n", 1)
    return g.withColumn("codes", _codes(F.col("source_text"))).select(
        *keys, "ordinal", F.when(F.col("all_numbered"), F.col("number")).otherwise(F.col("ordinal")).cast("int").alias("record_id"), "start_kind", "source_text", name_anchor(first_line, F.col("start_kind")).alias("name_anchor"),
        F.get("codes", F.lit(0)).alias("code_anchor"), quantity_anchor(F.col("source_text"), first_line).alias("quantity_anchor"), (F.size("codes") == 0).alias("code_absent"), "explicit_count", "reliable_count",
    )


def page_confidence(lines: DataFrame) -> DataFrame:
    """Per page: confidence, records or markers, mixed (two kinds of starts)."""
    keys = ["document", "page"]
    records = segment_records(lines).groupBy(*keys).agg(F.count("*").alias("records"), F.bool_and(F.col("quantity_anchor").isNotNull()).alias("evident"), F.count_distinct("start_kind").alias("kinds"))
    pages = record_starts(lines).groupBy(*keys).agg(F.max("explicit_count").alias("explicit"), F.max("numbered_count").alias("numbered"), F.max("reliable_count").alias("reliable"))
    j = pages.join(records, keys, "left")
    markers = F.greatest("numbered", "explicit")
    sure = F.col("evident") & ((F.col("reliable") >= 3) | (F.col("explicit") >= 2))
    confidence = F.when(F.col("records").isNull(), F.when(markers > 0, "APPROXIMATE").otherwise("UNKNOWN")).when(sure, "RELIABLE").otherwise("APPROXIMATE")
    return j.select(*keys, confidence.alias("confidence"), F.coalesce("records", markers).cast("bigint").alias("markers"), F.coalesce(F.col("kinds") > 1, F.lit(False)).alias("mixed"))


def record_chunks(records: DataFrame, size: int = RECORDS_PER_CHUNK) -> DataFrame:
    """Records of each page in chunks of `size`: chunk_index, first and last record, count."""
    numbers = numbered_within(records.select("document", "page", "ordinal", "record_id"), ["document", "page"], [F.col("ordinal")], "nth__")
    return numbers.withColumn("chunk_index", _chunk(size)).groupBy("document", "page", "chunk_index").agg(F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"), F.count("*").alias("record_count"))


def _table_line(text: Column) -> Column:
    """struct(number, header) of a table-like line, number null for others: the pattern and the label families are looked for once."""
    return bound(F.regexp_extract(text, TRAILING_QUANTITY, 1).try_cast("int"), lambda n: F.struct(n.alias("number"), F.when(n.isNotNull(), is_header_line_strict(text)).alias("header")))


def reliable_candidates(lines: DataFrame) -> DataFrame:
    """Per page the numbers of table-like lines, header-like ones left out: reliable (in runs of three), matched, header_lines, outliers."""
    keys = ["document", "page"]
    seen = lines.select(*keys, _table_line(F.col("text")).alias("hit")).select(*keys, "hit.number", "hit.header")
    # one shuffle, by page, serves all that follows
    g = seen.repartition(*keys).groupBy(*keys, "number").agg(F.count_if("header").alias("header_lines"), F.bool_or(~F.col("header")).alias("plain"))
    rank = Window.partitionBy(*keys, "plain").orderBy("number")
    g = g.withColumn("run__", F.when(F.col("plain"), F.col("number") - F.row_number().over(rank)))
    g = g.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "plain", "run__")))
    pages = g.groupBy(*keys).agg(F.count_if(F.col("plain") & (F.col("run_length") >= LEAST_RUN)).alias("reliable"), F.count_if("plain").alias("matched"), F.sum("header_lines").alias("header_lines"), F.count("number").alias("hits"))
    return pages.where("hits > 0").select(*keys, "reliable", "matched", "header_lines", (F.col("matched") - F.col("reliable")).alias("outliers"))


def approx_item_markers(lines: DataFrame) -> DataFrame:
    """Per page the most of: numbers in runs, bullets, explicit labels."""
    keys = ["document", "page"]
    t = lines.withColumn("number", F.when(F.col("text").rlike(NUMBERED_START), F.regexp_extract("text", NUMBERED_START, 1).try_cast("int")))
    runs = consecutive_runs(t.where("number IS NOT NULL"), keys, "number").groupBy(*keys).agg(F.count("*").alias("sequential"))
    g = t.groupBy(*keys).agg(F.count_if(F.col("text").rlike(BULLET_MARKER)).alias("bullets"), F.count_if(F.col("text").rlike(EXPLICIT_ITEM_LABEL)).alias("labels"))
    return g.join(runs, keys, "left").select(*keys, F.greatest(F.coalesce("sequential", F.lit(0)), "bullets", "labels").alias("markers"))


def page_ids_per_chunk(lines: DataFrame, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """Chunks of a page's lines with their matched numbers, only those that are reliable on the whole page."""
    keys = ["document", "page"]
    # texts end before the shuffle, which all windows share
    hit = lines.select(*keys, "line_no", _table_line(F.col("text")).alias("hit")).select(*keys, "line_no", F.when(~F.col("hit.header"), F.col("hit.number")).alias("number"))
    hit = hit.withColumn("chunk_index", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1) / size).cast("int") + 1)
    hit = hit.withColumn("run__", F.col("number") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("number")))
    run = Window.partitionBy(*keys, "run__")
    hit = hit.withColumn("sure", F.when(F.max("number").over(run) - F.min("number").over(run) + 1 >= LEAST_RUN, F.col("number")))
    chunks = hit.groupBy(*keys, "chunk_index").agg(F.count_distinct("sure").alias("ids"), F.min("sure").alias("first_id"), F.max("sure").alias("last_id"))
    return chunks.where("ids > 0")
