"""Column expressions of the inventory domain: names, keys, coercions, validation messages, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits, messages, labels, phrase lists and patterns of the domain.
MAX_NAME, MAX_CODE = 255, 255
INT_MAX = 2147483647
IMPORT_SOURCES = ("Belediye", "Tubitak", "T3")
DASH = "—"
QUANTITY_HEADERS_EXACT_3 = ("genel toplam", "toplam adet", "toplam miktar", "stok miktari", "quantity", "grand total", "overall total")
QUANTITY_HEADERS_PART_3 = ("genel toplam", "toplam adet", "toplam miktar")
QUANTITY_HEADERS_2 = ("miktar", "adet")
QUANTITY_HEADERS_1 = ("toplam", "total")
NAME_HEADERS_PART = ("malzeme adi", "urun adi", "arac gerec")
NAME_HEADERS_EXACT = ("malzeme", "urun")
CODE_LABELS = ("urun kod", "malzeme kod", "stok kod", "product code", "item code", "sku", "kod no")
TECHNICAL_TERMS = ("teknik özellik", "boyut", "ölçü", "voltaj", "gerilim", "performans", "set içeriği", "paket içeriği", "malzemeden", "üretilmiştir", "kullanım için", "içermelidir", "oluşmalıdır", "adet içermeli")
SENTENCE_PHRASE = r"(?iuU)\b(?:olmalıdır|üretilmiştir|kullanılabilir|uygundur|özelliği|özellikleri|performansı|boyutları|ölçüleri|malzemeden|dayanıklı)\b"
SPECIFICATION_NUMBER = r"(?iu)(?:\d+(?:[.,]\d+)?\s*(?:v|volt|w|watt|mm|cm|m|mikron|micron|ml|cl|l|gr|kg|hz|mah|amper)|\d+(?:[.,]\d+)?\s*[x×]\s*\d+(?:[.,]\d+)?)"
DIMENSION_PHRASE = r"(?iu)\d+(?:[.,]\d+)?\s*(?:mm|cm|m|mikron|micron)\s*(?:çap|uzunluk|genişlik|yükseklik|kalınlık)"
PACKAGING_PHRASE = r"(?iu)(?:\d+\s*['’]?\s*(?:li|lı|lu|lü)\s*(?:paket|set|kutu|ambalaj)|paket içeriği|set içeriği|\d+(?:[.,]\d+)?\s*(?:ml|cl|l)\s*[,;]?\s*(?:plastik\s+)?(?:şişe|kutu|paket|ambalaj))"
SIGNALS = {
    "mismatch": "Kaynak Malzeme Adı alanıyla eşleşmiyor",
    "lines": "Birden fazla satıra yayılıyor",
    "sentence": "Açıklama cümlesi dili içeriyor",
    "technical": "Birden fazla teknik ifade içeriyor",
    "numbers": "Birden fazla ölçü/teknik sayı içeriyor",
    "dimension": "Ürün adı yerine boyut açıklamasına benziyor",
    "packaging": "Ürün adı yerine paketleme açıklamasına benziyor",
    "full_sentence": "Ürün etiketi yerine tam cümleye benziyor",
    "punctuation": "Yoğun noktalama içeriyor",
}
MISMATCH_MESSAGE, TECHNICAL_MESSAGE = "Ürün adı kaynak Malzeme Adı alanıyla uyuşmuyor olabilir.", "Ürün adı teknik açıklama olabilir."
# type -> (text, description, sign of quantities)
BATCH_LABELS = {
    "STOK_GIRIS": ("Toplu Stok Girişi", "Toplu stok girişi", "+"),
    "STOK_CIKIS": ("Toplu Stok Çıkışı", "Toplu stok çıkışı", "−"),
    "PDF_YUKLEME": ("Toplu İçe Aktarım", "Toplu içe aktarım", "+"),
    "TOPLU_ICE_AKTARIM": ("Toplu İçe Aktarım", "Toplu içe aktarım", "+"),
    "KARMA_ISLEM": ("Karma İşlem", "Karma stok işlemi (giriş + çıkış)", ""),
}
TYPE_LABELS = {"STOK_GIRIS": "Stok Giriş", "STOK_CIKIS": "Stok Çıkış", "PDF_YUKLEME": "PDF Yükleme", "TOPLU_ICE_AKTARIM": "Toplu İçe Aktarım", "KARMA_ISLEM": "Karma İşlem"}

_JAVA_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def java_trim(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, _JAVA_TRIM, "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), in which value is evaluated once, however often f names it; neither may be a Python function."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def trim_to_null(c: Column) -> Column:
    return _blank_to_null(java_trim(c))


def turkish_lower(c: Column) -> Column:
    """Lower case with dotted and dotless i told apart; I with a combining dot is i."""
    return F.lower(F.translate(F.replace(c, F.lit("İ"), F.lit("i")), "Iİ", "ıi"))


def canonical_name(c: Column) -> Column:
    """The key under which product names match: runs of _, - and white space are one space, in Turkish lower case; empty is null."""
    return turkish_lower(_blank_to_null(F.regexp_replace(java_trim(c), r"[_\-\s]+", " ")))


def _fold_map() -> tuple[str, str]:
    """Letters of Latin-1 and Extended-A that decompose into one ASCII letter and marks, and those letters."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(k))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _fold_map()


def fold(c: Column) -> Column:
    """Without accents, in lower case, dotless i as i."""
    return F.translate(F.lower(F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{M}+", "")), "ı", "i")


def header_key(c: Column) -> Column:
    return java_trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"\s+", " "))


def alignment_key(c: Column) -> Column:
    """Name for structural comparison: folded, without a leading label, letters and digits only, single spaces; blank is null."""
    named = F.regexp_replace(fold(trim_to_null(c)), r"^(?:urun|malzeme|product|item)(?:\s+adi)?\s*:\s*", "")
    return F.regexp_replace(java_trim(F.regexp_replace(named, r"[^\p{L}\p{N}]+", " ")), r"\s+", " ")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def semantic_key(c: Column, composed: bool = False) -> Column:
    """Letters and digits of the compatibility form in Turkish lower case. composed: the text is known to be NFKC, so no Python is needed."""
    return F.regexp_replace(turkish_lower(c if composed else _nfkc(c)), r"[^\p{L}\p{N}]", "")


def structural_errors(name: Column, code: Column, quantity: Column, price: Column) -> Column:
    """Messages of what is wrong with an import row, in fixed order; empty if nothing."""
    n, k = trim_to_null(name), trim_to_null(code)
    one_space = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    checks = [
        F.when(n.isNull(), F.lit("Ürün adı boş olamaz")).when(F.length(n) > MAX_NAME, F.concat(F.lit(f"Ürün adı en fazla {MAX_NAME} karakter olabilir (alınan: "), F.length(n).cast("string"), F.lit(")"))),
        F.when(F.length(k) > MAX_CODE, F.lit(f"Ürün kodu en fazla {MAX_CODE} karakter olabilir")),
        F.when(k.rlike(r"[\x00-\x1f\x7f-\x9f]"), F.lit("Ürün kodu satır sonu veya kontrol karakteri içeremez")),
        F.when(one_space(k) == one_space(n), F.lit("Ürün kodu, ürün adından kopyalanamaz")),
        F.when(quantity.isNull(), F.lit("Geçersiz miktar: güvenilir bir miktar belirlenemedi")).when(quantity <= 0, F.concat(F.lit("Miktar 0'dan büyük olmalıdır (alınan: "), quantity.cast("string"), F.lit(")"))),
        F.when(price < 0, F.lit("Fiyat 0'dan küçük olamaz")),
    ]
    return F.array_compact(F.array(*checks))


def row_validity(errors: Column, review_required: Column) -> Column:
    return (F.size(errors) == 0) & ~review_required


def error_text(errors: Column) -> Column:
    return F.when(F.size(errors) > 0, F.array_join(errors, "; "))


def coerce_price(text: Column) -> Column:
    """Text of a price, comma or point, to a decimal; null if it is none."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^\d.\-]", "").try_cast("decimal(38,18)")


def coerce_quantity_text(text: Column) -> Column:
    """Digits of a text as an int; null without digits or beyond int."""
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("int")


def coerce_quantity(value: Column) -> Column:
    """A JSON value (variant) as a quantity: integers stay, fractions round half up, texts give their digits, anything else null."""

    def of(kind: Column) -> Column:
        fraction = bound(F.floor(F.try_variant_get(value, "$", "double") + 0.5), lambda n: F.when(n.between(-INT_MAX - 1, INT_MAX), n.cast("int")))
        return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "int")).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), fraction).when(kind == "STRING", coerce_quantity_text(F.try_variant_get(value, "$", "string")))

    return bound(F.schema_of_variant(value), of)


def positive_int_cell(c: Column) -> Column:
    t = trim_to_null(c)
    n = F.when(t.rlike(r"^[0-9]+$"), t.try_cast("int"))
    return F.when(n > 0, n)


def _any_in(c: Column, parts: tuple) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def quantity_header_score(key: Column) -> Column:
    """How surely a header key names the quantity column, 3 to 0."""
    return F.when(key.isin(*QUANTITY_HEADERS_EXACT_3) | _any_in(key, QUANTITY_HEADERS_PART_3), 3).when(key.isin(*QUANTITY_HEADERS_2), 2).when(key.isin(*QUANTITY_HEADERS_1), 1).otherwise(0)


def is_name_header(key: Column) -> Column:
    return _any_in(key, NAME_HEADERS_PART) | key.isin(*NAME_HEADERS_EXACT)


def has_code_label(context: Column) -> Column:
    return bound(fold(context), lambda t: _any_in(t, CODE_LABELS) | t.rlike(r"(?s)\n\s*kod\s*(?:[:|]|$)"))


#: The rules by which a name reads like a description, each a bit of what suspicion_rules gives: points, and the signal that is shown (a weaker form of another rule shows none).
SUSPICION_RULES = (("mismatch", 4), ("lines", 2), ("sentence", 3), ("technical", 2), ("numbers", 4), ("dimension", 4), ("packaging", 4), ("full_sentence", 2), ("punctuation", 1), (None, 1), (None, 1))


def suspicion_rules(name: Column, source_candidate: Column, composed: bool = False) -> Column:
    """The rules that a product name breaks, as bits in the order of SUSPICION_RULES; null without a name."""
    mismatch = F.coalesce(semantic_key(trim_to_null(name), composed) != semantic_key(trim_to_null(source_candidate), composed), F.lit(False))
    bit = lambda k: F.lit(1 << k)
    some = lambda test, k: F.when(test, bit(k)).otherwise(0)
    several = lambda count, k, one: bound(count, lambda c: F.when(c >= 2, bit(k)).when(c == 1, bit(one)).otherwise(0))

    def of(n: Column) -> Column:
        lines = F.size(F.filter(F.split(n, r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0)) >= 2
        terms = bound(turkish_lower(n), lambda low: sum((F.contains(low, F.lit(t)).cast("int") for t in TECHNICAL_TERMS[1:]), F.contains(low, F.lit(TECHNICAL_TERMS[0])).cast("int")))
        sentence = (F.size(F.split(n, r"\s+")) >= 12) & n.rlike(r"(?s)[.!?]\s*$")
        marks = F.length(n) - F.length(F.translate(n, ",;:.()", ""))
        return (
            some(lines, 1) + some(n.rlike(SENTENCE_PHRASE), 2) + several(terms, 3, 9) + several(F.regexp_count(n, F.lit(SPECIFICATION_NUMBER)), 4, 10)
            + some(n.rlike(DIMENSION_PHRASE), 5) + some(n.rlike(PACKAGING_PHRASE), 6) + some(sentence, 7) + some(marks >= 3, 8)
        )

    return bound(trim_to_null(name), lambda n: F.when(n.isNotNull(), of(n))) + some(mismatch, 0)


def suspicion(rules: Column) -> Column:
    """struct(suspicious, score, signals) of the bits of suspicion_rules, null being a missing name."""
    broken = lambda k: rules.bitwiseAND(F.lit(1 << k)) != 0
    score = sum((F.when(broken(k), points).otherwise(0) for k, (_, points) in enumerate(SUSPICION_RULES)), F.lit(0))
    signals = F.array_compact(F.array(*[F.when(broken(k), F.lit(SIGNALS[key])) for k, (key, _) in enumerate(SUSPICION_RULES) if key]))
    return F.struct((score >= 4).alias("suspicious"), score.alias("score"), signals.alias("signals"))


def name_suspicion(name: Column, source_candidate: Column, composed: bool = False) -> Column:
    """struct(suspicious, score, signals): whether a product name reads like a description. A table with names that repeat takes reconcile.with_suspicion."""
    return suspicion(suspicion_rules(name, source_candidate, composed))


def suspicion_message(signals: Column) -> Column:
    return F.when(F.array_contains(signals, SIGNALS["mismatch"]), MISMATCH_MESSAGE).otherwise(TECHNICAL_MESSAGE)


def name_uuid(material: Column) -> Column:
    """The version-3 UUID text of a string's bytes."""
    h = F.md5(material)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def fingerprint_item(p: Column) -> Column:
    """One product's part of a match fingerprint; null prints as null."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(F.concat_ws(":", *[text(p[k]) for k in ("id", "name", "source", "unit", "category_id", "min_stock_level", "shelf_location", "quantity")]), F.lit("|"))


def source_identity(sheet: Column, row: Column) -> Column:
    return F.concat(F.lit("xlsx:"), sheet, F.lit(":row:"), row.cast("string"))


def parse_source_identity(identity: Column) -> Column:
    """struct(sheet, row) of an xlsx identity, read greedily; null for others."""
    pattern = r"^xlsx:(.*):row:(\d+)$"
    return F.when(identity.rlike(pattern), F.struct(F.regexp_extract(identity, pattern, 1).alias("sheet"), F.regexp_extract(identity, pattern, 2).cast("bigint").alias("row")))


def normalize_source(c: Column) -> Column:
    return F.when(c == "TÜBİTAK", "Tubitak").otherwise(c)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def operation_label(kind: Column) -> Column:
    """struct(text, description, sign) of a batch type; unknown types are imports."""
    pick = lambda k: F.coalesce(_lookup({t: v[k] for t, v in BATCH_LABELS.items()}, kind), F.lit(BATCH_LABELS["PDF_YUKLEME"][k]))
    return F.struct(pick(0).alias("text"), pick(1).alias("description"), pick(2).alias("sign"))


def history_type_label(kind: Column) -> Column:
    return F.coalesce(_lookup(TYPE_LABELS, kind), kind)


def effective_type(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, hi).otherwise("KARMA_ISLEM")


def null_to_dash(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c).otherwise(DASH)


def format_ts(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy HH:mm"), F.lit(DASH))


def truncate_cell(c: Column, most: int = 40) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def clean_cell(c: Column) -> Column:
    return java_trim(F.regexp_replace(c, r"[\r\n\t]", " "))


def review_message_160(reason: Column, fallback: Column) -> Column:
    r = F.regexp_replace(trim_to_null(reason), r"\s+", " ")
    return F.when(r.isNull(), fallback).when(F.length(r) <= 160, r).otherwise(F.concat(F.substring(r, 1, 157), F.lit("...")))


def historical_summary(name: Column, source: Column, unit: Column, stock: Column) -> Column:
    return F.concat(name, F.lit(" — "), F.coalesce(trim_to_null(source), F.lit("Kaynak belirtilmemiş")), F.lit(" — "), F.coalesce(trim_to_null(unit), F.lit("Birim belirtilmemiş")), F.lit(" — stok "), stock.cast("string"))


def gap_location(source_type: Column, sheet: Column, row_start: Column, row_end: Column, page: Column, record_start: Column, record_end: Column) -> Column:
    span = lambda word, a, b: F.concat(F.lit(word + " "), a.cast("string"), F.when(a.eqNullSafe(b), F.lit("")).otherwise(F.concat(F.lit("-"), b.cast("string"))))
    named = F.when(F.length(sheet) > 0, sheet).otherwise("Çalışma sayfası")
    return F.when(source_type == "XLSX", F.concat(named, F.lit(" · "), span("satır", row_start, row_end))).when(source_type == "PDF", F.concat(F.lit("PDF sayfa "), page.cast("string"), F.lit(" · "), span("kayıt", record_start, record_end))).otherwise("Kaynak konumu belirlenen kayıt")


def stock_status(quantity: Column, least: Column) -> Column:
    return F.when(quantity <= least, "Kritik").when(quantity <= 2 * least, "Az").otherwise("İyi")
