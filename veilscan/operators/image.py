"""Images of documents judged by several signals: size, shape, and what their text says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.scalar import risk_label
from .once import once


def quality(width: Column, height: Column) -> Column:
    """struct(quality_score, resolution) by the number of pixels."""
    px = width.cast("long") * height.cast("long")
    return F.struct(F.when(px > 2_000_000, 10.0).when(px > 500_000, 7.0).otherwise(3.0).alias("quality_score"), F.when(px > 2_000_000, "high").when(px > 500_000, "medium").otherwise("low").alias("resolution"))


def geometry(width: Column, height: Column) -> Column:
    """struct(document_type, geometry_score, is_photo): exact shapes first, then near ones, in order of priority; a small
    picture shaped like a portrait photo is no document. Sides that are null or 0 give no type."""
    r = F.when((width > 0) & (height > 0), width.cast("double") / height.cast("double"))
    photo = reduce(lambda a, x: a | (F.abs(r - x) < 0.05), d.PHOTO_RATIOS, F.lit(False)) & (width.cast("long") * height.cast("long") < 500_000)

    def near(x: float, tolerance: float) -> Column:
        return (F.abs(r - x) < tolerance) | (F.abs(1 / r - x) < tolerance)

    def row(kind: str | None, score: float, is_photo: bool) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("document_type"), F.lit(score).alias("geometry_score"), F.lit(is_photo).alias("is_photo"))

    out = F.when(photo, row("passport_photo", 0.0, True))
    for tolerance, score in ((0.08, 12.0), (0.15, 5.0)):
        for kind, x in d.DOCUMENT_RATIOS:
            out = out.when(near(x, tolerance), row(kind, score, False))
    return out.otherwise(row(None, 0.0, False))


def mrz_lines(text: Column) -> Column:
    """Lines of 20 bytes at least that look like a zone, with O read as 0."""
    cleaned = F.transform(F.split(text, "\n", -1), lambda x: F.translate(F.upper(F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), "O ", "0"))
    return F.filter(cleaned, lambda x: (F.octet_length(x) >= 20) & (F.length(F.regexp_replace(x, "[^A-Z0-9<]", "")) / F.octet_length(x) > 0.85))


def mrz_signal(lines: Column) -> Column:
    """struct(mrz_score, mrz_parsed, mrz_names) of such lines: 60 for a line of a known shape, 70 if the zone also parses,
    30 for lines that only resemble one."""
    shaped = F.exists(lines, lambda x: reduce(lambda a, p: a | x.rlike(p), d.IMAGE_MRZ_SHAPES, F.lit(False)))
    one, two = F.get(lines, 0), F.get(lines, 1)
    positions = [F.substring(two, p + 1, 1).rlike("^[0-9<]$") for p in (9, 13, 19, 27, 43)]
    digits = sum((F.when(p, 1).otherwise(0) for p in positions), F.lit(0))
    passport = (F.substring(one, 1, 1) == "P") & (F.octet_length(one) >= 44) & (F.octet_length(two) >= 44) & (digits >= 3)
    parsed = F.coalesce(shaped & (F.size(lines) >= 2) & (passport | F.substring(one, 1, 1).isin("I", "A", "C")), F.lit(False))
    score = F.when(parsed, 70.0).when(shaped, 60.0).when(F.size(lines) > 0, 30.0).otherwise(0.0)
    names = F.trim(F.regexp_replace(F.translate(F.substring(one, 6, 39), "<", " "), " +", " "))
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("mrz_score"), parsed.alias("mrz_parsed"), F.when(parsed, names).alias("mrz_names"))


def keyword_signal(text: Column) -> Column:
    """struct(keyword_score, keywords_found): weights of the words that occur, 30 at most."""
    low = F.lower(text)
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in d.IMAGE_KEYWORDS.items()])
    hits = F.filter(words, lambda x: F.contains(low, x["w"]))
    total = F.aggregate(hits, F.lit(0), lambda a, x: a + x["n"])
    return F.struct(F.coalesce(F.least(F.lit(30), total), F.lit(0)).cast("double").alias("keyword_score"), F.when(text.isNull(), 0).otherwise(F.size(hits)).alias("keywords_found"))


def keyword_type(text: Column) -> Column:
    low = F.lower(text)

    def has(*words: str) -> Column:
        return reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False))

    return F.when(has("passport", "паспорт"), "passport").when(has("driver", "водительское"), "driver_license").when(has("снилс"), "snils").when(has("инн"), "inn").when(has("id", "identity"), "id_card")


def structure_signal(text: Column) -> Column:
    """struct(structure_score, has_dates, has_names): 10 for two dates of one form, 10 for a zone's names, else 5 per label."""
    dates = reduce(lambda a, p: a | (F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(0))) >= 2), d.DATE_SHAPES, F.lit(False))
    zone = text.rlike("[A-Z]+<<[A-Z<]+")
    first = text.rlike(r"(?iu)(surname|фамилия|nom|nachname)\s*[:\-]?\s*[A-ZА-Яa-zа-я]+")
    second = text.rlike(r"(?iu)(given name|имя|prénom|vorname)\s*[:\-]?\s*[A-ZА-Яa-zа-я]+")
    dates, zone, first, second = (F.coalesce(x, F.lit(False)) for x in (dates, zone, first, second))
    names = F.when(zone, 10.0).otherwise(F.when(first, 5.0).otherwise(0.0) + F.when(second, 5.0).otherwise(0.0))
    return F.struct((F.when(dates, 10.0).otherwise(0.0) + names).alias("structure_score"), dates.alias("has_dates"), (zone | first | second).alias("has_names"))


def barcode_signal(text: Column) -> Column:
    score = F.when(F.contains(text, F.lit("ANSI ")) | F.contains(text, F.lit("AAMVA")), 20.0).when(F.upper(text).rlike("[A-Z0-9]{20,}"), 10.0).otherwise(0.0)
    return F.coalesce(score, F.lit(0.0))


def judged(images: DataFrame, id_col: str, width: str, height: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image: signals, final score, confidence, whether it is a document, its type, and the columns to keep.

    No pixels are read: rotations by 90 degrees only swap the sides, and every shape is compared with its inverse.
    Null texts have no text signals. The face signal is never computed.
    """
    w, h, t = F.col(width), F.col(height), F.col(text_col)
    lines = once(images.select(id_col, *keep, w.alias("w"), h.alias("h"), t.alias("t")), [id_col, *keep, "w", "h", "t"], lines=mrz_lines(F.col("t")))
    w, h, t = F.col("w"), F.col("h"), F.col("t")
    s = once(lines, [id_col, *keep], q=quality(w, h), g=geometry(w, h), m=mrz_signal(F.col("lines")), k=keyword_signal(t), kt=keyword_type(t), s=structure_signal(t), b=barcode_signal(t))
    parts = {"mrz": F.col("m.mrz_score") / 70 * 100, "keywords": F.col("k.keyword_score") / 30 * 100, "barcode": F.col("b") / 20 * 100, "geometry": F.col("g.geometry_score") / 15 * 100, "structure": F.col("s.structure_score") / 20 * 100, "quality": F.col("q.quality_score") / 10 * 100}

    def weighed(weights: dict[str, float]) -> Column:
        return reduce(lambda a, b: a + b, [parts[p] * F.lit(weights[p]) for p in parts])

    photo = F.col("g.is_photo")
    final = F.when(photo, 0.0).when(F.col("m.mrz_score") == 0, weighed(d.WEIGHTS_WITHOUT_MRZ)).otherwise(weighed(d.SIGNAL_WEIGHTS))
    told = (F.col("k.keyword_score") > 10) | (F.col("m.mrz_score") > 0) | (F.col("s.structure_score") > 10)
    out = s.withColumn("final_score", final).withColumn("is_document", ~photo & (F.col("final_score") >= 40) & told)
    confidence = F.when(photo, "Нет").when((F.col("final_score") >= 65) & told, "Высокая").when((F.col("final_score") >= 40) & told, "Средняя").when(F.col("final_score") >= 25, "Низкая").otherwise("Нет")
    kind = F.when(photo, "passport_photo").when(F.col("m.mrz_parsed"), "passport").otherwise(F.coalesce("g.document_type", "kt", F.when(F.col("is_document"), "unknown_document")))
    return out.select(
        id_col, *keep, F.col("q.quality_score").alias("quality_score"), F.col("g.geometry_score").alias("geometry_score"), F.col("m.mrz_score").alias("mrz_score"), F.col("k.keyword_score").alias("keyword_score"), F.col("k.keywords_found").alias("keywords_found"),
        F.col("s.structure_score").alias("structure_score"), F.col("b").alias("barcode_score"), F.round("final_score", 4).alias("final_score"), confidence.alias("confidence"), "is_document", kind.alias("document_type"), F.col("m.mrz_names").alias("mrz_names"),
    )


def warnings(kind: Column, risk: Column) -> Column:
    return F.array_compact(F.array(F.when(risk >= 80, d.IMAGE_WARNINGS["leak"]), F.when(risk >= 60, d.IMAGE_WARNINGS["identity"]), F.when(F.contains(kind, F.lit("passport")), d.IMAGE_WARNINGS["passport"])))


def data_found(kind: Column) -> Column:
    """What such a document holds about its owner."""
    words = {k: F.array(*map(F.lit, v)) for k, v in d.IMAGE_DATA.items()}
    return F.when(F.contains(kind, F.lit("passport")), words["passport"]).when(F.contains(kind, F.lit("id_card")) | F.contains(kind, F.lit("driver")), words["card"]).otherwise(words["other"])


def document_description(kind: Column) -> Column:
    """What a document of the kind shows of its owner."""
    pairs = F.create_map(*[F.lit(x) for kv in d.DOCUMENT_DESCRIPTION_RU.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, kind), F.lit(d.DOCUMENT_DESCRIPTION_DEFAULT))


def document_findings(judged_images: DataFrame, id_col: str, path: Column, page: Column | None = None) -> DataFrame:
    """A critical finding per image that is a document: its type is the matched text, its score the risk.

    An image is one page and stands on line 1; of pages of a PDF, page gives the number, which is the line. A zone that
    parses is named in the description, and its names are the context.
    """
    kind, zone = F.col("document_type"), F.col("mrz_names")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in d.IMAGE_TYPE_RU.items() for x in kv]), kind), F.lit(d.IMAGE_TYPE_DEFAULT))
    said, words = (d.FOUND_IN_IMAGE, d.IMAGE_CONTEXT) if page is None else (d.FOUND_IN_PDF, d.PDF_CONTEXT)
    number = F.lit(1) if page is None else page
    plain = F.format_string(words, F.col("confidence")) if page is None else F.format_string(words, number, F.col("confidence"))
    context = plain if page is not None else F.when(zone.isNotNull(), F.concat(F.lit("MRZ: "), zone)).otherwise(plain)
    risk = F.col("final_score")
    return judged_images.where("is_document").select(
        id_col, path.alias("file_path"), number.alias("line_number"), F.lit("passport").alias("pattern_type"), F.lit("critical").alias("severity"),
        F.concat(F.when(zone.isNotNull(), d.ZONE_LABEL).otherwise(label), F.lit(said)).alias("description"), kind.alias("matched_text"), context.alias("context"), risk.alias("risk_score"),
        risk_label(risk).alias("risk_level"), warnings(kind, risk).alias("warnings"), data_found(kind).alias("data_found"), document_description(kind).alias("summary"),
    )
