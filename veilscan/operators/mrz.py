"""Machine-readable zones (ICAO 9303): lines, type, fields, check digits and score, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import MRZ_SHAPES
from .once import once

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILLERS = "«»−-–—_"  # fixed values: signs that scanning makes of the filler


def clean_line(line: Column) -> Column:
    """Upper case, without blanks at the ends and inside, filler look-alikes as <."""
    return F.translate(F.translate(F.upper(F.trim(F.regexp_replace(line, r"^[\t\r\f ]+|[\t\r\f ]+$", ""))), FILLERS, "<" * len(FILLERS)), " ", "")


def is_mrz_line(line: Column) -> Column:
    n = F.octet_length(line)
    share = F.length(F.regexp_replace(line, "[^A-Z0-9<]", "")) / n
    return n.between(28, 46) & (share >= 0.9) & ((share > 0.95) | n.isin(30, 36, 44))


def zone_lines(text: Column) -> Column:
    """The lines of a text that a zone may have."""
    return F.filter(F.transform(F.split(text, "\n", -1), clean_line), is_mrz_line)


def zone(lines: Column) -> Column:
    """Of such lines those that make up the zone: two of 44, else two of 36, else three of 30, else the first two."""

    def of(n: int) -> Column:
        return F.filter(lines, lambda x: F.octet_length(x) == n)

    return F.when(F.size(of(44)) >= 2, F.slice(of(44), 1, 2)).when(F.size(of(36)) >= 2, F.slice(of(36), 1, 2)).when(F.size(of(30)) >= 3, F.slice(of(30), 1, 3)).otherwise(F.slice(lines, 1, 2))


def zone_type(lines: Column) -> Column:
    """TD3, MRVA, MRVB, TD2, TD1 or Unknown by first sign and length."""
    first, second = F.get(lines, 0), F.get(lines, 1)
    both = F.least(F.octet_length(first), F.octet_length(second))
    head = F.substring(first, 1, 1)
    return (
        F.when((F.size(lines) >= 2) & (both >= 44) & (head == "P"), "TD3")
        .when((F.size(lines) >= 2) & (both >= 44) & (head == "V"), "MRVA")
        .when((F.size(lines) >= 2) & (both >= 36) & (head == "V"), "MRVB")
        .when((F.size(lines) >= 2) & (both >= 36), "TD2")
        .when((F.size(lines) >= 3) & (F.octet_length(first) >= 30), "TD1")
        .otherwise("Unknown")
    )


def unfilled(s: Column) -> Column:
    """Fillers as blanks, one between words, none outside."""
    return F.trim(F.regexp_replace(F.translate(s, "<", " "), " {2,}", " "))


def check_digit(data: Column) -> Column:
    """Weights 7, 3, 1 over digits, letters from 10 and fillers as 0; -1 where another sign occurs."""
    signs = F.split(F.upper(data), "")
    weighed = F.transform(signs, lambda c, i: F.when(c == "<", 0).when(F.instr(F.lit(ALPHABET), c) > 0, (F.instr(F.lit(ALPHABET), c) - 1) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int"))))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(data) > 0, F.coalesce(total % 10, F.lit(-1))).otherwise(0)


def check_digit_fits(data: Column, digit: Column) -> Column:
    """Whether the digit is the data's; a filler in its place never fits."""
    return F.coalesce(digit.rlike("^[0-9]$") & (check_digit(data) == digit.try_cast("int")), F.lit(False))


def valid_date(yymmdd: Column) -> Column:
    return F.coalesce(yymmdd.rlike("^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$"), F.lit(False))


def _names(part: Column) -> tuple[Column, Column]:
    at = F.instr(part, "<<")
    return unfilled(F.when(at > 0, part.substr(F.lit(1), at - 1)).otherwise(part)), F.when(at > 0, unfilled(part.substr(at + 2, F.length(part)))).otherwise("")


def parsed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text with a zone: type, fields, check digits, score and validity.

    Only TD3 has check digits, so that no other type is ever valid; MRVA has no field layout. Texts without a zone, null
    and empty ones have no row.
    """
    every = once(texts, [id_col], every=zone_lines(F.col(text_col))).where(F.size("every") > 0)
    z = once(once(every, [id_col], lines=zone(F.col("every"))), [id_col, "lines"], mrz_type=zone_type(F.col("lines")))
    one, two, three = F.get("lines", 0), F.get("lines", 1), F.get("lines", 2)
    kind = F.col("mrz_type")
    two_line, td3, td1 = kind.isin("TD3", "TD2", "MRVB"), kind == "TD3", kind == "TD1"

    def cut(line: Column, a: int, n: int) -> Column:
        return F.substring(line, a + 1, n)

    def pick(in_two: Column, in_one: Column) -> Column:
        return F.when(two_line, in_two).when(td1, in_one).otherwise("")

    name_part = F.when(td3, cut(one, 5, 39)).when(kind.isin("TD2", "MRVB"), cut(one, 5, 31)).when(td1, cut(three, 0, 30)).otherwise("")
    surname, given = _names(name_part)
    fields = once(
        z, [id_col, "lines", "mrz_type"],
        F.when(two_line | td1, cut(one, 0, 1)).otherwise("").alias("type_code"), F.when(two_line | td1, unfilled(cut(one, 2, 3))).otherwise("").alias("issuing_country"),
        surname.alias("surname"), given.alias("given_names"), unfilled(pick(cut(two, 0, 9), cut(one, 5, 9))).alias("document_number"), unfilled(pick(cut(two, 10, 3), cut(two, 15, 3))).alias("nationality"),
        pick(cut(two, 13, 6), cut(two, 0, 6)).alias("date_of_birth"), pick(cut(two, 20, 1), cut(two, 7, 1)).alias("sex"), pick(cut(two, 21, 6), cut(two, 8, 6)).alias("expiry_date"),
        F.when(td3, unfilled(cut(two, 28, 14))).otherwise("").alias("personal_number"),
        F.when(td3, F.create_map(
            F.lit("document_number"), check_digit_fits(cut(two, 0, 9), cut(two, 9, 1)), F.lit("date_of_birth"), check_digit_fits(cut(two, 13, 6), cut(two, 19, 1)),
            F.lit("expiry_date"), check_digit_fits(cut(two, 21, 6), cut(two, 27, 1)), F.lit("personal_number"), check_digit_fits(cut(two, 28, 14), cut(two, 42, 1)),
            F.lit("overall"), check_digit_fits(F.concat(cut(two, 0, 10), cut(two, 13, 7), cut(two, 21, 22)), cut(two, 43, 1)),
        )).alias("check_digit_results"),
    )
    checks = F.map_values("check_digit_results")
    passed = F.coalesce(F.size(F.filter(checks, lambda x: x)), F.lit(0))
    passed = F.when(F.col("check_digit_results").isNotNull(), passed).otherwise(0)

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    score = F.when(F.col("check_digit_results").isNotNull(), passed / 5 * 40).otherwise(0.0) + points(F.col("surname") != "", 10) + points(F.col("given_names") != "", 10) + points(F.col("document_number") != "", 10) + points(valid_date(F.col("date_of_birth")), 10) + points(valid_date(F.col("expiry_date")), 10) + points(F.octet_length("nationality") == 3, 5) + points(F.col("sex").isin("M", "F", "<"), 5)
    return fields.withColumn("checks_passed", passed).withColumn("validation_score", score.cast("double")).withColumn("is_valid", (F.col("validation_score") >= 50) & (F.col("checks_passed") > 0))


def looks_like_mrz(s: Column) -> Column:
    """28 bytes at least, 95 % of them A-Z, digits or fillers, with a letter and a digit or filler."""
    n = F.octet_length(s)
    valid = F.length(F.regexp_replace(s, "[^A-Z0-9<]", ""))
    return (n >= 28) & (valid / n >= 0.95) & s.rlike("[A-Z]") & s.rlike("[0-9<]") & s.rlike(r"^[\p{Lu}\p{Nd}]")


def found_lines(text: Column) -> Column:
    """Every zone-like string of a text, in first-seen order by shape, each once."""
    up = F.upper(text)
    hits = F.flatten(F.array(*[F.regexp_extract_all(up, F.lit(f"({p})"), F.lit(0)) for p in MRZ_SHAPES]))
    return F.filter(F.array_distinct(hits), looks_like_mrz)
