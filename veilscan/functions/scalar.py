"""Scalar functions on columns: entropy, risk, cards, sizes, masks and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import SIZE_UNITS

#: Words that raise the risk of a line (fixed values).
RISK_WORDS = ["password", "secret", "token", "key", "private", "credential", "auth", "api", "access", "aws"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def entropy(s: Column) -> Column:
    """Entropy over code points with the byte length as denominator; 0 below 8 bytes. Null gives null.

    A sign is counted by the bytes that are gone when it is replaced, once per distinct sign.
    """
    size = F.octet_length(s)

    def add(total: Column, sign: Column) -> Column:
        count = (size - F.octet_length(F.replace(s, sign, F.lit("")))) / F.octet_length(sign)
        p = count / size
        return total - p * F.log2(p)

    return F.when(size < 8, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), add))


def entropy_level(e: Column) -> Column:
    return F.when(e >= 5.5, "very_high").when(e >= 4.5, "high").when(e >= 3.5, "medium").otherwise("low")


def high_entropy(s: Column) -> Column:
    return entropy(s) >= 4.5


def potential_secrets(text: Column) -> Column:
    """Maximal runs of token signs, 8 at least, whose entropy is high; in order of place."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9\-_=+/:.~]{8,})"), F.lit(0)), high_entropy)


def severity_name(severity: Column) -> Column:
    """One spelling per severity."""
    return F.lower(F.trim(severity))


def severity_score(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def risk_score(severity: Column, matched: Column, line: Column, entropy_: Column | None = None) -> Column:
    """0 to 100: severity, entropy, length in bytes and risk words of the line (ASCII case folding only)."""
    e = entropy(matched) if entropy_ is None else entropy_
    n = F.octet_length(matched)
    low = F.translate(line, UPPER, LOWER)
    from_entropy = F.when(e >= 5.5, 30).when(e >= 4.5, 20).when(e >= 3.5, 10).otherwise(0)
    from_length = F.when(n >= 64, 20).when(n >= 32, 15).when(n >= 16, 10).when(n >= 8, 5).otherwise(0)
    words = sum((F.when(F.contains(low, F.lit(w)), 2).otherwise(0) for w in RISK_WORDS), F.lit(0))
    total = severity_score(severity) * 10 + from_entropy + from_length + F.least(F.lit(10), words)
    return F.least(F.lit(100), total).cast("double")


def severity_from_risk(risk: Column) -> Column:
    return F.when(risk >= 75, "critical").when(risk >= 50, "high").when(risk >= 25, "medium").otherwise("low")


def risk_label(score: Column) -> Column:
    """Band of an image's score."""
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")


def card_digits(card: Column) -> Column:
    return F.translate(card, " -", "")


def luhn_valid(card: Column) -> Column:
    """13 to 19 digits, blanks and dashes aside, whose Luhn sum fits."""
    d = card_digits(card)
    checked = F.call_function("luhn_check", F.when(d.rlike("^[0-9]+$"), d).otherwise("1"))
    return d.rlike("^[0-9]{13,19}$") & checked


def card_type(card: Column) -> Column:
    d = card_digits(card)
    two = F.substring(d, 1, 2)
    return F.when(d.startswith("4"), "Visa").when(two.isin("51", "52", "53", "54", "55"), "MasterCard").when(two.isin("34", "37"), "American Express").when(two.isin("60", "65"), "Discover").when(two == "35", "JCB").when(two.isin("36", "38"), "Diners Club").otherwise("Unknown")


def masked(s: Column) -> Column:
    """Up to 8 bytes all stars, else the first and last four signs around stars for the rest of the bytes."""
    n = F.octet_length(s)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(s, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(s, -4, 4)))


def truncated(s: Column, most: int = 100) -> Column:
    """Beyond ``most`` bytes, the first most - 3 bytes and dots; a cut sign becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, most - 3).cast("string"))
    return F.when(F.octet_length(s) > most, F.concat(cut, F.lit("..."))).otherwise(s)


def path_truncated(path: Column, most: int = 50) -> Column:
    """A long path with dots in its middle: a third of the room before them, at least 10 signs after."""
    head = most // 3
    tail = max(10, most - head - 3)
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.substring(path, 1, head), F.lit("..."), F.right(path, F.lit(tail))))


def size_text(n: Column, units: list[str] = SIZE_UNITS) -> Column:
    """Bytes in a readable unit, one decimal from the second unit on."""
    out, k = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" " + units[0]))), F.lit(1024.0)
    for i, unit in enumerate(units[1:], 1):
        part = F.format_string(f"%.1f {unit}", reduce(lambda x, _: x / k, range(i), n))
        out = out.when(n < 1024 ** (i + 1), part) if i < len(units) - 1 else out.otherwise(part)
    return out


def printable_share(s: Column) -> Column:
    """Share of bytes that are printable ASCII or tab, LF, CR; null for empty."""
    n = F.octet_length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, r"[^\x20-\x7E\n\r\t]", "")) / n)


def many_uppercase_words(s: Column) -> Column:
    """Three words at least of more than two bytes without a lower-case letter."""
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: (F.octet_length(w) > 2) & ~w.rlike(r"\p{Ll}"))
    return F.size(words) >= 3


def page_number(path: Column) -> Column:
    """The number after the last dash of a page file's name, 1 where there is none."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.element_at(F.split(name, "-"), -1).try_cast("int"), F.lit(1))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty where the last part has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]*)$", 1))
