"""Texts to lines to matches to findings, all in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, Rule
from ..functions.scalar import entropy, risk_score

#: What a line must hold for a rule to match (fixed values): strings in the line, strings in the line in lower case, or a
#: cheap pattern. The long s folds to s and is no lower-case letter of it, so lines with it are always looked at.
HINTS: dict[str, tuple[str, list[str]]] = {
    "password": ("lower", ["password"]), "api_key": ("lower", ["api"]), "token": ("lower", ["token"]), "private_key": ("plain", ["-----BEGIN"]), "aws_key": ("plain", ["AKIA"]), "github_token": ("plain", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]),
    "email": ("plain", ["@"]), "phone_number": ("pattern", ["[0-9]{4}"]), "ssn": ("pattern", ["[0-9]-[0-9]{2}-[0-9]"]), "passport": ("lower", ["passport"]), "credit_card": ("pattern", ["[0-9]{13}"]), "iban": ("pattern", ["[A-Z]{2}[0-9]{2}"]), "bic": ("pattern", ["[A-Z]{6}"]),
    "env_var": ("lower", ["export"]), "json_secret": ("lower", ["_key", "password", "secret", "token"]), "yaml_secret": ("lower", ["_key", "password", "secret"]), "connection_string": ("lower", ["connection_string", "database_url", "db_connection"]), "hardcoded_secret": ("lower", ["secret"]),
}
MAX_LINE = 65536


def lines(texts: DataFrame, id_col: str, text_col: str, strip_cr: bool = False) -> DataFrame:
    """(id, line_number, line): lines from 1 on; blank lines are left out but counted. Null texts have none.

    A file's lines lose one CR at their end (strip_cr); already extracted texts keep it.
    """
    out = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("k", "line"))
    line = F.regexp_replace("line", "\r$", "") if strip_cr else F.col("line")
    return out.select("id", (F.col("k") + 1).alias("line_number"), line.alias("line")).where(F.trim("line") != "")


def too_long_lines(text: Column) -> Column:
    """Whether a file has a line of 64 KiB or more, which ends its scan with an error and no findings."""
    return F.coalesce(F.array_max(F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x))) >= MAX_LINE, F.lit(False))


def _may_match(rule: Rule, line: Column, low: Column) -> Column:
    kind, words = HINTS.get(rule.type, ("pattern", [""]))
    if kind == "pattern":
        return line.rlike(words[0])
    hits = [F.contains(low if kind == "lower" else line, F.lit(w)) for w in words]
    return reduce(lambda a, b: a | b, hits + ([F.contains(line, F.lit("ſ"))] if kind == "lower" else []))


def _found(rules: list[Rule]) -> Column:
    """Per line the rules with a match, each with its matches; a rule's pattern runs only where its hint holds."""
    line, low = F.col("line"), F.col("low")
    per_rule = [
        F.when(
            _may_match(r, line, low),
            F.struct(F.lit(r.ordinal).alias("ordinal"), F.lit(r.type).alias("pattern_type"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"), F.regexp_extract_all(line, F.lit(r.java), F.lit(0)).alias("m")),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*per_rule))


def matches(lines_: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(id, line_number, line, ordinal, pattern_type, severity, description, matched_text, column_start, column_end):
    every match of every rule; offsets count bytes, the end is exclusive."""
    per_rule = lines_.withColumn("low", F.lower("line")).select("id", "line_number", "line", F.inline(_found(rules))).where(F.size("m") > 0)
    # only lines with a match are cut again, for the bytes between matches
    gaps = reduce(lambda c, r: c.when(F.col("ordinal") == r.ordinal, F.split("line", r.java, -1)), rules[1:], F.when(F.col("ordinal") == rules[0].ordinal, F.split("line", rules[0].java, -1)))
    placed = per_rule.withColumn("gaps", gaps).select("*", F.posexplode("m").alias("k", "matched_text"))

    def bytes_of(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, x: n + F.octet_length(x))

    start = bytes_of(F.slice("gaps", F.lit(1), F.col("k") + 1)) + bytes_of(F.slice("m", F.lit(1), F.col("k")))
    return placed.select("id", "line_number", "line", "ordinal", "pattern_type", "severity", "description", "matched_text", start.alias("column_start"), (start + F.octet_length("matched_text")).alias("column_end"))


def findings(texts: DataFrame, id_col: str, text_col: str, rules: list[Rule] = RULES, strip_cr: bool = False) -> DataFrame:
    """One row per match, scored. No shuffle: lines are matched where they are read."""
    found = matches(lines(texts, id_col, text_col, strip_cr), rules).withColumn("entropy_score", entropy(F.col("matched_text")))
    risk = risk_score(F.col("severity"), F.col("matched_text"), F.col("line"), F.col("entropy_score"))
    return found.select(F.col("id").alias(id_col), "line_number", "column_start", "column_end", "pattern_type", "severity", "description", "matched_text", F.col("line").alias("context"), "entropy_score", risk.alias("risk_score"))


def keyword_lines(texts: DataFrame, id_col: str, text_col: str, keyword: str) -> DataFrame:
    """(id, line_number) of lines that hold the keyword, letter case aside."""
    return lines(texts, id_col, text_col).where(F.contains(F.lower("line"), F.lit(keyword.lower()))).select(F.col("id").alias(id_col), "line_number")
