"""The catalogue of detector rules, and their translation from RE2 to Java regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

SEVERITY_SCORE = {"critical": 4, "high": 3, "medium": 2, "low": 1}  # anything else scores 0


@dataclass(frozen=True)
class Rule:
    ordinal: int
    type: str
    severity: str
    re2: str
    description: str

    @property
    def java(self) -> str:
        return to_java(self.re2)


# Types, severities, RE2 patterns and descriptions of the 18 rules, in order.
_CATALOGUE = [
    ("password", "critical", r"""(?i)(password\s*[=:]\s*['"]?[^\s'";]+['"]?)""", "Password assignment detected"),
    ("api_key", "critical", r"""(?i)(api[_-]?key\s*[=:]\s*['"]?[^\s'";]{20,}['"]?)""", "API Key detected"),
    ("token", "critical", r"""(?i)(token\s*[=:]\s*['"]?[A-Za-z0-9\-_.]{20,}['"]?)""", "Authentication token detected"),
    ("private_key", "critical", r"""-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY""", "Private key detected"),
    ("aws_key", "critical", r"""(AKIA[0-9A-Z]{16})""", "AWS Access Key detected"),
    ("github_token", "critical", r"""(gh[pousr]_[A-Za-z0-9_]{36,255})""", "GitHub token detected"),
    ("email", "medium", r"""\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b""", "Email address detected"),
    ("phone_number", "medium", r"""(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b""", "Phone number detected"),
    ("ssn", "high", r"""\b[0-8]\d{2}-[0-9]{2}-[0-9]{4}\b""", "Social Security Number detected"),
    ("passport", "high", r"""(?i)passport\s*[:=]\s*([A-Z]{1,2}[0-9]{6,9})""", "Passport number detected"),
    ("credit_card", "critical", r"""\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12})\b""", "Credit card number detected"),
    ("iban", "high", r"""\b[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\b""", "IBAN detected"),
    ("bic", "medium", r"""\b[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\b""", "BIC code detected"),
    ("env_var", "high", r"""(?i)export\s+[A-Z_][A-Z0-9_]*\s*=\s*['"]?[^\s'";]+['"]?""", "Environment variable assignment detected"),
    ("json_secret", "high", r"""(?i)(["\']?(api_key|password|secret|token|private_key|access_key)["\']?\s*:\s*["\']?[A-Za-z0-9\-_.]{8,}["\']?)""", "JSON secret detected"),
    ("yaml_secret", "high", r"""(?i)([a-z_]+_key|secret|password)\s*:\s*[A-Za-z0-9\-_.]{8,}""", "YAML secret detected"),
    ("connection_string", "high", r"""(?i)(connection_string|database_url|db_connection)\s*[=:]\s*['"]?[^\s'";]+['"]?""", "Connection string detected"),
    ("hardcoded_secret", "critical", r"""(?i)(secret|api_secret|private_secret)\s*[=:]\s*['"]?[A-Za-z0-9\-_.=+/]{16,}['"]?""", "Hardcoded secret detected"),
]

#: Letters that fold to an ASCII letter besides its other case, by simple case folding (fixed values).
_FOLDS = {"s": "ſ", "k": "K"}
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BLANKS = r"\t\n\f\r "


def to_java(re2: str) -> str:
    """A Java pattern that matches what RE2 matches: ASCII word boundaries, blanks without VT, and case folding spelled
    out as character classes."""
    fold = re2.startswith("(?i)")
    out, inside, i = [], False, 4 if fold else 0
    while i < len(re2):
        c = re2[i]
        if c == "\\":
            e = re2[i + 1]
            if e in "pP" and (m := re.match(r"\\[pP](?:\{[^}]*\}|.)", re2[i:])):
                out.append(m.group())  # the name of a property is no letter to fold
                i += m.end()
                continue
            out.append({"b": _BOUNDARY, "s": _BLANKS if inside else f"[{_BLANKS}]"}.get(e, c + e))
            i += 2
            continue
        if not inside and (m := re.match(r"\(\?P?<([A-Za-z][A-Za-z0-9_]*)>", re2[i:])):
            out.append(f"(?<{m[1].replace('_', 'U')}>")  # nor is that of a group, which Java spells without P and _
            i += m.end()
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]":
            inside = False
        elif fold and inside and re.match(r"[A-Za-z]-[A-Za-z]", re2[i:]):
            a, b = re2[i].lower(), re2[i + 2].lower()
            out.append(f"{a}-{b}{a.upper()}-{b.upper()}" + "".join(x for letter, x in _FOLDS.items() if a <= letter <= b))
            i += 3
            continue
        elif fold and c.isalpha() and not (re2[i - 1] == "?" and re2[i - 2] == "("):
            both = c.lower() + c.upper() + _FOLDS.get(c.lower(), "")
            out.append(both if inside else f"[{both}]")
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


RULES = [Rule(k, *r) for k, r in enumerate(_CATALOGUE)]


def rule(type_: str) -> Rule | None:
    """The first rule of a type, None where there is none."""
    return next((r for r in RULES if r.type == type_), None)


def valid_rules(rules: list[Rule], spark: SparkSession | None = None) -> list[Rule]:
    """Rules whose pattern Java compiles; the others are left out silently. Without a session all are taken as they are."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return list(rules)
    compiler, kept = spark.sparkContext._jvm.java.util.regex.Pattern, []
    for r in rules:
        try:
            compiler.compile(r.java)
            kept.append(r)
        except IllegalArgumentException:
            pass
    return kept
