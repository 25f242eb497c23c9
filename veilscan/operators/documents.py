"""Whole texts classified as identity, bank, tax or medical documents, and images by their shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import DOCUMENT_DETECTORS
from ..functions.rules import to_java


def classify(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, document_type, type_label, risk_level, confidence, indicators): one row per text and type that its confidence
    reaches, in the order of the detectors. Null and empty texts have none.

    Every pattern runs once per text; confidences add up in double precision in the order listed, and are capped at 1.
    """
    low, text = F.lower("t"), F.col("t")
    hits = {
        f"h{k}_{j}": (low if where == "lower" else text).rlike(to_java(pattern))
        for k, (*_, parts) in enumerate(DOCUMENT_DETECTORS)
        for j, (_, where, pattern, _) in enumerate(parts)
    }
    seen = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("t")).select(id_col, *[c.alias(n) for n, c in hits.items()])
    found = []
    for k, (name, label, risk, threshold, parts) in enumerate(DOCUMENT_DETECTORS):
        confidence = reduce(lambda a, b: a + b, [F.when(F.col(f"h{k}_{j}"), F.lit(weight)).otherwise(F.lit(0.0)) for j, (weight, *_) in enumerate(parts)])
        indicators = F.array_compact(F.array(*[F.when(F.col(f"h{k}_{j}"), said) for j, (*_, said) in enumerate(parts)]))
        row = F.struct(F.lit(name).alias("document_type"), F.lit(label).alias("type_label"), F.lit(risk).alias("risk_level"), F.least(F.lit(1.0), confidence).alias("confidence"), indicators.alias("indicators"))
        found.append(F.when(confidence >= threshold, row))
    return seen.select(id_col, F.inline(F.array_compact(F.array(*found))))


def image_shape(width: Column, height: Column) -> Column:
    """struct(document_type, confidence) by the ratio of the sides; later shapes win; null where none fits."""
    r = F.when((width > 0) & (height > 0), F.greatest(width, height) / F.least(width, height))
    kind = F.when(r.between(1.4, 1.45), "bank_statement").when(r.between(1.35, 1.5), "passport").when(r.between(1.5, 1.7), "id_card")
    sure = F.when(r.between(1.4, 1.45), 0.2).when(r.between(1.35, 1.5), 0.25).when(r.between(1.5, 1.7), 0.3)
    return F.when(kind.isNotNull(), F.struct(kind.alias("document_type"), sure.alias("confidence")))
