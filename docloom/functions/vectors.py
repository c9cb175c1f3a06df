"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-8) -> Column:
    """The vector at length one; lengths below ``least`` count as it."""
    lengths = F.array_repeat(F.greatest(norm(v), F.lit(least)), F.size(v))
    return F.zip_with(v, lengths, lambda x, n: x / n)


def cosine_of_l2(d: Column) -> Column:
    """Cosine of unit vectors from their squared distance, cut to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - d / 2.0))


def section_weight(section: Column, config: EngineConfig) -> Column:
    pairs = [F.lit(x) for item in config.section_weights.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), section), F.lit(config.default_section_weight))


def final_score(similarity: Column, weight: Column) -> Column:
    """Similarity at 4 digits times weight, at 4 digits again."""
    return F.round(F.round(similarity, 4) * weight, 4)
