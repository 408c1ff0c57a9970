"""Softmax, verdict rules, labels and vector products as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ["SUPPORTED", "CONTRADICTED", "UNSUPPORTED"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: as a lambda's variable it can't be copied to each place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of array<double> logits, shifted by the largest."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def nli_verdict(entailment: Column, contradiction: Column, supported: float = 0.70, contradicted: float = 0.70) -> Column:
    return F.when(entailment >= supported, "SUPPORTED").when(contradiction >= contradicted, "CONTRADICTED").otherwise("UNSUPPORTED")


def nli_confidence(entailment: Column, contradiction: Column, neutral: Column, supported: float = 0.70, contradicted: float = 0.70) -> Column:
    return F.when(entailment >= supported, entailment).when(contradiction >= contradicted, contradiction).otherwise(neutral)


def normalize_label(label: Column) -> Column:
    """SUP, CON, NEI and the long names; anything else is UNSUPPORTED."""
    name = F.upper(F.trim(label))
    return F.when(name.isin("SUP", "SUPPORTED"), "SUPPORTED").when(name.isin("CON", "CONTRADICTED"), "CONTRADICTED").otherwise("UNSUPPORTED")


def badge(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH TRUST").when(score >= 0.60, "MODERATE TRUST").otherwise("LOW TRUST / CONTRADICTED")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def first_largest(names: list[str]) -> Column:
    """Name of the first column that holds the largest value."""
    values = F.array(*[F.col(n) for n in names])
    return F.element_at(F.array(*[F.lit(n.removeprefix("p_")) for n in names]), F.array_position(values, F.array_max(values)).cast("int"))
