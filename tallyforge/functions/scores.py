"""Column functions over scores, logits and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-7


def logit(score: Column) -> Column:
    """ln(p / (1 - p)) of the score held to [CLIP, 1 - CLIP]."""
    p = F.least(F.greatest(score, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def hard(x: Column) -> Column:
    """The decision of a logit: 1 from 0 on."""
    return (x >= 0).cast("int")


def usable(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def softmax(v: Column) -> Column:
    """v if it sums to 1 within 0.001, else its softmax."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.abs(total(v) - 1) <= 1e-3, v).otherwise(F.transform(e, lambda x: x / total(e)))


def hardness(label: Column, score: Column) -> Column:
    """How wrong the score is: 1 - score for label 1, score for label 0."""
    return F.when(label == 1, 1 - score).otherwise(score)


def band_weight(pct: Column, lo: float, hi: float) -> Column:
    """From a half at the band's foot to one at its top."""
    return 0.5 + 0.5 * (pct - lo) / (hi - lo)


def section(pct: Column, lo: float, hi: float) -> Column:
    """noise above the band, band, easy below it."""
    return F.when(pct > hi, "noise").when(pct >= lo, "band").otherwise("easy")


def shown(x: Column, digits: int = 3) -> Column:
    """Half-even rounding; null when missing or not finite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x, digits))


def forgiving(text: Column) -> Column:
    """A number from JSON-like text; booleans and other text give null."""
    return F.when(F.lower(F.trim(text)).isin("true", "false"), None).otherwise(text.try_cast("double"))
