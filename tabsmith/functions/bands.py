"""Banding rules turned into ``when`` chains.

Fixed values that must equal the reference's (thresholds and labels as the
published report files spell them), kept together in natural order:

* skewness label (D2): > 2 "严重右偏", > 1 "中度右偏", > 0.5 "轻度右偏",
  > -0.5 "近似对称", > -1 "轻度左偏", > -2 "中度左偏", else "严重左偏".
* kurtosis label (D3): > 3 "高峰态", > 0 "中峰态", else "低峰态".
* clipping class (D4) on abs(skew): < 1 "light_skew", < 2 "moderate_skew",
  else "heavy_skew".
* profile skew bands (C4): abs > 2 severe, 1 < abs <= 2 moderate.
* training level (K13): >= 0.9, >= 0.8, >= 0.6, else.
* test level (M15): >= 0.8, >= 0.6, >= 0.4, else.
* prediction grade (L7): >= 20, >= 15, >= 10, else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SKEW_LABELS: list[tuple[float, str]] = [
    (2.0, "严重右偏"),
    (1.0, "中度右偏"),
    (0.5, "轻度右偏"),
    (-0.5, "近似对称"),
    (-1.0, "轻度左偏"),
    (-2.0, "中度左偏"),
]
SKEW_ELSE = "严重左偏"

KURT_LABELS: list[tuple[float, str]] = [(3.0, "高峰态"), (0.0, "中峰态")]
KURT_ELSE = "低峰态"

CLIP_CLASSES: list[tuple[float, str]] = [(1.0, "light_skew"), (2.0, "moderate_skew")]
CLIP_ELSE = "heavy_skew"

TRAIN_LEVELS: list[float] = [0.9, 0.8, 0.6]
TEST_LEVELS: list[float] = [0.8, 0.6, 0.4]
LEVEL_NAMES: list[str] = ["excellent", "good", "fair", "poor"]

GRADE_LEVELS: list[float] = [20.0, 15.0, 10.0]
GRADE_NAMES: list[str] = ["high", "medium-high", "medium", "low"]


def above(c: Column, cuts: Sequence[tuple[float, str]], otherwise: str, strict: bool = True) -> Column:
    """First band whose lower cut ``c`` exceeds (``>``, or ``>=`` if not strict)."""
    expr = None
    for cut, label in cuts:
        cond = c > F.lit(cut) if strict else c >= F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def below(c: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    expr = None
    for cut, label in cuts:
        cond = c < F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def skew_label(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(above(c, SKEW_LABELS, SKEW_ELSE))


def kurt_label(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(above(c, KURT_LABELS, KURT_ELSE))


def clip_class(skew: Column) -> Column:
    """Light/moderate/heavy on abs(skew); a NULL skew (constant column) is light."""
    return below(F.coalesce(F.abs(skew), F.lit(0.0)), CLIP_CLASSES, CLIP_ELSE)


def level(c: Column, cuts: Sequence[float] = TRAIN_LEVELS, names: Sequence[str] = LEVEL_NAMES) -> Column:
    return above(c, list(zip(cuts, names[:-1])), names[-1], strict=False)
