"""Room classification by area, eccentricity and solidity: ordered rules, each with a confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    category: str
    test: Callable[[Column, Column, Column], Column]
    score: Callable[[Column, Column, Column], Column]


def ramp(x: Column, start: float, width: float) -> Column:
    """0 below ``start``, 1 from ``start + width``, linear between."""
    return F.least(F.greatest((x - start) / width, F.lit(0.0)), F.lit(1.0))


# thresholds and confidence terms are fixed values; a = area in m2, e = eccentricity, s = solidity
RULES = [
    Rule("Hallway / Corridor", "hallway", lambda a, e, s: (e > 0.85) & (a < 40), lambda a, e, s: 0.55 + ramp(e, 0.85, 0.12) * 0.38 + ramp(-a, -45.0, 45.0) * 0.07),
    Rule("Bathroom / Storage", "bathroom", lambda a, e, s: a < 7.0, lambda a, e, s: 0.55 + (7.0 - a) / 14.0),
    Rule("Open Plan / Lobby", "common", lambda a, e, s: (a > 80.0) & (s > 0.85), lambda a, e, s: 0.60 + ramp(a, 80.0, 120.0) * 0.25 + ramp(s, 0.85, 0.14) * 0.15),
    Rule("Conference Room", "office", lambda a, e, s: a > 40.0, lambda a, e, s: 0.55 + (a - 40.0) / 100.0),
    Rule("Irregular Space", "unknown", lambda a, e, s: s < 0.70, lambda a, e, s: 0.50 + (0.70 - s) / 0.60),
    Rule("Office / Meeting", "office", lambda a, e, s: F.lit(True), lambda a, e, s: 0.50 + F.greatest(1.0 - F.abs(a - 18.0) / 25.0, F.lit(0.0)) * 0.25 + ramp(s, 0.60, 0.35) * 0.15),
]


def classify_room(area: Column, ecc: Column, sol: Column) -> Column:
    """``struct<label, category, confidence>`` of the first rule that holds."""
    out = None
    for rule in reversed(RULES):
        score = F.least(F.greatest(rule.score(area, ecc, sol), F.lit(0.0)), F.lit(1.0))
        one = F.struct(F.lit(rule.label).alias("label"), F.lit(rule.category).alias("category"), score.alias("confidence"))
        out = one if out is None else F.when(rule.test(area, ecc, sol), one).otherwise(out)
    return out
