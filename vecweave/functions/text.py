"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_keyword(text: Column, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The name of the first rule of which a keyword is in the text, without regard to case."""
    low, out = F.lower(text), F.lit(other)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(F.contains(low, F.lit(w)), F.lit(False))
        out = F.when(hit, name).otherwise(out)
    return out
