"""Literal-map lookups and small classifiers as JVM expressions.

A code table of a few dozen entries becomes a constant ``map(...)`` literal: the
lookup is an in-row linear search inside whole-stage codegen, with no join and no
exchange at all (cheaper than even a broadcast join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_literal(mapping: Mapping[str, str]) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """``mapping.get(key)``; NULL for unknown or NULL keys."""
    return map_literal(mapping)[key]


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """First keyword (in list order) contained in ``lower(text)``; NULL when none."""
    low = F.lower(text)
    expr = None
    for kw in reversed(keywords):
        expr = F.when(low.contains(kw), F.lit(kw)) if expr is None else F.when(low.contains(kw), F.lit(kw)).otherwise(expr)
    return expr


def contains_any(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out
