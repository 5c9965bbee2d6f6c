"""DuckDB SQL equivalents of the operators, used as the correctness oracle.

Every text starts from the same ``packets`` projection of ``events`` that the Spark
side uses, parses ``protocol_fields_json`` into a DuckDB ``MAP`` and then states the
operator's semantics independently in SQL (dimension tables as ``VALUES`` joins,
first-match rules as ``list_filter(...)[1]``).
"""

from __future__ import annotations

from collections.abc import Sequence

from sigtrace.sources.events_projection import duckdb_packets_sql


def with_packets(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with further CTEs via ``, name AS (...)``) with packets + pm."""
    return (
        ("WITH RECURSIVE" if recursive else "WITH") + " packets AS (" + duckdb_packets_sql("events") + "),\n"
        "pm AS (SELECT *, CAST(protocol_fields_json::JSON AS MAP(VARCHAR, VARCHAR)) AS m FROM packets)"
        + body
    )


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first_of(keys: Sequence[str], m: str = "m") -> str:
    return "coalesce(" + ", ".join(f"nullif({m}[{q(k)}], '')" for k in keys) + ")"


def first_present(keys: Sequence[str], m: str = "m") -> str:
    return "coalesce(" + ", ".join(f"{m}[{q(k)}]" for k in keys) + ")"


def has_key(pred: str, m: str = "m") -> str:
    """``pred`` uses the lambda variable ``k``."""
    return f"coalesce(len(list_filter(map_keys({m}), lambda k: {pred})) > 0, false)"


def first_key(pred: str, m: str = "m") -> str:
    return f"list_filter(map_keys({m}), lambda k: {pred})[1]"


def first_entry_value(pred: str, m: str = "m") -> str:
    """``pred`` uses ``e.key`` / ``e.value``."""
    return f"list_filter(map_entries({m}), lambda e: {pred})[1].value"


def keyword_case(expr: str, keywords: Sequence[str], default: str = "NULL") -> str:
    parts = " ".join(f"WHEN contains(lower({expr}), {q(w)}) THEN {q(w)}" for w in keywords)
    return f"CASE {parts} ELSE {default} END"


def any_contains(expr: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {q(w)})" for w in words) + ")"


def norm(expr: str, extra: str = "") -> str:
    return f"regexp_replace(lower({expr}), '[-_. {extra}]', '', 'g')"
