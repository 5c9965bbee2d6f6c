"""Registry of checked queries: name -> (Spark builder over sf_dir, DuckDB oracle text).

Each Spark builder reads the driver's tables (through the ``packets`` projection of
``events``) and returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigtrace.sources.events_projection import packets_from_events

SparkQuery = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, SparkQuery] = {}
ORACLES: dict[str, Callable[[], str]] = {}
# name -> operator over a packets DataFrame (for queries built by ``register``)
OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(packets_from_events(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPERATORS[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def register_raw(name: str, oracle: Callable[[], str] | None = None):
    """For builders that need the session / folder themselves (ingest round trips)."""

    def deco(fn: SparkQuery):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    from sigtrace import queries  # noqa: F401  (registers everything)
