"""Per-key ordered scans in one pass, with no key in one task.

A window ``partitionBy(key).orderBy(order)`` sends every row of a key to a single task; when one
UE or session holds a third of all packets, that task is the whole job.  :func:`scan` carries the
position, previous values, last non-null values and a last-row flag of a key together:

1. One aggregate counts the rows of each key.  Keys with more than ``chunk_rows`` rows are *heavy*:
   their quantiles of the ordering column cut them into at most ``PARTS`` chunks of about equally
   many rows, whatever the gaps between the values.  All other keys are one chunk.
2. One window per (key, chunk) - a single shuffle and sort - works out everything inside the chunk.
3. For heavy keys a summary row per chunk carries what enters the next chunks; it joins the rows
   again (a few rows, so a broadcast join).  Without heavy keys the summary is empty.

The ordering column is numeric; rows with a NULL come first, as in a window.  Rows with the
same value are in no particular order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1_000_000  # rows of a key that one task may see
PARTS = 1_000  # chunks of a heavy key at most
_ACCURACY = 10 * PARTS


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the key columns, named ``prefix + key`` in ``b``."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[prefix + k])
    return out


def heavy_keys(df: DataFrame, key: str | Sequence[str], order: str, chunk_rows: int = DEFAULT_CHUNK) -> DataFrame:
    """Keys with more than ``chunk_rows`` rows and the values of ``order`` that cut them (ascending array ``_cuts``)."""
    keys = _keys(key)
    # of each key about one row in `every` gives its value, so a heavy key has PARTS values or more and others hardly any
    every = max(1, chunk_rows // PARTS)
    some = F.col(order) if every == 1 else F.when(F.pmod(F.xxhash64(order), F.lit(every)) == 0, F.col(order))
    # summed by key and value first, which is a plain hash aggregate; only one row a key and the values go to the quantiles
    summed = df.groupBy(*keys, some.alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    cuts = F.percentile_approx("_v", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), _ACCURACY)
    heavy = summed.groupBy(*keys).agg(F.sum("_k").alias("_n"), cuts.alias("_cuts")).where(F.col("_n") > chunk_rows)
    return heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.coalesce(F.array_distinct("_cuts"), F.array().cast("array<bigint>")).alias("_cuts"))


def chunked(df: DataFrame, key: str | Sequence[str], order: str, chunk_rows: int = DEFAULT_CHUNK) -> DataFrame:
    """``df`` with ``_chunk``: 0 for all rows of an ordinary key, 1, 2, ... in order for those of a heavy one."""
    keys = _keys(key)
    heavy = heavy_keys(df, keys, order, chunk_rows)
    d = df.join(heavy, _same(df, heavy, keys, "_h_"), "left")
    value = F.col(order)
    below = F.size(F.filter("_cuts", lambda c: F.coalesce(c < value, F.lit(False))))
    return d.withColumn("_chunk", F.when(F.col("_cuts").isNull(), 0).otherwise(1 + below).cast("int")).drop("_cuts", *[f"_h_{k}" for k in keys])


def scan(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    seq: str | None = None,
    lag: Mapping[str, str] | None = None,
    last_value: Mapping[str, str | Column] | None = None,
    switched: Mapping[str, tuple[str, Mapping[str | None, Column]]] | None = None,
    running: Mapping[str, str | Column] | None = None,
    last: str | None = None,
    chunk_rows: int = DEFAULT_CHUNK,
) -> DataFrame:
    """``df`` with the asked columns, all from one pass over each key by ``order``.

    * ``seq``: position of the row, from 1.
    * ``lag``: ``{new column: column}``, the value on the previous row.
    * ``last_value``: ``{new column: column}``, the last non-null value up to the row.
    * ``switched``: ``{new column: (name, {state: column})}``, the last non-null value up to the row of the column
      that the ``last_value`` column ``name`` chooses on each row (the state None stands for no value yet).
    * ``running``: ``{new column: column}``, the sum of a whole-numbered column up to the row.
    * ``last``: whether the row is the last of its key.
    """
    keys, lag, last_value, switched, running = _keys(key), dict(lag or {}), dict(last_value or {}), dict(switched or {}), dict(running or {})
    column = lambda c: F.col(c) if isinstance(c, str) else c
    d = chunked(df, keys, order, chunk_rows)
    by = Window.partitionBy(*keys, "_chunk").orderBy(F.asc_nulls_first(order))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)

    # inside the chunk
    new = {"_row": F.row_number().over(by)}
    new |= {f"_lag_{n}": F.lag(column(c)).over(by) for n, c in lag.items()}
    new |= {f"_val_{n}": F.last(column(c), ignorenulls=True).over(upto) for n, c in last_value.items()}
    new |= {f"_sum_{n}": F.sum(column(c).cast("bigint")).over(upto) for n, c in running.items()}
    if last:
        new["_after"] = F.lead(F.lit(1)).over(by)
    d = d.withColumns(new)
    states: dict[str, list[str | None]] = {}
    more = {}
    for n, (of, columns) in switched.items():
        states[n] = list(columns)
        for i, state in enumerate(states[n]):  # for each state that may enter the chunk
            now = F.coalesce(F.col(f"_val_{of}"), F.lit(state).cast("string"))
            chosen = F.lit(None).cast("string")
            for other, c in columns.items():
                chosen = F.when(now.eqNullSafe(F.lit(other).cast("string")), c).otherwise(chosen)
            more[f"_set_{n}_{i}"] = chosen
    d = d.withColumns(more) if more else d
    if more:
        d = d.withColumns({f"_run_{n}_{i}": F.last(f"_set_{n}_{i}", ignorenulls=True).over(upto) for n in switched for i in range(len(states[n]))})

    # what enters the chunks of heavy keys
    ends = [F.max("_row").alias("_n")]
    ends += [F.max_by(column(c), F.col("_row")).alias(f"_end_{n}") for n, c in lag.items()]
    ends += [F.max_by(f"_val_{n}", F.col("_row")).alias(f"_end_{n}") for n in last_value]
    ends += [F.max_by(f"_run_{n}_{i}", F.col("_row")).alias(f"_end_{n}_{i}") for n in switched for i in range(len(states[n]))]
    ends += [F.sum(column(c).cast("bigint")).alias(f"_end_{n}") for n, c in running.items()]
    chunks = d.where("_chunk > 0").groupBy(*keys, "_chunk").agg(*ends)
    whole = Window.partitionBy(*keys).orderBy("_chunk")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    entering = chunks.select(
        "*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.lead(F.lit(1)).over(whole).alias("_more"),
        *[F.lag(f"_end_{n}").over(whole).alias(f"_in_{n}") for n in lag],
        *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in last_value],
        *[F.sum(f"_end_{n}").over(before).alias(f"_in_{n}") for n in running],
    )
    for n, (of, _) in switched.items():
        left = F.lit(None).cast("string")
        for i, state in enumerate(states[n]):
            left = F.when(F.col(f"_in_{of}").eqNullSafe(F.lit(state).cast("string")), F.col(f"_end_{n}_{i}")).otherwise(left)
        entering = entering.withColumn(f"_left_{n}", left).withColumn(f"_in_{n}", F.last(f"_left_{n}", ignorenulls=True).over(before))
    kept = ["_off", "_more", *[f"_in_{n}" for n in (*lag, *last_value, *switched, *running)]]
    entering = entering.select(*[F.col(k).alias(f"_s_{k}") for k in (*keys, "_chunk")], *kept)

    out = d.join(entering, _same(d, entering, [*keys, "_chunk"], "_s_"), "left")
    new = {}
    if seq:
        new[seq] = F.col("_row") + F.coalesce("_off", F.lit(0))
    for n in lag:
        new[n] = F.when((F.col("_row") == 1) & (F.col("_chunk") > 0), F.col(f"_in_{n}")).otherwise(F.col(f"_lag_{n}"))
    for n in last_value:
        new[n] = F.coalesce(f"_val_{n}", f"_in_{n}")
    for n, (of, _) in switched.items():
        run = F.lit(None).cast("string")
        for i, state in enumerate(states[n]):
            run = F.when(F.col(f"_in_{of}").eqNullSafe(F.lit(state).cast("string")), F.col(f"_run_{n}_{i}")).otherwise(run)
        new[n] = F.coalesce(run, f"_in_{n}")
    for n in running:
        new[n] = F.coalesce(f"_sum_{n}", F.lit(0)) + F.coalesce(f"_in_{n}", F.lit(0))
    if last:
        new[last] = F.col("_after").isNull() & F.col("_more").isNull()
    out = out.withColumns(new)
    return out.select(*df.columns, *new)


def sequence(df: DataFrame, key: str | Sequence[str], order: str, lag_cols: Sequence[str] = (), seq_col: str = "seq", prev_prefix: str = "prev_", chunk_size: int = DEFAULT_CHUNK, last_col: str | None = None) -> DataFrame:
    """Add ``seq_col`` (position within ``key`` by ``order``), ``prev_<c>`` columns and, with ``last_col``, a last-row flag."""
    return scan(df, key, order, seq=seq_col, lag={f"{prev_prefix}{c}": c for c in lag_cols}, last=last_col, chunk_rows=chunk_size)


def carry_forward(df: DataFrame, key: str | Sequence[str], order: str, col: str, out_col: str, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """``out_col`` = last non-null ``col`` at or before each row within ``key`` (by ``order``)."""
    return scan(df, key, order, last_value={out_col: col}, chunk_rows=chunk_size)
