"""Ordered finite-state scans per key, split into chunks where a key is heavy.

Some per-key sequences carry state that depends on itself (the next phase depends on the current
phase name and length), so neither a window nor an aggregate can express them.

* An ordinary key (at most ``chunk_size`` rows) is one chunk, replayed from the initial state in one sorted pass.
* A heavy key is cut by rows into at most ``ordered.PARTS`` chunks.  Each is summarised in one row as its
  *transfer function*: arrays with, for every entry state, the exit state and the number of openings.
  Composing a key's functions in order (at most ``PARTS`` rows, a bounded task) gives every chunk's entry
  state, and the same sorted pass replays each chunk from there.  So the packets of a key that
  holds a third of all are read by many tasks, whatever the gaps between their numbers.

Python runs one tight loop per partition over Arrow batches; transitions are tabulated per (state, symbol),
so symbols should be a small alphabet computed in Spark.  Rows without an order value come first.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.plans.ordered import DEFAULT_CHUNK, chunked

Step = Callable[[Hashable, str], tuple[Hashable, bool]]


def _table(states: list, step: Step):
    index = {s: i for i, s in enumerate(states)}
    memo: dict[tuple[int, str], tuple[int, bool]] = {}

    def move(sid: int, sym: str) -> tuple[int, bool]:
        r = memo.get((sid, sym))
        if r is None:
            st, op = step(states[sid], sym)
            r = memo[(sid, sym)] = (index[st], bool(op))
        return r

    return index, move


def fsm_scan(
    df: DataFrame,
    key: str,
    order: str,
    symbol: Column | str,
    states: Sequence[Hashable],
    initial: Hashable,
    step: Step,
    chunk_size: int = DEFAULT_CHUNK,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Return ``(key, order, *keep, state_id, segment, opened, first)`` for every input row.

    ``step(state, symbol) -> (next_state, opened)``; ``segment`` is 1 + the number of openings up to and
    including the row (so a first row that opens gives 2: the segment before it is empty).  ``state_id`` indexes
    ``states``; ``first`` marks the first row of each key.
    """
    states = list(states)
    n_states = len(states)
    index, move = _table(states, step)
    init_id = index[initial]
    sym = F.col(symbol) if isinstance(symbol, str) else symbol

    # the narrow rows are read by the count, the summaries and the replay: written once
    narrow = df.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.coalesce(sym.cast("string"), F.lit("")).alias("sym"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    narrow = narrow.checkpoint()
    own = narrow.columns[3:]
    base = chunked(narrow, "k", "o", chunk_size).withColumnRenamed("_chunk", "c")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, cur, opened, alike = None, [], [], False

        def ended():
            if current is not None:
                out.append((*current, list(cur), list(opened)))

        for batch in batches:
            for k, c, s in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if (k, c) != current:
                    ended()
                    current, cur, opened, alike = (k, c), list(range(n_states)), [0] * n_states, False
                if alike:  # all entry states have met: one trajectory is left
                    sid, op = move(cur[0], s)
                    if op:
                        opened = [x + 1 for x in opened]
                    cur = [sid] * n_states
                else:
                    for i in range(n_states):
                        cur[i], op = move(cur[i], s)
                        opened[i] += op
                    alike = len(set(cur)) == 1
        ended()
        names = ["k", "c", "s_out", "n_open"]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    heavy = base.where("c > 0").select("k", "o", "sym", "c")
    functions = heavy.repartition("k", "c").sortWithinPartitions("k", "c", F.asc_nulls_first("o")).mapInArrow(transfer, "k string, c int, s_out array<int>, n_open array<long>")

    def compose(table: pa.Table) -> pa.Table:
        state, offset = init_id, 0
        rows = sorted(table.to_pylist(), key=lambda r: r["c"])  # at most PARTS
        out = []
        for r in rows:
            out.append({"k": r["k"], "c": r["c"], "entry": state, "offset": offset})
            offset += r["n_open"][state]
            state = r["s_out"][state]
        return pa.Table.from_pylist(out, pa.schema([("k", pa.string()), ("c", pa.int32()), ("entry", pa.int32()), ("offset", pa.int64())]))

    entries = functions.groupBy("k").applyInArrow(compose, "k string, c int, entry int, offset long")
    entries = entries.select(F.col("k").alias("_k"), F.col("c").alias("_c"), "entry", "offset")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sid, seg, first = None, init_id, 1, False
        for batch in batches:
            state, segment, opened, firsts = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
            for k, s, c, entry, offset in zip(*columns):
                if (k, c) != current:
                    current, first = (k, c), c <= 1  # chunks count from 1 in heavy keys, ordinary keys have chunk 0
                    sid, seg = (init_id, 1) if entry is None else (entry, offset + 1)
                sid, op = move(sid, s)
                seg += op
                state.append(sid), segment.append(seg), opened.append(op), firsts.append(first)
                first = False
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *batch.columns[6:], pa.array(state, pa.int32()), pa.array(segment, pa.int64()), pa.array(opened, pa.bool_()), pa.array(firsts, pa.bool_())],
                ["k", "o", *own, "state_id", "segment", "opened", "first"],
            )

    rows = base.join(entries, base["k"].eqNullSafe(entries["_k"]) & (base["c"] == entries["_c"]), "left").select("k", "o", "sym", "c", "entry", "offset", *own)
    # an explicit repartition: the grouping the Python pass relies on holds whatever join AQE chooses
    rows = rows.repartition("k", "c").sortWithinPartitions("k", "c", F.asc_nulls_first("o"))
    kinds = "".join(f", {c} {narrow.schema[c].dataType.simpleString()}" for c in own)
    rows = rows.mapInArrow(replay, f"k string, o long{kinds}, state_id int, segment long, opened boolean, first boolean")
    return rows.withColumnsRenamed({"k": key, "o": order, **dict(zip(own, keep))})
