"""Token counts by a map-side two-tier lookup of pre-token lengths.

First tier: a compact table of the most frequent pre-tokens and their token counts,
broadcast to the workers (at most ``table_size`` entries of at most ``MAX_KEY`` characters,
so its size is bounded whatever the corpus).  Second tier: a bounded cache in each Python
worker; what neither holds is encoded with the tokenizer itself.  Both tiers only save
time: every count is the tokenizer's own.  Pre-tokens are never shuffled; to find the
frequent ones each task sends the head of its own counts, ``head_size`` rows at most.

Cases: null or empty text counts 0 bytes and 0 tokens; repeated rows each get a row; an
empty table gives an empty result; columns other than the named ones are passed through
``keep`` or ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm import pieces
from sigtrace.llm.common import BoundedCache, text_groups

MAX_KEY = 48
_STATE: dict = {}


def frequent_keys(docs: DataFrame, text: str = "text", table_size: int = 32_768, head_size: int = 4_096) -> list[str]:
    """The most frequent pre-tokens, found from the head of each task's counts over all documents."""

    def heads(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        for _, texts in text_groups(batches, 0):
            for t in texts:
                counts.update(pieces.chunk_keys(t))
            if len(counts) > 300_000:
                counts = Counter(dict(counts.most_common(100_000)))
        head = [(k, n) for k, n in counts.most_common(head_size) if len(k) <= MAX_KEY]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in head], pa.string()), pa.array([n for _, n in head], pa.int64())], ["piece_key", "n"])

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(heads, "piece_key string, n long")
    top = found.groupBy("piece_key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece_key").limit(table_size)
    return [r[0] for r in top.collect()]


def _worker(model: str, table, limit: int):
    state = _STATE.get("held")
    if state is None or state[0] != (model, table.value[0]):
        sp = pieces.load(model)
        lone = len(sp.encode(" ")) and 1  # a lone space mark is one piece
        _STATE["held"] = state = ((model, table.value[0]), sp, BoundedCache(dict(zip(table.value[1], table.value[2])) | {"": lone}, limit))
    return state[1], state[2]


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    model: str | None = None,
    table_size: int = 32_768,
    head_size: int = 4_096,
    cache_size: int = 400_000,
) -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text."""
    spark = docs.sparkSession
    model = model or pieces.default_model()
    sp = pieces.load(model)
    pieces.check_vocabulary(sp)
    keys = frequent_keys(docs, text, table_size, head_size)
    lengths = [len(ids) for ids in sp.encode(keys, num_threads=1)] if keys else []
    table = spark.sparkContext.broadcast((hash(tuple(keys)), keys, lengths))

    def counted(batches: Iterator[pa.RecordBatch]):
        sp, cache = _worker(model, table, cache_size)
        for part, texts in text_groups(batches, len(keep)):
            split = [pieces.chunk_keys(t) for t in texts]
            needed = set().union(*split)
            cache.room(len(needed))
            new = list(needed.difference(cache))
            if new:
                cache.learn(new, map(len, sp.encode(new, num_threads=1)))
            n = [sum(map(cache.__getitem__, k)) for k in split]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(size, pa.int64()), pa.array(n, pa.int64())], [*(f"k{i}" for i in range(len(keep))), "n_bytes", "n_tokens"])

    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep))] + ["n_bytes long", "n_tokens long"])
    return rows.mapInArrow(counted, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
