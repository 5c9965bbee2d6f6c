"""Helpers shared by the text operators: table reading, written intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.session import scratch_path

#: Texts are worked on in groups of about so many characters, so memory is bounded by this and the longest text.
GROUP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of what has been written
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that is no longer used back to the system; a Python worker lives longer than its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def forget(table: DataFrame) -> None:
    """Empty the folder of a ``written`` table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        table.sparkSession.range(0).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


_STATE: dict = {}


def worker_state(key, make: Callable):
    """What a worker keeps between the tasks of one stage (a tokenizer, a cache); another key takes its place."""
    if _STATE.get("key") != key:
        _STATE.clear()
        release()
        _STATE.update(key=key, value=make())
    return _STATE["value"]


def released(fn: Callable, state=None) -> Callable:
    """``fn`` of Arrow batches, releasing memory when its task ends, and at its start what a worker keeps for other stages."""

    def run(batches):
        if _STATE.get("key") != state:
            _STATE.clear()
        try:
            yield from fn(batches)
        finally:
            release()

    return run


class Slots:
    """Places of known 64-bit keys, looked up in a few direct-mapped tables instead of by binary search."""

    _FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]

    def __init__(self, keys: np.ndarray):
        """``keys`` are different from each other."""
        self.keys = keys.astype(np.uint64, copy=False)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(4, int(len(left)).bit_length())
            factor, shift = np.uint64(self._FACTORS[len(self.tables) % 5] + 2 * len(self.tables)), np.uint64(64 - bits)
            place = (self.keys[left] * factor) >> shift
            table = np.full(1 << bits, -1, np.int32)
            table[place] = left
            self.tables.append((factor, shift, table))
            left = left[table[place] != left]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        todo = None
        for factor, shift, table in self.tables:
            asked = wanted if todo is None else wanted[todo]
            at = table[(asked * factor) >> shift]
            hit = (at >= 0) & (self.keys[at] == asked)
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero(~hit & (at >= 0))  # an empty slot: the key is in no table
            else:
                out[todo[hit]] = at[hit]
                todo = todo[~hit & (at >= 0)]
            if not len(todo):
                break
        return out


#: Bits of a bitmap of keys: its size is the same for any number of keys.
FILTER_BITS = 1 << 26


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the 64-bit keys in the only column of ``keys``: what is not in it is no key, what is may be one."""
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("place")
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    rows = keys.select(place).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most FILTER_BITS / 64
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(FILTER_BITS - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def text_groups(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = GROUP_CHARS):
    """Yield ``(batch slice, texts)`` of about ``size`` characters; a null text counts as empty."""
    for batch in batches:
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            text = batch.column(column)[i].as_py() or ""
            texts.append(text)
            held += len(text)
            if held >= size:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def compressed(rows: DataFrame, wanted=None, outside: bool = False) -> DataFrame:
    """(d, z): the texts ``t`` of ``rows`` (d, t) in zstd, where they must be shuffled.

    With ``wanted``, a broadcast bitmap, only of rows whose key ``x`` passes, or (``outside``) does not.
    """
    import zstandard

    def packed(batches: Iterator[pa.RecordBatch]):
        pack = zstandard.ZstdCompressor(level=3)
        for part, texts in text_groups(_passing(batches, wanted, outside)):
            z = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.binary())], ["d", "z"])

    columns = ("d", "t") if wanted is None else ("d", "t", "x")
    return rows.select(*columns).mapInArrow(released(packed), f"d {rows.schema['d'].dataType.simpleString()}, z binary")


def _passing(batches: Iterator[pa.RecordBatch], wanted, outside: bool):
    for batch in batches:
        yield batch if wanted is None else batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy().view(np.uint64)) != outside))


def unpacked_groups(batches: Iterator[pa.RecordBatch], column: int, size: int = GROUP_CHARS):
    """Like ``text_groups`` for a column of ``compressed`` texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(unpack.decompress(batch.column(column)[i].as_py()).decode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held >= size:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


class BoundedCache(dict):
    """A worker's dictionary that forgets most of what it has learned once it holds too much.

    ``base`` stays resident (the first tier); everything else is a second tier of at most ``limit`` entries.  What was
    asked for again since the last time stays, where that is at most half of them.
    """

    def __init__(self, base: dict | None = None, limit: int = 400_000):
        self.base = base or {}
        self.limit = limit
        self.again: set = set()
        super().__init__(self.base)

    def room(self, wanted: int) -> None:
        if len(self) + wanted > len(self.base) + self.limit:
            self.clear()
            self.update(self.base)

    def missing(self, needed: set, each: int = 1) -> set:
        """The keys of ``needed`` that are not held; there is room for ``each`` entries for every one of them."""
        new = needed.difference(self)
        self.again |= needed.difference(new)
        if len(self) + each * len(new) <= len(self.base) + self.limit:
            return new
        kept = {k: self[k] for k in self.again if k in self} if 2 * len(self.again) <= self.limit else {}
        self.again = set()
        self.clear()
        self.update(self.base)
        if len(kept) + each * len(needed) <= self.limit:
            self.update(kept)
        return needed.difference(self)

    def learn(self, keys, values) -> None:
        self.update(zip(keys, values))
