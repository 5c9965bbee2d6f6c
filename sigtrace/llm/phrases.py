"""Collocated phrases by SON partitioning, per language.

Words of a text are the runs outside space and tab within a piece (pieces end at
``[.,;:!?\\x0A-\\x0D]``), with A-Z lower-cased; a phrase is two to ``longest`` neighbouring words
of a piece.

* **Words** are counted exactly first: their counts are needed for the scores, their sum ``n`` for
  the local supports, and a phrase with a word below ``support`` is none.
* **Shards.**  Each task mines its texts in shards of ``SHARD`` words or more.  A language's shard
  with ``n_i`` of its ``n`` words has the local support ``ceil(support * n_i / n)``: the ``n_i`` add
  up to ``n``, so a phrase that stays below it in every shard stays below ``support`` altogether.
  Within a shard all phrases of that support are found, length by length: a phrase can only have
  it if its first and its last ``k - 1`` words have.  Small inputs have shards that leave a local
  support of ``LEAST_LOCAL``.
* **Union.**  The locally frequent phrases of all shards, by language and key.  A shard that does not
  name a phrase has at most its local support less one of it; where what the naming shards have
  beyond that does not lift the sum of these bounds to ``support``, the phrase is out.
* **Count.**  Another reading counts the union in all texts: keys go through a bitmap of fixed
  size (``common.FILTER_BITS``), each shard adds up what passes, and the sums are joined with the
  union, so a false hit of the bitmap is counted in vain but never kept.  Supports are exact.  A
  shard where a phrase reaches the local support also names its first and last ``k - 1`` words.
* **Scores.**  Following these links gives both parts of every cut, which join the exact counts;
  products are decimals of 38 digits.  Candidates inside a longer one of (nearly) equal support are
  dropped; it is enough to look at those one word longer, as counts only grow towards the inner phrase.
* **Texts.**  A last reading writes out the phrases that rank among the first ``top`` (ties included).

Keys are 64-bit hashes of the words and stand for the phrases.  From ``support`` shards on, the local
support is 1 and the union holds every phrase of frequent words: still exact and in proportion to
the input, but no longer less than a plain count.

Cases: null and empty texts count no words; a null language is ``und``; texts of any length are
whole in one shard; ties go by support and the phrase's bytes; repeated rows count as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sigtrace.llm.common import in_bitmap, key_bitmap, released, text_groups, written

#: Words of a shard (up to half as many more, or one text), and least words of the shards of small inputs.
SHARD, SMALL_SHARD = 4_500_000, 100_000
#: The local support that shards of small inputs leave.
LEAST_LOCAL = 4
#: Characters split into words at once.
GROUP = 1_000_000
#: Rows given back at once.
ROWS = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_BLANKS = bytes(32 if _KIND[b] else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of many texts: hashes, places in the texts' bytes, and (up to 255) words left in the piece."""

    def __init__(self) -> None:
        self.n = 0
        self._parts: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str]) -> None:
        import xxhash

        data = b"\n".join([*(t.encode("utf-8", "surrogatepass") for t in texts), b""]).lower()
        kind = _KIND[np.frombuffer(data, np.uint8)]
        edges = np.diff((kind == _WORD).astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return
        pieces = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
        begins = np.flatnonzero(np.diff(pieces, prepend=-1))
        sizes = np.diff(np.concatenate((begins, [len(starts)])))
        left = np.repeat(begins + sizes, sizes) - np.arange(len(starts))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, data.translate(_BLANKS).split()), np.uint64, len(starts))
        self._parts.append((data, hashes, starts.astype(np.int32), (ends - starts).astype(np.int32), np.minimum(left, 255).astype(np.uint8)))
        self.n += len(starts)

    def merge(self, other: "Words") -> None:
        self._parts += other._parts
        self.n += other.n

    def joined(self) -> "Words":
        self.hashes = np.concatenate([p[1] for p in self._parts] or [np.zeros(0, np.uint64)])
        self.left = np.concatenate([p[4] for p in self._parts] or [np.zeros(0, np.uint8)])
        self.places = [(p[0], p[2], p[3]) for p in self._parts]
        self.before = np.cumsum([0, *(len(p[1]) for p in self._parts)])
        self._parts = []
        return self

    def phrases(self, at: np.ndarray, k: int) -> list[str]:
        """The phrases of k words at these places, joined by one space."""
        out = []
        for part, i in zip((np.searchsorted(self.before, at, side="right") - 1).tolist(), at.tolist()):
            data, starts, sizes = self.places[part]
            i -= int(self.before[part])
            out.append(b" ".join(data[s : s + n] for s, n in zip(starts[i : i + k].tolist(), sizes[i : i + k].tolist())).decode("utf-8", "replace"))
        return out

    def key(self, at: np.ndarray, k: int) -> np.ndarray:
        """The keys of the phrases of k words at these places."""
        keys = _mixed(self.hashes[at])
        for j in range(1, k):
            keys = _mixed(keys * _STEP + self.hashes[at + j])
        return keys

    def levels(self, longest: int):
        """Yield (k, positions, keys) of the phrases of k words; the mask sent back says which may grow."""
        at, keys = np.arange(self.n, dtype=np.int32), _mixed(self.hashes)
        for k in range(1, longest + 1):
            taken = yield k, at, keys
            at, keys = at[taken], keys[taken]
            if k == longest or not len(at):
                return
            good = np.concatenate((np.diff(at) == 1, [False])) & (self.left[at] > k)
            at, keys = at[good], keys[good]
            keys = _mixed(keys * _STEP + self.hashes[at + k])


def _counted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, where each different key begins in it, and their numbers (leaner than ``np.unique``)."""
    order = np.argsort(keys)
    begins = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    return order, begins, np.diff(np.concatenate((begins, [len(keys)])))


def _shards(batches: Iterator[pa.RecordBatch], least: int, share: float = 2.0):
    """Yield {(lang, n): Words}: shards end at ``least`` words or where a language (of some size) has ``share`` of its words.

    Rows are (t, lang, n).  What is left at a task's end joins the shard before if it is less than half of one.
    """
    ready: dict[tuple[str, int], Words] = {}
    held: dict[tuple[str, int], Words] = {}

    def part_of(shard) -> float:
        return max([sum(w.n for w in shard.values()) / least, *(w.n / (share * n) for (_, n), w in shard.items() if w.n >= SMALL_SHARD and n)], default=0.0)

    for part, texts in text_groups(batches, 0, GROUP):
        by: dict[tuple[str, int], list[str]] = {}
        for text, lang, n in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist()):
            by.setdefault((lang, n), []).append(text)
        for key, group in by.items():
            held.setdefault(key, Words()).add(group)
        if part_of(held) >= 1:
            if ready:
                yield ready
            ready, held = held, {}
    if ready and part_of(held) >= 0.5:
        yield ready
        ready = {}
    for key, words in held.items():
        ready.setdefault(key, Words()).merge(words)
    if ready:
        yield ready


def _word_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, key, f): frequency of each word; the null key has all words of the language."""

    def counted(batches: Iterator[pa.RecordBatch]):
        for shard in _shards(batches, least):
            for (lang, _), words in shard.items():
                keys = _mixed(words.joined().hashes)
                order, begins, n = _counted_keys(keys)
                keys = pa.array(keys[order[begins]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), keys, pa.array(n, pa.int64())], ["lang", "key", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([None], pa.int64()), pa.array([words.n], pa.int64())], ["lang", "key", "n"])

    counts = rows.select("t", "lang", F.lit(0).cast("long").alias("n")).mapInArrow(released(counted), "lang string, key long, n long")
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("f"))


def _levels(words: Words, longest: int, grow):
    """Yield (k, positions, keys) from two words on; ``grow(k, keys)`` says which of the keys may be counted and grow."""
    steps, taken = words.levels(longest), None
    while True:
        try:
            k, at, keys = steps.send(taken)
        except StopIteration:
            return
        taken = grow(k, keys)
        if k > 1:
            yield k, at[taken], keys[taken]


def _batch(lang: str, **columns) -> pa.RecordBatch:
    columns = {n: c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for n, c in columns.items()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), *columns.values()], ["lang", *columns])


def _mined(rows: DataFrame, bitmap, support: int, longest: int, least: int, share: float) -> DataFrame:
    """(lang, key, over): how far each phrase of a shard reaches over the local support less one, for those that reach it.

    ``bitmap`` has the frequent words.  The null key has the local support less one.
    """

    def mined(batches: Iterator[pa.RecordBatch]):
        bits = bitmap.value
        for shard in _shards(batches, least, share):
            for (lang, n), words in shard.items():
                local = -(-support * words.joined().n // n)
                yield _batch(lang, key=pa.array([None], pa.int64()), over=pa.array([local - 1], pa.int64()))
                found: list[tuple[np.ndarray, np.ndarray]] = []

                def grow(k: int, keys: np.ndarray) -> np.ndarray:
                    if k == 1:
                        return in_bitmap(bits, keys)
                    order, begins, counts = _counted_keys(keys)
                    often = counts >= local
                    taken = np.zeros(len(keys), bool)
                    taken[order] = np.repeat(often, counts)
                    found.append((keys[order[begins[often]]], counts[often] - (local - 1)))
                    return taken

                for _ in _levels(words, longest, grow):
                    keys, over = found.pop()
                    yield _batch(lang, key=keys, over=over)

    return rows.mapInArrow(released(mined), "lang string, key long, over long")


def _counted(rows: DataFrame, bitmap, support: int, longest: int, least: int, share: float) -> DataFrame:
    """(lang, key, f, k, first, last): occurrences of the phrases that pass the bitmap, and the keys of their first and last k - 1 words."""

    def counts(batches: Iterator[pa.RecordBatch]):
        bits = bitmap.value
        for shard in _shards(batches, least, share):
            for (lang, n), words in shard.items():
                local = -(-support * words.joined().n // n)
                for k, at, keys in _levels(words, longest, lambda k, keys: in_bitmap(bits, keys)):
                    order, begins, f = _counted_keys(keys)
                    place = at[order[begins]]
                    first, last = words.key(place, k - 1), words.key(place + 1, k - 1)
                    unnamed = f < local  # a frequent phrase reaches the local support of some shard
                    link = lambda x: pa.array(x.view(np.int64), mask=unnamed)
                    yield _batch(lang, key=keys[order[begins]], n=f, k=pa.array(np.full(len(f), k, np.int32), mask=unnamed), first=link(first), last=link(last))

    counted = rows.mapInArrow(released(counts), "lang string, key long, n long, k int, first long, last long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("f"), *[F.max(c).alias(c) for c in ("k", "first", "last")])


def _named(rows: DataFrame, bitmap, wanted, support: int, longest: int, least: int, share: float) -> DataFrame:
    """(lang, key, phrase) of the keys in ``wanted``; ``bitmap`` has all frequent words and phrases."""

    def named(batches: Iterator[pa.RecordBatch]):
        bits, chosen = bitmap.value, wanted.value
        for shard in _shards(batches, least, share):
            for (lang, n), words in shard.items():
                local = -(-support * words.joined().n // n)
                for k, at, keys in _levels(words, longest, lambda k, keys: in_bitmap(bits, keys)):
                    some = in_bitmap(chosen, keys)
                    at, keys = at[some], keys[some]
                    order, begins, counts = _counted_keys(keys)
                    first = order[begins[counts >= local]]
                    for i in range(0, len(first), ROWS):
                        yield _batch(lang, key=keys[first[i : i + ROWS]], phrase=pa.array(words.phrases(at[first[i : i + ROWS]], k), pa.string()))

    return rows.mapInArrow(released(named), "lang string, key long, phrase string").groupBy("lang", "key").agg(F.first("phrase").alias("phrase"))


def _parts(candidates: DataFrame, frequent: DataFrame, link: str, longest: int) -> DataFrame:
    """(lang, key, k, size, part): the keys of the first (``link`` = first) or last ``size`` words of each candidate."""
    part = candidates.select("lang", "key", "k", (F.col("k") - 1).alias("size"), F.col(link).alias("part"))
    links = frequent.select("lang", F.col("key").alias("part"), F.col(link).alias("next"))
    out = part
    for _ in range(longest - 2):
        part = part.where("size > 1").join(links, ["lang", "part"]).select("lang", "key", "k", (F.col("size") - 1).alias("size"), F.col("next").alias("part"))
        out = out.unionByName(part)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 100, longest: int = 5, absorb: int = 100, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases (None: all).

    ``a``, ``l`` and ``r`` count the phrase and the parts of its lowest-scoring cut, ``score`` is
    ``floor(1000 a n / (l r))``.  A candidate is dropped if a longer one that contains it has at
    least ``absorb`` percent of its support.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    counted = _word_counts(rows, SHARD)
    counted = written(counted.where(F.col("key").isNull() | (F.col("f") >= support)), "phrases-words")
    # a table of its own, one row a language: Spark knows that it is small and the texts stay where they are
    totals = written(counted.where("key IS NULL AND f > 0").select("lang", F.col("f").alias("n")).coalesce(1), "phrases-totals")
    words = counted.where("key IS NOT NULL").select("lang", "key", "f")

    total = totals.agg(F.sum("n")).first()[0] or 0
    # a little under the share that gives LEAST_LOCAL exactly, as shards end with a whole group of texts
    share = max((LEAST_LOCAL - 0.4) / support, SMALL_SHARD / max(total, 1))
    least = int(min(SHARD, max(SMALL_SHARD, total * share)))
    # coalescing moves no text: a task reads more files, so that it has a whole shard
    known = rows.join(totals, "lang").select("t", "lang", "n").coalesce(max(1, -(-total * 23 // (20 * least))))
    sent = lambda keys: spark.sparkContext.broadcast(key_bitmap(keys))
    bitmap = sent(words.select("key"))
    mined = written(_mined(known, bitmap, support, longest, least, share).groupBy("lang", "key").agg(F.sum("over").alias("over")), "phrases-mined")
    bitmap.destroy()
    bound = written(mined.where("key IS NULL").select("lang", F.col("over").alias("bound")).coalesce(1), "phrases-bounds")
    union = mined.where("key IS NOT NULL").join(bound, "lang").where(F.col("over") + F.col("bound") >= support).select("lang", "key")

    bitmap = sent(words.select("key").unionAll(union.select("key")))
    counted = _counted(known, bitmap, support, longest, least, share).where(F.col("f") >= support)
    frequent = written(counted.join(union, ["lang", "key"], "left_semi"), "phrases-frequent")
    bitmap.destroy()

    counts = words.unionByName(frequent.select("lang", "key", "f"))
    candidates = frequent.withColumnRenamed("f", "a")
    longer = candidates.where("k > 2").select("lang", F.col("a").alias("outer"), F.explode(F.array("first", "last")).alias("key"))
    absorbed = longer.groupBy("lang", "key").agg(F.max("outer").alias("outer"))
    left = candidates.join(absorbed, ["lang", "key"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < absorb * F.col("a")))

    counted_part = lambda link, name: _parts(left, frequent, link, longest).join(counts.withColumnsRenamed({"key": "part", "f": name}), ["lang", "part"])
    before = counted_part("first", "l").select("lang", "key", F.col("size").alias("cut"), "l")
    after = counted_part("last", "r").select("lang", "key", (F.col("k") - F.col("size")).alias("cut"), "r")
    cuts = left.select("lang", "key", "a").join(before.join(after, ["lang", "key", "cut"]), ["lang", "key"]).join(totals, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "key").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    scored = lowest.select("lang", "key", "a", "low.l", "low.r", "n", "low.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    if top is not None:
        scored = scored.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place")
    scored = written(scored, "phrases-scored")

    bitmap, wanted = sent(counts.select("key")), sent(scored.select("key"))
    names = written(_named(known, bitmap, wanted, support, longest, least, share), "phrases-names")
    bitmap.destroy(), wanted.destroy()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.join(names, ["lang", "key"]).withColumn("rank", rank.cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
