"""Katz backoff language model of words, in tables bucketed by history.

``train`` counts and writes the model, ``Katz.score`` evaluates texts with it.

* **Tokens.**  Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end mark a text; 64-bit
  hashes stand for them.  Histories at a text's start are filled with a begin mark, which is
  never predicted.
* **Discounts.**  Counts up to ``CUTOFF`` are multiplied by Katz's Good-Turing ratios
  ``d_r = (r*/r - A) / (1 - A)`` with ``r* = (r + 1) n_{r+1} / n_r`` and ``A = (k + 1) n_{k+1} / n_1``;
  where counts of counts give no ratios between 0 and 1 the cut-off ``k`` is lowered.
* **Backoff.**  A seen gram has ``d(c) c / total(history)``, any other ``alpha(history)`` times the next
  lower order; ``alpha`` is the freed mass over the lower order's mass of the words not seen after
  the history, so every history sums to one exactly.  A history without freed mass counts one
  more, which it frees.  Words share the rest of the first order's mass as one unknown word.
* **Tables.**  Word counts; per order, buckets of about ``BUCKET`` occurrences that hold the
  histories, their followers and counts as packed arrays, and a table of the histories' totals
  and weights.  Both are bucketed alike, so that the model is never shuffled again.  A history
  with more than half a bucket's occurrences is spread over buckets by the follower.
* **Evaluation.**  Each token asks the highest order.  At most ``COMMON`` commonest grams answer
  from a broadcast; other requests go, packed by bucket, to the model's bucket, where a gram
  answers or passes its backoff weight and a request for the next lower order.  A text that the model
  has learned needs no request for grams that are not in a bitmap of the repeated ones.  Words are
  looked up in a broadcast of at most ``COMMON`` commonest ones, the rest in the word table.
  Per order there is one shuffle of packed requests; sums come back packed by slices of rows, rows being
  numbered by the pass that writes their profiles and requests; equal texts take the sums of one of them.
* **Packed words.**  Where words are packed, the ``COMMON`` commonest are numbers by their frequency, which
  take 2 to 3 bytes, others their hashes.

Cases: null and empty texts are one end mark; without training texts every token has the
unknown word's probability 1; a null id belongs to the training rows in the query; texts of any
length are whole (a group holds at least one text); repeated rows each get a row and count as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sigtrace.llm.common import Slots, forget, in_bitmap, key_bitmap, release, released, text_groups, written
from sigtrace.session import scratch_path

#: Occurrences of a bucket, and how many are counted at once in a task.
BUCKET, FLUSH = 1_000_000, 400_000
#: Entries of the broadcast tables of words and grams.
COMMON = 1 << 18  # at most 255 << 16, see ``_coded``
CUTOFF = 5
#: Answers are added up for ``2 ** SLICE`` rows of a task at once.
SLICE = 12
#: Characters split into words at once.
GROUP = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK = b"\xff"  # no byte of UTF-8
_REQUEST = [("bucket", pa.int32()), *((n, pa.binary()) for n in ("owners", "who", "hists", "lens", "words"))]
_PACKED = "bucket int, owners binary, who binary, hists binary, lens binary, words binary"


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


END, BEGIN = np.uint64(_hash(_MARK)), np.uint64(_hash(_MARK * 2))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens of each text."""
    import xxhash

    data = (b" " + _MARK + b" ").join([*(t.encode("utf-8", "surrogatepass") for t in texts), b""]).lower()
    words = data.split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return hashes, np.diff(np.flatnonzero(hashes == END), prepend=-1)


def histories(hashes: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order - 1`` words before each token, farthest first."""
    columns, last = [], hashes
    for _ in range(order - 1):
        last = np.concatenate((np.array([BEGIN]), last[:-1]))
        last[last == END] = BEGIN
        if columns:
            last[columns[-1] == BEGIN] = BEGIN
        columns.append(last)
    return columns[::-1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    key = columns[0]
    for c in columns[1:]:
        key = _mixed(key * _STEP + c)
    return key


class GoodTuring:
    """Discount ratios of counts 1 .. ``cutoff`` from the counts of counts ``n[1..cutoff + 1]``."""

    def __init__(self, n: list[int], cutoff: int = CUTOFF):
        self.ratio = np.ones(cutoff + 1)
        for k in range(cutoff, 0, -1):
            if min(n[1 : k + 2]) <= 0 or (rest := (k + 1) * n[k + 1] / n[1]) >= 1:
                continue
            ratio = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in ratio):
                self.ratio[1 : k + 1] = ratio
                break

    def counts(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return c * self.ratio[np.where(c < len(self.ratio), c, 0)]

    def column(self, c: Column) -> Column:
        out = c.cast("double")
        for r in range(1, len(self.ratio)):
            out = F.when(c == r, float(r * self.ratio[r])).otherwise(out)
        return out


def _counts_of_counts(counts: Column) -> list[Column]:
    return [F.count(F.when(counts == r, 1)).alias(f"n{r}") for r in range(1, CUTOFF + 2)]


class _Held:
    """Token arrays of successive text groups, given out about ``FLUSH`` tokens at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], column: int = 0):
        self.batches, self.column = batches, column

    def __iter__(self):
        parts, hashes, size = [], [], 0
        for part, texts in text_groups(self.batches, self.column, GROUP):
            h, n = tokens(texts)
            parts.append((part, n))
            hashes.append(h)
            size += len(h)
            if size >= FLUSH:
                yield parts, np.concatenate(hashes)
                parts, hashes, size = [], [], 0
                release()
        if parts:
            yield parts, np.concatenate(hashes)


def _table(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch])


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _word_counts(rows: DataFrame) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]):
        for _, hashes in _Held(batches):
            w, c = np.unique(hashes, return_counts=True)
            yield _batch({"w": pa.array(w.view(np.int64)), "c": pa.array(c.astype(np.int64))})

    return rows.select("t").mapInArrow(released(counted), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _bucket_of(key: np.ndarray, words: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by history, of hot histories by history and word."""
    route = _mixed(key)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        route = np.where(hot[at] == key, _mixed(key * _STEP + words), route)
    return ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


def _packs(bucket: np.ndarray, columns: list[np.ndarray], key: np.ndarray, words: np.ndarray, more: dict[str, np.ndarray], common: _Common):
    """Yield one row a bucket: histories with run lengths, words and ``more`` arrays, ordered by history."""
    # by bucket, then by half of the history's hash: where two histories share it, their runs are only shorter
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | _mixed(key) & np.uint64(0xFFFFFFFF))
    bucket, key, words = bucket[order], key[order], words[order]
    columns, more = [c[order] for c in columns], {n: v[order] for n, v in more.items()}
    edges = _runs(bucket)
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(bucket) != 0)))) if len(key) else edges
    lens = np.diff(np.concatenate((begins, [len(key)]))).astype(np.uint32)
    hists = np.stack([c[begins] for c in columns])
    hist_places, places = common.slots.find(hists.ravel()).reshape(hists.shape), common.slots.find(words)
    ends = [*edges[1:].tolist(), len(key)]
    for a, b, ra, rb in zip(edges.tolist(), ends, np.searchsorted(begins, edges).tolist(), np.searchsorted(begins, ends).tolist()):
        row = {
            "bucket": int(bucket[a]),
            "hists": _coded(hists[:, ra:rb].ravel(), hist_places[:, ra:rb].ravel()),
            "lens": lens[ra:rb].tobytes(),
            "words": _coded(words[a:b], places[a:b]),
        }
        for n, v in more.items():
            row[n] = v[a:b].tobytes()
        yield row


def _coded(words: np.ndarray, places: np.ndarray) -> bytes:
    """Words as their places among the common ones, low halves before high ones; then the hashes of those without a place."""
    return places.astype("<u2").tobytes() + (places >> 16).astype(np.uint8).tobytes() + words[places < 0].tobytes()


def _unpacked(table: pa.Table, order: int, more: dict[str, type], common: _Common):
    """(history columns per entry, words, more arrays) of packed rows, joined."""
    hists, words, rest = [[] for _ in range(order - 1)], [], {n: [] for n in more}
    for row in table.to_pylist():
        lens = np.frombuffer(row["lens"], np.uint32)
        for held, c in zip(hists, common.decoded(row["hists"], (order - 1) * len(lens)).reshape(order - 1, -1)):
            held.append(np.repeat(c, lens))
        words.append(common.decoded(row["words"], int(lens.sum())))
        for n, kind in more.items():
            rest[n].append(np.frombuffer(row[n], kind))
    empty = np.zeros(0, np.uint64)
    joined = lambda x, kind=np.uint64: np.concatenate(x) if x else empty.astype(kind)
    return [joined(c) for c in hists], joined(words), {n: joined(v, more[n]) for n, v in rest.items()}


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed by ``bucket`` in the shared folder and read it back."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, "bucket").option("compression", "zstd").option("path", scratch_path(spark, name.replace("_", "-"))).saveAsTable(table)
    spark.sparkContext._jvm.System.gc()  # as in common.written
    return spark.table(table)


def _commonest(counts: DataFrame, most: int) -> Column | None:
    """A condition on ``c`` that at most ``most`` rows of ``counts`` (c) meet."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level).agg(F.count("*")).collect()), reverse=True)  # a few hundred at most
    total, least = 0, None
    for at, n in levels:
        if total + n > most:
            break
        total, least = total + n, at
    return None if least is None else level >= least


class Katz:
    """A trained model: word counts, and for each order above the bucketed tables."""

    def __init__(self, spark, order: int):
        self.spark, self.order = spark, order
        self.levels: dict[int, DataFrame] = {}
        self.hot: dict[int, np.ndarray] = {}
        self.discounts: dict[int, GoodTuring] = {}
        self.scratch: list[DataFrame] = []

    # -- training -------------------------------------------------------------------------------

    def _learn_words(self, rows: DataFrame) -> None:
        self.words = written(_word_counts(rows), "katz-words")
        sums = self.words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *_counts_of_counts(F.col("c"))).first()
        self.n, self.v = sums["n"] or 0, sums["v"]
        discount = self.discounts[1] = GoodTuring([0, *(sums[f"n{r}"] for r in range(1, CUTOFF + 2))])
        freed = sum(r * sums[f"n{r}"] * (1 - discount.ratio[r]) for r in range(1, CUTOFF + 1))
        self.total = self.n if freed > 0 else self.n + 1
        self.unknown = freed / self.n if freed > 0 else 1 / (self.n + 1)
        self.buckets = max(1, -(-self.n // BUCKET))
        common = _commonest(self.words, COMMON)
        held = self.words.where(common).toArrow() if common is not None else None
        keys = held["w"].to_numpy().view(np.uint64) if held is not None else np.zeros(0, np.uint64)
        c = held["c"].to_numpy() if held is not None else np.zeros(0, np.int64)
        order = np.argsort(-c)  # the most frequent have the smallest numbers
        self.common = self.spark.sparkContext.broadcast(_Common(keys[order], c[order]))
        # a word with more than half a bucket's occurrences: at most two for every bucket
        often = self.words.where(F.col("c") > BUCKET // 2).select("w").toArrow()["w"].to_numpy().view(np.uint64)
        self.hot[2] = np.unique(np.concatenate((often[often != END], [BEGIN])))

    def _learn(self, rows: DataFrame, k: int) -> None:
        buckets, hot, common = self.buckets, self.hot[k], self.common

        def counted(batches: Iterator[pa.RecordBatch]):
            for _, hashes in _Held(batches):
                columns = histories(hashes, k)
                key = key_of(columns)
                gram = _mixed(key * _STEP + hashes)
                order = np.argsort(gram)
                begins = _runs(gram[order])
                at, n = order[begins], np.diff(np.concatenate((begins, [len(gram)])))
                columns, key, words = [c[at] for c in columns], key[at], hashes[at]
                packs = _packs(_bucket_of(key, words, hot, buckets), columns, key, words, {"counts": n.astype(np.uint32)}, common.value)
                yield pa.RecordBatch.from_pylist(list(packs), pa.schema(fields))

        fields = [("bucket", pa.int32()), ("hists", pa.binary()), ("lens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]
        packed = "bucket int, hists binary, lens binary, words binary, counts binary"

        def merged(table: pa.Table) -> pa.Table:
            columns, words, more = _unpacked(table, k, {"counts": np.uint32}, common.value)
            key = key_of(columns)
            gram = _mixed(key * _STEP + words)
            order = np.argsort(gram)
            begins = _runs(gram[order])
            n = np.add.reduceat(more["counts"][order].astype(np.uint64), begins)
            at = order[begins]
            bucket = np.full(len(at), table["bucket"][0].as_py(), np.int32)
            rows = _packs(bucket, [c[at] for c in columns], key[at], words[at], {"counts": n}, common.value)
            out = pa.Table.from_pylist(list(rows), pa.schema(fields))
            release()
            return out

        types = rows.select("t").mapInArrow(released(counted), packed).groupBy("bucket").applyInArrow(merged, packed)
        types = _bucketed(types, f"katz_types_{k}", buckets)
        self._weigh(types, k)

    def _weigh(self, types: DataFrame, k: int) -> None:
        """The discounts of order ``k``, totals and backoff weights of its histories; adds the order's table."""

        def tallied(batches: Iterator[pa.RecordBatch]):
            n = np.zeros(CUTOFF + 2, np.int64)
            for batch in batches:
                for counts in batch.column(0).to_pylist():
                    c = np.frombuffer(counts, np.uint64)
                    n += np.bincount(c[c < CUTOFF + 2].astype(np.int64), minlength=CUTOFF + 2)
            yield _batch({f"n{r}": pa.array([int(n[r])], pa.int64()) for r in range(1, CUTOFF + 2)})

        schema = ", ".join(f"n{r} long" for r in range(1, CUTOFF + 2))
        sums = types.select("counts").mapInArrow(tallied, schema).agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, CUTOFF + 2)]).first()
        discount = self.discounts[k] = GoodTuring([0, *((sums[f"n{r}"] or 0) for r in range(1, CUTOFF + 2))])
        common, chance, first = self.common, self._chance(), k == 2

        def weighed(batches: Iterator[pa.RecordBatch]):
            """Totals, freed counts and the lower order's mass of each history of a bucket; words to look up elsewhere."""
            for batch in batches:
                for i in range(batch.num_rows):
                    table = _table(batch.slice(i, 1))
                    columns, words, more = _unpacked(table, k, {"counts": np.uint64}, common.value)
                    key = key_of(columns)
                    begins = _runs(key)
                    c = more["counts"].astype(np.int64)
                    total, freed = np.add.reduceat(c, begins), np.add.reduceat(c - discount.counts(c), begins)
                    low, rest = np.zeros(len(begins)), np.zeros(0, np.int64)
                    if first:
                        p, hit = chance(common.value, words)
                        low, rest = np.add.reduceat(np.where(hit, p, 0.0), begins), np.flatnonzero(~hit)
                    size = len(begins) + len(rest)
                    known, null = lambda x, kind: pa.array(np.concatenate((x, np.zeros(len(rest), x.dtype))), kind), np.arange(size) >= len(begins)
                    yield _batch({
                        "bucket": pa.array(np.full(size, table["bucket"][0].as_py(), np.int32), pa.int32()),
                        "key": pa.array(np.concatenate((key[begins], key[rest])).view(np.int64)),
                        "total": known(total, pa.int64()), "freed": known(freed, pa.float64()), "low": known(low, pa.float64()),
                        "w": pa.array(np.concatenate((np.zeros(len(begins), np.uint64), words[rest])).view(np.int64), mask=~null),
                    })

        rows = written(types.mapInArrow(released(weighed), "bucket int, key long, total long, freed double, low double, w long"), "katz-histories")
        lower = None if first else written(self._evaluated(types.mapInArrow(self._lower(k), _PACKED), k - 1, plain=True), "katz-lower")

        def parts(rows: DataFrame) -> DataFrame:
            """(bucket, key, total, freed, low): what adds up to each history's sums."""
            known = rows.where("w IS NULL").select("bucket", "key", "total", "freed", "low")
            if first:
                more = rows.where("w IS NOT NULL").join(self.words, "w").select("bucket", "key", (self.discounts[1].column(F.col("c")) / float(self.total)).alias("low"))
            else:
                place = known.groupBy("key").agg(F.min("bucket").alias("bucket"))
                more = place.join(lower.select(F.col("owner").alias("key"), F.col("value").alias("low")), "key")
            return known.unionByName(more.select("bucket", "key", F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("freed"), "low"))

        # hot histories are spread over buckets, at most two for every bucket; all others are whole in one
        spread = self.spark.createDataFrame([(int(h),) for h in self.hot[k].view(np.int64)], "key long")
        sums = parts(rows.join(spread, "key", "left_semi")).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", "freed", "low")])
        hot = {r["key"]: (r["total"], r["freed"], r["low"]) for r in sums.collect()}

        def gathered(table: pa.Table) -> pa.Table:
            keys, inverse = np.unique(table["key"].to_numpy().view(np.uint64), return_inverse=True)
            total, freed, low = (np.bincount(inverse, weights=table[c].to_numpy()) for c in ("total", "freed", "low"))
            for i in np.flatnonzero(np.isin(keys.view(np.int64), list(hot))).tolist():
                total[i], freed[i], low[i] = hot[int(keys.view(np.int64)[i])]
            none = freed <= 0
            whole = total + none
            alpha = np.log10(np.where(none, 1, freed) / whole) - np.log10(1 - low)
            held = {"key": keys.tobytes(), "total": np.log10(whole).tobytes(), "alpha": alpha.tobytes()}
            release()
            return pa.Table.from_pylist([{"bucket": table["bucket"][0].as_py(), **held}], pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in held)]))

        weights = parts(rows).groupBy("bucket").applyInArrow(gathered, "bucket int, key binary, total binary, alpha binary")
        weights = _bucketed(weights, f"katz_weights_{k}", self.buckets)
        forget(rows)
        self.levels[k] = types.join(weights, "bucket")
        if k < self.order:
            self.hot[k + 1] = self._hot(types, k)

    def _hot(self, types: DataFrame, k: int) -> np.ndarray:
        """Grams of order ``k`` that are hot histories of the next order, and the texts' start."""

        limit, common = BUCKET // 2, self.common

        def often(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                columns, words, more = _unpacked(_table(batch), k, {"counts": np.uint64}, common.value)
                if len(words):
                    yield _batch({"key": pa.array(key_of([*columns, words])[(more["counts"] > limit) & (words != END)].view(np.int64))})

        found = types.mapInArrow(often, "key long").toArrow()["key"].to_numpy().view(np.uint64)  # at most two a bucket
        return np.unique(np.concatenate((found, key_of([np.array([BEGIN])] * k))))

    def _lower(self, k: int):
        """Packed requests for the next lower order of every gram, owned by the gram's history."""
        buckets, hot, common = self.buckets, self.hot[k - 1], self.common

        def asked(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                columns, words, _ = _unpacked(_table(batch), k, {"counts": np.uint64}, common.value)
                if len(words):
                    yield _requests(columns[1:], words, *np.unique(key_of(columns), return_inverse=True), hot, buckets, common.value)

        return asked

    def _chance(self):
        """A function of the common words and some words: their probabilities, and which of them are common."""
        discount, total = self.discounts[1], float(self.total)

        def chance(held: _Common, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c, hit = held.find(words)
            return discount.counts(c) / total, hit

        return chance

    # -- evaluation -----------------------------------------------------------------------------

    def _evaluated(self, requests: DataFrame, level: int, plain: bool = False) -> DataFrame:
        """(owner, value): sums of log10 probabilities (``plain``: of probabilities) of packed requests."""
        sums = []
        for k in range(level, 1, -1):
            asked = requests.groupBy("bucket").cogroup(self.levels[k].groupBy("bucket"))
            found = written(asked.applyInArrow(self._answer(k, plain), f"slice long, named binary, values binary, owner long, w long, {_PACKED}"), "katz-answers", "zstd")
            self.scratch.append(found)
            answers = found.where("slice IS NOT NULL").select("slice", "named", "values")
            sums.append(answers.groupBy("slice").applyInArrow(_added, "owner long, value double"))
            requests = found.where("bucket IS NOT NULL").select("bucket", "owners", "who", "hists", "lens", "words")
            if k == 2:
                rare = found.where("w IS NOT NULL").select("owner", "w").join(self.words, "w", "left")
                p = F.coalesce(self.discounts[1].column(F.col("c")) / float(self.total), F.lit(self.unknown))
                sums.append(rare.select("owner", (p if plain else F.log10(p)).alias("value")))
        out = sums[0]
        for more in sums[1:]:
            out = out.unionByName(more)
        return out.groupBy("owner").agg(F.sum("value").alias("value"))

    def _answer(self, k: int, plain: bool):
        discount, common, chance = self.discounts[k], self.common, self._chance()
        buckets, hot = self.buckets, self.hot.get(k - 1)
        fields = [("slice", pa.int64()), ("named", pa.binary()), ("values", pa.binary()), ("owner", pa.int64()), ("w", pa.int64()), *_REQUEST]

        def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return pa.Table.from_pylist([], pa.schema(fields))
            owners, columns, words = _asked(asked, k, common.value)
            key = key_of(columns)
            value = np.zeros(len(words))
            hit = np.zeros(len(words), bool)
            if model.num_rows:
                seen, seen_words, more = _unpacked(model.select(["hists", "lens", "words", "counts"]), k, {"counts": np.uint64}, common.value)
                grams = _mixed(key_of(seen) * _STEP + seen_words)
                order = np.argsort(grams)
                grams, counts = grams[order], more["counts"][order].astype(np.int64)
                wanted = _mixed(key * _STEP + words)
                at = np.minimum(np.searchsorted(grams, wanted), len(grams) - 1)
                hit = grams[at] == wanted
                known = np.frombuffer(model["key"][0].as_py(), np.uint64)
                total, alpha = (np.frombuffer(model[n][0].as_py(), np.float64) for n in ("total", "alpha"))
                h = np.minimum(np.searchsorted(known, key), len(known) - 1)
                present = known[h] == key
                value = np.where(hit, np.log10(discount.counts(counts[at])) - total[h], np.where(present, alpha[h], 0.0))
            rest, out = np.flatnonzero(~hit), []
            rare = np.zeros(0, np.int64)
            if k == 2:
                p, found = chance(common.value, words[rest])
                value[rest[found]] += np.log10(p[found])
                rare = rest[~found]
            elif len(rest):
                out.append(_requests([c[rest] for c in columns[1:]], words[rest], *np.unique(owners[rest], return_inverse=True), hot, buckets, common.value))
            who, inverse = np.unique(owners, return_inverse=True)
            total = np.bincount(inverse, weights=np.power(10.0, value) if plain else value)
            # histories are dealt by their hash, rows by their numbers
            slices = (_mixed(who) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) if plain else who >> np.uint64(SLICE)
            out.append(_batch({"owner": pa.array(owners[rare].view(np.int64)), "w": pa.array(words[rare].view(np.int64))}))
            answers = pa.Table.from_pylist(list(_sliced(slices, who, total)), pa.schema(fields[:3]))
            found = pa.concat_tables([_widened(t, fields) for t in (answers, *map(_table, out))])
            release()
            return found

        return answer

    def _common_grams(self) -> _Common:
        """At most ``COMMON`` commonest grams of the highest order with their log10 probabilities."""
        k, discount, common = self.order, self.discounts[self.order], self.common

        def graded(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for counts in batch.column(0).to_pylist():
                    c, n = np.unique(np.frombuffer(counts, np.uint64), return_counts=True)
                    yield _batch({"c": pa.array(c.view(np.int64)), "n": pa.array(n)})

        sizes = self.levels[k].select("counts").mapInArrow(graded, "c long, n long").groupBy(F.floor(F.log2("c") * 8).cast("int").alias("level")).agg(F.min("c").alias("least"), F.sum("n").alias("n"))
        total, least = 0, None
        for r in sorted(sizes.collect(), key=lambda r: -r["level"]):  # a few hundred at most
            if total + r["n"] > COMMON:
                break
            total, least = total + r["n"], r["least"]
        if least is None:
            return _Common(np.zeros(0, np.uint64), np.zeros(0))

        def picked(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = _table(batch.slice(i, 1))
                    columns, words, more = _unpacked(row, k, {"counts": np.uint64}, common.value)
                    c = more["counts"].astype(np.int64)
                    at = np.flatnonzero(c >= least)
                    key = key_of([x[at] for x in columns])
                    total = np.frombuffer(row["total"][0].as_py(), np.float64)
                    h = np.searchsorted(np.frombuffer(row["key"][0].as_py(), np.uint64), key)
                    yield _batch({"gram": pa.array(_mixed(key * _STEP + words[at]).view(np.int64)), "logp": pa.array(np.log10(discount.counts(c[at])) - total[h])})

        found = self.levels[k].mapInArrow(released(picked), "gram long, logp double").toArrow()
        return _Common(found["gram"].to_numpy().view(np.uint64), found["logp"].to_numpy())

    def _repeated_grams(self) -> np.ndarray:
        """A bitmap of the highest order's grams that occur more than once."""
        k, common = self.order, self.common

        def repeated(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for i in range(batch.num_rows):
                    columns, words, more = _unpacked(_table(batch.slice(i, 1)), k, {"counts": np.uint64}, common.value)
                    at = np.flatnonzero(more["counts"] > 1)
                    yield _batch({"gram": pa.array(_mixed(key_of([c[at] for c in columns]) * _STEP + words[at]).view(np.int64))})

        table = self.levels[k].select("hists", "lens", "words", "counts")
        return key_bitmap(table.mapInArrow(released(repeated), "gram long"))

    def score(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), learned: Column | None = None) -> DataFrame:
        """``keep`` and (n_tokens, n_known, base_score, score) of every row.

        ``n_known`` counts tokens of the training texts, ``base_score`` is the sum of
        ``log10((c + 1) / (N + V + 1))``, ``score`` the model's log10 probability of the text.

        ``learned`` marks rows whose texts were all among the training texts.  It changes no score, but saves requests: a
        pair of such a text that is no repeated gram occurs exactly once, and its history's total is the word's count.
        """
        own = [f"k{i}" for i in range(len(keep))]
        learned = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
        rows = docs.select(F.col(text).cast("string").alias("t"), learned.alias("learned"), text_key(F.col(text)).alias("x"), *[F.col(c).alias(n) for c, n in zip(keep, own)])
        k, buckets, hot, words = self.order, self.buckets, self.hot[self.order], self.common
        grams = self.spark.sparkContext.broadcast(self._common_grams())
        bits = self.spark.sparkContext.broadcast(self._repeated_grams())
        rows_schema = to_arrow_schema(rows.schema)
        base, once = float(np.log10(self.n + self.v + 1)), float(self.discounts[k].ratio[1])

        def answered(parts, hashes: np.ndarray, counts: np.ndarray):
            """Histories of the tokens, their log10 probabilities and which are answered by the broadcasts."""
            columns = histories(hashes, k)
            gram = _mixed(key_of(columns) * _STEP + hashes)
            value, hit = grams.value.find(gram)
            if k == 2 and once < 1:  # a discounted follower frees mass, so the history's total is its count
                known = np.repeat(np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p, _ in parts]), counts)
                single = np.flatnonzero(known & ~hit)
                single = single[~in_bitmap(bits.value, gram[single])]
                c, found = words.value.find(columns[0][single])
                single, c = single[found], c[found]
                value[single], hit[single] = np.log10(once) - np.log10(c), True
            return columns, value, hit

        kinds = [("owner", pa.int64()), ("learned", pa.bool_()), ("x", pa.int64()), *((n, rows_schema.field(n).type) for n in own), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("logp", pa.float64()), ("rest", pa.list_(pa.int64()))]
        fields = [*kinds, *_REQUEST]

        def profiled(batches: Iterator[pa.RecordBatch]):
            """What the common words and grams answer of each row, with the words left; and packed requests for the grams left."""
            first = TaskContext.get().partitionId() << 32  # rows are numbered
            for parts, hashes in _Held(batches):
                table = pa.Table.from_batches([p for p, _ in parts])
                counts = np.concatenate([n for _, n in parts])
                ends = np.cumsum(counts)
                edges = ends - counts
                owners = np.arange(first, first + len(counts), dtype=np.uint64)
                first += len(counts)
                c, known = words.value.find(hashes)
                columns, value, hit = answered(parts, hashes, counts)
                rest = np.flatnonzero(~known)
                left = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, np.concatenate(([0], ends))), pa.int32()), pa.array(hashes[rest].view(np.int64)))
                sums = {
                    "owner": pa.array(owners.view(np.int64)),
                    "n_tokens": pa.array(counts), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), edges)),
                    "base": pa.array(np.add.reduceat(np.where(known, np.log10(c + 1), 0.0), edges) - counts * base),
                    "logp": pa.array(np.add.reduceat(np.where(hit, value, 0.0), edges)), "rest": left,
                }
                yield from _widened(pa.table({n: table[n] for n in ("learned", "x", *own)} | sums), fields).combine_chunks().to_batches()
                rest = np.flatnonzero(~hit)
                if len(rest):
                    packed = _requests([c[rest] for c in columns], hashes[rest], owners, np.repeat(np.arange(len(owners)), counts)[rest], hot, buckets, words.value)
                    yield from _widened(_table(packed), fields).combine_chunks().to_batches()

        kept = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in own)
        passed = written(rows.mapInArrow(released(profiled), f"owner long, learned boolean, x long{kept}, n_tokens long, n_known long, base double, logp double, rest array<long>, {_PACKED}"), "katz-profiles", "zstd")
        profiles = passed.where("owner IS NOT NULL").select([n for n, _ in kinds])
        sums = self._evaluated(passed.where("bucket IS NOT NULL").select([n for n, _ in _REQUEST]), k)

        rare = profiles.select("owner", F.explode("rest").alias("w")).join(self.words, "w").groupBy("owner").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more_base"))
        # equal texts have the sums of one of them, which differ by their order
        texts = profiles.groupBy("x", "learned").agg(F.min("owner").alias("of"))
        out = profiles.drop("owner", "rest").join(texts, ["x", "learned"]).withColumnRenamed("of", "owner")
        out = out.join(sums, "owner", "left").join(rare, "owner", "left")
        none = F.lit(0.0)
        out = out.select(
            *[F.col(n).alias(c) for c, n in zip(keep, own)],
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
            (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
            (F.col("logp") + F.coalesce("value", none)).alias("score"),
        )
        out = written(out, "katz-scores")
        for table in (passed, *self.scratch):
            forget(table)
        self.scratch = []
        grams.destroy(), bits.destroy()
        return out


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Katz:
    """Count the texts of ``docs`` and write the model of ``order`` words."""
    if order < 2:
        raise ValueError("the model has at least two orders")
    rows = docs.select(F.col(text).cast("string").alias("t"))
    model = Katz(docs.sparkSession, order)
    model._learn_words(rows)
    for k in range(2, order + 1):
        model._learn(rows, k)
    return model


def _requests(columns: list[np.ndarray], words: np.ndarray, owners: np.ndarray, who: np.ndarray, hot: np.ndarray, buckets: int, common: _Common) -> pa.RecordBatch:
    """Packed requests for the grams ``columns`` + ``words``; ``who`` says which of the ``owners`` asks."""
    key = key_of(columns)
    rows = []
    for row in _packs(_bucket_of(key, words, hot, buckets), columns, key, words, {"who": who.astype(np.uint32)}, common):
        used, own = np.unique(np.frombuffer(row["who"], np.uint32), return_inverse=True)
        own = own.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
        # differences, which are small for numbered rows
        rows.append(row | {"owners": np.diff(owners[used], prepend=np.uint64(0)).tobytes(), "who": own.tobytes()})
    return pa.RecordBatch.from_pylist(rows, pa.schema(_REQUEST))


def _sliced(slices: np.ndarray, owners: np.ndarray, values: np.ndarray):
    """Yield a row for each slice: its owners, packed like those of requests, and their values."""
    order = np.argsort(slices, kind="stable")
    slices, owners, values = slices[order], owners[order], values[order]
    edges = _runs(slices)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(slices)]):
        yield {"slice": int(slices[a]), "named": np.diff(owners[a:b], prepend=np.uint64(0)).tobytes(), "values": values[a:b].tobytes()}


def _added(table: pa.Table) -> pa.Table:
    """(owner, value): the sums of a slice."""
    owners = np.concatenate([np.cumsum(np.frombuffer(x, np.uint64), dtype=np.uint64) for x in table["named"].to_pylist()])
    values = np.concatenate([np.frombuffer(x, np.float64) for x in table["values"].to_pylist()])
    who, inverse = np.unique(owners, return_inverse=True)
    out = pa.table({"owner": pa.array(who.view(np.int64)), "value": pa.array(np.bincount(inverse, weights=values))})
    release()
    return out


def _asked(table: pa.Table, order: int, common: _Common) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Owners, history columns and words of packed requests."""
    columns, words, _ = _unpacked(table, order, {}, common)
    owners = [np.zeros(0, np.uint64)]
    for names, who in zip(table["owners"].to_pylist(), table["who"].to_pylist()):
        names = np.cumsum(np.frombuffer(names, np.uint64), dtype=np.uint64)
        owners.append(names[np.frombuffer(who, np.uint16 if len(names) <= 1 << 16 else np.uint32)])
    return np.concatenate(owners), columns, words


class _Common:
    """Values of the commonest keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.slots, self.values = Slots(keys), np.append(values, values.dtype.type(0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values (0 for others), and which of them are common."""
        at = self.slots.find(keys)
        return self.values[at], at >= 0

    def decoded(self, data: bytes, n: int) -> np.ndarray:
        """The ``n`` words of ``_coded``."""
        high = np.frombuffer(data, np.uint8, n, 2 * n)
        place = high.astype(np.int32) << 16 | np.frombuffer(data, "<u2", n)
        rare = high == 255
        if not rare.any():
            return self.slots.keys[place]
        out = np.empty(n, np.uint64)
        out[~rare], out[rare] = self.slots.keys[place[~rare]], np.frombuffer(data, np.uint64, -1, 3 * n)
        return out


def _widened(table: pa.Table, fields) -> pa.Table:
    columns = [table[n] if n in table.column_names else pa.nulls(table.num_rows, kind) for n, kind in fields]
    return pa.table(dict(zip([n for n, _ in fields], columns)))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
