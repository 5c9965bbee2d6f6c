"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted documents are split by a hash of their id: one in ``HELD_OUT`` sets the thresholds
(scores of text the model has learned would be too good), all others train the model.

Counts: each task counts the ``order``-grams of its documents (all, and of training ones) and
the counts are summed by gram; nothing is sampled, so the model grows with the corpus.  Lower orders are continuation counts (distinct left neighbours).  Each order has the
three discounts of its counts of counts.  Probabilities of all grams of the corpus come from
joins of count tables that are sharded by gram, order by order: the seen gram, its history
(total and numbers of followers seen once, twice, more often) and the next lower order.

Scoring: the commonest grams (at most ``frequent``, whatever the corpus) are broadcast with
their log probabilities; each task sums those and keeps the rest of a document's grams,
which join the sharded table.  Documents with equal text share these rows, keyed by a hash of
the text.  The score is the perplexity per character, shrunk towards that of trusted text by
``PRIOR`` characters, because the perplexity of a short text says little.

Threshold: the ``upper`` quantile of the held-out trusted documents' log perplexity, for each
language, shrunk towards the quantile of all languages' together as if that were ``SHRINK`` more
documents; a document beyond it is rejected.  A language without any has the pooled quantile.

Cases: null and empty texts have the end mark as their only character and score the prior; null languages form one
language; without trusted documents nothing is rejected; repeated rows each get a row; very
long texts are worked on whole; an empty table gives an empty result; own columns replace
columns of the same name; U+0002 and U+0003 in a text count as U+FFFD (the model uses them as marks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm.common import Slots, compressed, key_bitmap, released, text_groups, unpacked_groups, written

PAD = "\x02"
END = "\x03"
#: The marks in a text itself count as replacement characters.
_OWN = {2: "\ufffd", 3: "\ufffd"}
#: Bits of a character in a packed gram; others are counted by their text.
NARROW = 12
PRIOR = 200
#: Held-out documents that the pooled quantile counts for beside a language's own.
SHRINK = 10
HELD_OUT = 5
#: Characters worked on at once.
GROUP = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The ``order``-grams of a group of texts: one per character and one for the end mark."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        marked = [PAD * (order - 1) + t.translate(_OWN) + END for t in texts]
        self.text = "".join(marked)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.counts = sizes - (order - 1)
        self.edges = np.concatenate(([0], np.cumsum(self.counts)))
        # not the grams that reach into the next text
        self.at = np.arange(self.edges[-1]) + np.repeat(np.arange(len(texts)) * (order - 1), self.counts)

    def hashes(self) -> np.ndarray:
        codes = self.codes.astype(np.uint64)
        hashes = np.zeros(len(codes) - self.order + 1, np.uint64)
        for k in range(self.order):
            hashes = hashes * _STEP + codes[k : k + len(hashes)]
        hashes ^= hashes >> np.uint64(31)
        return hashes[self.at]

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams' characters in one number each, and which grams have one beyond ``NARROW`` bits."""
        codes = self.codes.astype(np.uint64)
        held = np.zeros(len(codes) - self.order + 1, np.uint64)
        wide = np.zeros(len(held), bool)
        for k in range(self.order):
            some = codes[k : k + len(held)]
            held |= some << np.uint64(NARROW * k)
            wide |= some >> np.uint64(NARROW) != 0
        return held[self.at], wide[self.at]

    def gram(self, i: int) -> str:
        at = self.at[i]
        return self.text[at : at + self.order]


def _unpacked(packed: np.ndarray, order: int) -> list[str]:
    codes = (packed[:, None] >> (np.arange(order, dtype=np.uint64) * np.uint64(NARROW))) & np.uint64((1 << NARROW) - 1)
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + order] for i in range(0, len(text), order)]


def hashed(grams: list[str], order: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, order)
    hashes = np.zeros(len(codes), np.uint64)
    for k in range(order):
        hashes = hashes * _STEP + codes[:, k]
    return hashes ^ (hashes >> np.uint64(31))


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n, trusted): occurrences in all and in training documents.  ``docs`` has z (compressed text), good."""

    names = ["gram", "n", "trusted"]

    def batch(grams: list[str], n: np.ndarray, trusted: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64()), pa.array(trusted, pa.int64())], names)

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, n, trusted = (np.concatenate(x) for x in zip(*parts))
        at = np.argsort(keys)
        keys = keys[at]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[begins], np.add.reduceat(n[at], begins), np.add.reduceat(trusted[at], begins)

    def counted(batches: Iterator[pa.RecordBatch]):
        parts: list[tuple[np.ndarray, ...]] = []  # narrow grams, packed
        total: dict[str, list[int]] = {}  # others

        def flush():
            if parts:
                keys, n, trusted = summed(parts)
                parts.clear()
                for i in range(0, len(keys), 100_000):
                    yield batch(_unpacked(keys[i : i + 100_000], order), n[i : i + 100_000], trusted[i : i + 100_000])
            values = np.array(list(total.values()), np.int64).reshape(-1, 2)
            yield batch(list(total), values[:, 0], values[:, 1])
            total.clear()

        for part, texts in unpacked_groups(batches, 0, GROUP):
            g = Grams(texts, order)
            good = np.repeat(np.array([bool(x) for x in part.column(1).to_pylist()]), g.counts)
            packed, wide = g.packed()
            if NARROW * order > 63:
                wide[:] = True
            narrow = np.sort((packed << np.uint64(1) | good)[~wide])
            if len(narrow):
                begins = np.flatnonzero(np.concatenate(([True], narrow[1:] != narrow[:-1])))
                n = np.diff(np.concatenate((begins, [len(narrow)])))
                keys = narrow[begins]
                parts.append((keys >> np.uint64(1), n, np.where(keys & np.uint64(1), n, 0)))
            if wide.any():
                wide = np.flatnonzero(wide)
                _, where, inverse, n = np.unique(g.hashes()[wide], return_index=True, return_inverse=True, return_counts=True)
                trusted = np.bincount(inverse, weights=good[wide], minlength=len(n)).astype(np.int64)
                for i, a, b in zip(wide[where].tolist(), n.tolist(), trusted.tolist()):
                    held = total.setdefault(g.gram(i), [0, 0])
                    held[0] += a
                    held[1] += b
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts[:] = [summed(parts)]
                if len(parts[0][0]) > 1_000_000:
                    yield from flush()
            if len(total) > 300_000:
                yield from flush()
        yield from flush()

    rows = docs.select("z", "good").mapInArrow(released(counted), "gram string, n long, trusted long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


def text_hash(text):
    """The key documents of equal text share."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order, from its counts of counts (four numbers)."""
    row = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[k] or 0 for k in range(4))
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    bounded = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else k / 2
    return bounded(1, n1, n2), bounded(2, n2, n3), bounded(3, n3, n4)


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(gram, n, logp) for every gram of the corpus, by the model of the trusted counts."""
    tables = {order: counts.where("trusted > 0").select("gram", F.col("trusted").alias("c"))}
    for k in range(order - 1, 0, -1):  # continuation counts; the longer gram's last k characters
        tables[k] = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        tables[k] = written(tables[k], "kneser-ney-counts")  # each order is small beside the next
    needed = {order: counts.select("gram")}
    for k in range(order - 1, 0, -1):
        needed[k] = needed[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()

    size = tables[1].agg(F.count("*")).first()[0] + 1  # characters, and one for all unseen
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[k])
        seen = tables[k]
        history = seen.groupBy(F.substring("gram", 1, k - 1).alias("past")).agg(
            F.sum("c").alias("total"),
            (F.count(F.when(F.col("c") == 1, 1)) * d1 + F.count(F.when(F.col("c") == 2, 1)) * d2 + F.count(F.when(F.col("c") > 2, 1)) * d3).alias("mass"),
        )
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = needed[k].join(seen, "gram", "left").withColumn("past", F.substring("gram", 1, k - 1))
        rows = rows.join(history, "past", "left")
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / size))
        else:
            rows = rows.withColumn("gram_low", F.substring("gram", 2, k - 1)).join(lower.select(F.col("gram").alias("gram_low"), F.col("p").alias("q")), "gram_low")
        own = F.coalesce(F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * F.col("q")
        lower = written(rows.select("gram", own.alias("p")), "kneser-ney-order")
    return counts.select("gram", "n").join(lower, "gram").select("gram", "n", F.log("p").alias("logp"))


def _frequent(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The grams of at least so many occurrences that at most ``most`` grams have."""
    level = F.floor(F.log2("n") * 4).cast("int").alias("level")
    levels = sorted(((r[0], r[1]) for r in model.groupBy(level).agg(F.count("*")).collect()), reverse=True)  # a few hundred at most
    total, least = 0, None
    for at, n in levels:
        if total + n > most:
            break
        total, least = total + n, at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), 0
    rows = model.where(F.floor(F.log2("n") * 4) >= least).select("gram", "logp").toArrow()
    grams = rows["gram"].to_pylist()
    keys = hashed(grams, len(grams[0]))
    keys, at = np.unique(keys, return_index=True)
    return keys, rows["logp"].to_numpy()[at], len(grams)


def score(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 5, frequent: int = 300_000) -> DataFrame:
    """(d, lang, x, calibrates, n_scored, logp): ``x`` is the text's hash, ``logp`` is the sum over the text's grams.

    ``trusted`` has one column, the ids of trusted documents.
    """
    spark = docs.sparkSession
    ids = trusted.select(F.col(trusted.columns[0]).alias("d")).where("d IS NOT NULL").distinct()
    held_out = F.pmod(F.xxhash64("d"), F.lit(HELD_OUT)) == 0
    ids = ids.select("d", (~held_out).alias("good"), held_out.alias("calibrates"))
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"))
    # only texts whose ids may be labelled go (compressed) through the join with the labels
    ids = written(ids, "kneser-ney-labels")
    labelled = spark.sparkContext.broadcast(key_bitmap(ids.select(F.xxhash64("d"))))
    named = rows.select("d", "t", F.xxhash64("d").alias("x"))
    maybe = compressed(named, labelled).join(ids, "d", "left").select("z", "good")
    others = compressed(named, labelled, outside=True).select("z", F.lit(None).cast("boolean").alias("good"))
    counts = written(gram_counts(maybe.unionByName(others), order), "kneser-ney-grams")
    model = written(probabilities(counts, order), "kneser-ney-model")
    keys, logp, _ = _frequent(model, frequent)
    held = spark.sparkContext.broadcast((Slots(keys), np.append(logp, 0.0)))

    def scored(batches: Iterator[pa.RecordBatch]):
        slots, logp = held.value
        for part, texts in text_groups(batches, 1, GROUP):
            g = Grams(texts, order)
            at = slots.find(g.hashes())
            total = np.add.reduceat(logp[at], g.edges[:-1])
            missed = np.flatnonzero(at < 0)
            owner = np.searchsorted(g.edges, missed, side="right") - 1
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            grams = [g.gram(i) for i in missed.tolist()]
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(g.counts, pa.int64()), pa.array(total, pa.float64()), rest], ["d", "lang", "x", "n_scored", "common", "rest"])

    keyed = rows.select("d", "t", "lang", text_hash(F.col("t")).alias("x"))
    kind = keyed.schema["d"].dataType.simpleString()
    first = written(keyed.mapInArrow(released(scored), f"d {kind}, lang string, x long, n_scored long, common double, rest array<string>"), "kneser-ney-scores")
    rare = first.where(F.size("rest") > 0).select("x", "rest").groupBy("x").agg(F.first("rest").alias("rest"))
    rare = rare.select("x", F.explode("rest").alias("gram")).groupBy("x", "gram").agg(F.count("*").alias("k"))
    more = rare.join(model.select("gram", "logp"), "gram").groupBy("x").agg(F.sum(F.col("k") * F.col("logp")).alias("more"))
    whole = first.drop("rest").join(more, "x", "left").join(ids.select("d", "calibrates"), "d", "left")
    return whole.select("d", "lang", "x", F.coalesce("calibrates", F.lit(False)).alias("calibrates"), "n_scored", (F.col("common") + F.coalesce("more", F.lit(0.0))).alias("logp"))


def classify(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 5, frequent: int = 300_000, upper: float = 0.995) -> DataFrame:
    """(doc_id, lang, text_hash, n_scored, perplexity, log_limit, kept) of every row."""
    scores = written(score(docs, trusted, doc_id, text, lang, order, frequent), "kneser-ney-sums")
    good = scores.where("calibrates")
    prior = good.agg(F.sum("logp"), F.sum("n_scored")).first()
    mean = prior[0] / prior[1] if prior[1] else -float(np.log(100))
    ppl = scores.withColumn("log_ppl", -(F.col("logp") + PRIOR * mean) / (F.col("n_scored") + PRIOR))
    good = ppl.where("calibrates")
    stats = [F.count("*").alias("k"), F.percentile_approx("log_ppl", upper, 10_000).alias("q")]
    overall = good.agg(*stats).first()
    pooled = F.lit(overall["q"]).cast("double")
    own = (F.col("k") * F.col("q") + SHRINK * pooled) / (F.col("k") + SHRINK)
    by_lang = good.groupBy("lang").agg(*stats).select(F.col("lang").alias("of"), own.alias("own_limit"))
    judged = ppl.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("log_limit", F.coalesce("own_limit", pooled))
    kept = F.coalesce(F.col("log_ppl") <= F.col("log_limit"), F.lit(True))
    return judged.select(F.col("d").alias("doc_id"), "lang", F.col("x").alias("text_hash"), "n_scored", F.exp("log_ppl").alias("perplexity"), "log_limit", kept.alias("kept"))
