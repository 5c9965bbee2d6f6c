"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Training takes a bounded sample of labelled rows: at most ``per_class`` documents of either
label, those of smallest id hash.  Features are words, the first characters of longer words
(``STEMS`` of them), and each of these being there ``MARKS`` times or more - a cosine alone
does not tell one chance hit from many.  Those that tell the labels apart (chi-square, at
most ``features``) are kept, and their document frequencies are counted over all documents.

The examples are an inverted index in blocks with the largest weight of each feature per
block.  A document takes the blocks of highest upper bound, then all others that can still hold
one of its ``k`` nearest examples, so the cosines and neighbours are exact (ties: smaller id);
documents of a group that take the same block take it together.  The neighbours vote with their squared cosines, weighted back to the
labels' true frequencies; a logistic fit on leave-one-out votes of the examples calibrates
the score.  A document without any feature gets the rate of such examples.

The index is bounded by the sample, so it is broadcast; the corpus is one map pass.

Cases: null and empty texts have no feature; null labels are ignored and repeated ones count
as toxic if any is; without examples of both labels every score is the share of toxic labels
(0 if there are none); repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm.common import BoundedCache, text_groups, written

STEMS = (4, 5, 6)
MARKS = (2, 4)
#: Chi-square of one degree of freedom at p = 0.001.
SIGNIFICANT = 10.83
BLOCK = 64
#: Documents that take blocks together, and the blocks a document takes before it knows how near the nearest are.
TOGETHER, FIRST = 256, 4
#: A word's features begin with its first characters.
_HEAD = min(STEMS)
_WORD = re.compile(r"\w+")


@lru_cache(10_000)
def _damped(n: int) -> float:
    return float(1 + np.log(n))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}-" for n in STEMS if len(word) > n))


def all_features(text: str) -> set[str]:
    found = Counter(f for w in words_of(text) for f in features_of(w))
    return {*found, *(f"{f}@{m}" for f, n in found.items() for m in MARKS if n >= m)}


class Vectors:
    """Counts of the chosen features, word by word through a bounded cache."""

    def __init__(self, names: list[str]):
        plain = sorted({n.rpartition("@")[0] or n for n in names})
        number = {n: i for i, n in enumerate(names)}
        self.stems = {p: i for i, p in enumerate(plain)}
        # of each plain feature: its own number and those of its marks
        self.plain = [number.get(p) for p in plain]
        self.marks = [[(m, number[f"{p}@{m}"]) for m in MARKS if f"{p}@{m}" in number] for p in plain]
        self.cache = BoundedCache(limit=400_000)
        self.heads = {p[:_HEAD] for p in plain}

    def counts(self, texts: list[str]) -> list[dict[int, int]]:
        split = [words_of(t) for t in texts]
        needed = set().union(*split)
        new = self.cache.missing(needed)
        self.cache.update(dict.fromkeys(new, ()))  # most words have no feature
        self.cache.update({w: tuple(self.stems[f] for f in features_of(w) if f in self.stems) for w in new if w[:_HEAD] in self.heads})
        out = []
        for words in split:
            held: dict[int, int] = {}
            for i, n in Counter(chain.from_iterable(map(self.cache.__getitem__, words))).items():
                if self.plain[i] is not None:
                    held[self.plain[i]] = n
                for m, mark in self.marks[i]:
                    if n >= m:
                        held[mark] = 1
            out.append(held)
        return out


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, ids: list[int], toxic: np.ndarray, vectors: list[dict[int, float]], features: int, weight: tuple[float, float]):
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=vectors[i].get, default=-1), ids[i]))  # like with like
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.toxic = toxic[order]
        self.weight = np.where(self.toxic == 1, weight[1], weight[0])
        blocks = -(-len(order) // BLOCK)
        self.most = np.zeros((features, blocks))
        # a block's postings: the features found in it, and a row of weights for each of them
        self.found, self.rows = [], []
        for b in range(blocks):
            own = order[b * BLOCK : (b + 1) * BLOCK]
            found = np.array(sorted({f for i in own for f in vectors[i]}), np.int64)
            rows = np.zeros((len(found), BLOCK))
            for at, i in enumerate(own):
                rows[np.searchsorted(found, list(vectors[i])), at] = list(vectors[i].values())
            self.most[found, b] = rows.max(1)
            self.found.append(found)
            self.rows.append(rows)

    def nearest(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([vector], k)[0]

    def nearest_of(self, vectors: list[dict[int, float]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector, places and cosines of the ``k`` nearest examples with a cosine above 0.

        Vectors that take the same block take it together; ``without`` has a place to leave out for each.
        """
        out = []
        for at in range(0, len(vectors), TOGETHER):
            out += self._nearest(vectors[at : at + TOGETHER], k, None if without is None else without[at : at + TOGETHER])
        return out

    def _nearest(self, vectors: list[dict[int, float]], k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, blocks = len(vectors), len(self.rows)
        sizes = [len(v) for v in vectors]
        held = np.zeros((n, len(self.most)))
        held[np.repeat(np.arange(n), sizes), np.fromiter(chain.from_iterable(vectors), np.int64, sum(sizes))] = list(chain.from_iterable(v.values() for v in vectors))
        bound = held @ self.most
        cosines = np.zeros((n, blocks * BLOCK))
        taken, rank, at, some, least = np.zeros((n, blocks), bool), np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1), 0, FIRST, np.zeros(n)
        while at < blocks:
            # the blocks of highest bound that can hold one of the nearest
            now = (bound > 0) & (bound >= least[:, None] - 1e-9) & (rank < at + some) & ~taken
            for b in np.flatnonzero(now.any(0)).tolist():
                own = np.flatnonzero(now[:, b])
                cosines[own, b * BLOCK : (b + 1) * BLOCK] = held[np.ix_(own, self.found[b])] @ self.rows[b]
            if without is not None:
                cosines[np.arange(n), without] = 0.0
            taken |= now
            at, some = at + some, blocks
            if cosines.shape[1] > k:
                least = np.partition(cosines, -k, axis=1)[:, -k]
        row, place = np.nonzero((cosines > 0) & (cosines >= least[:, None] - 1e-9))
        cosine = cosines[row, place]
        order = np.lexsort((self.ids[place], -np.round(cosine, 12), row))
        place, cosine = place[order], cosine[order]
        edges = np.searchsorted(row, np.arange(n + 1)).tolist()
        return [(place[a:b][:k], cosine[a:b][:k]) for a, b in zip(edges, edges[1:])]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine**2 * self.weight[at]
        return float((w * self.toxic[at]).sum() / w.sum())


class Classifier:
    def __init__(self, names: list[str], idf: np.ndarray, ids: list[int], toxic: np.ndarray, counts: list[dict[int, int]], shares: tuple[float, float], k: int):
        self.names, self.idf, self.k = names, idf, k
        self.weights = [float(x) for x in idf]  # plain numbers: a document has few features, too few for arrays
        weight = tuple(shares[y] / max(1, int((toxic == y).sum())) for y in (0, 1))
        vectors = [self.vector(c) for c in counts]
        bare = np.array([not v for v in vectors], bool)
        own = np.where(toxic == 1, weight[1], weight[0])
        self.bare = float((own * toxic)[bare].sum() / own[bare].sum()) if bare.any() else float(shares[1])
        some = np.flatnonzero(~bare)
        self.index = Index([ids[i] for i in some], toxic[some], [vectors[i] for i in some], len(names), weight)
        place = {int(x): n for n, x in enumerate(self.index.ids)}
        votes, labels, weights = [], [], []
        others = self.index.nearest_of([vectors[i] for i in some], k, np.array([place[ids[i]] for i in some], np.int64))
        for i, (at, cosine) in zip(some, others):
            if len(at):
                votes.append(self.index.vote(at, cosine)), labels.append(toxic[i]), weights.append(own[i])
        self.slope, self.shift = _logistic(np.array(votes), np.array(labels, float), np.array(weights))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        w = {f: _damped(n) * self.weights[f] for f, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {f: x / norm for f, x in w.items()}

    def scores(self, counts: list[dict[int, int]]) -> list[tuple[float, list[int]]]:
        """For each document the calibrated score, and the ids of the nearest examples."""
        out: list[tuple[float, list[int]]] = [(self.bare, [])] * len(counts)
        some = [i for i, c in enumerate(counts) if c]
        for i, (at, cosine) in zip(some, self.index.nearest_of([self.vector(counts[i]) for i in some], self.k)):
            if len(at):
                out[i] = float(1 / (1 + np.exp(-(self.slope * self.index.vote(at, cosine) + self.shift)))), self.index.ids[at].tolist()
        return out

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        return self.scores([counts])[0]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic fit of y on x by Newton steps, with a rising slope."""
    if not len(x) or y.min() == y.max():
        return 8.0, -4.0
    w = w / w.mean()
    a = np.array([4.0, -2.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (w * (p - y)) + ridge * a
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a = a - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(a[0], 1e-3)), float(a[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = 2_000, features: int = 1_000, k: int = 15) -> Classifier | float:
    """The classifier, or a constant score where the labels can't teach one."""
    rows = labels.select(F.col(doc_id).alias("d"), F.col(toxic).cast("int").alias("y")).where("d IS NOT NULL AND y IN (0, 1)").groupBy("d").agg(F.max("y").alias("y"))
    known = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(known.values())
    share = known.get(1, 0) / total if total else 0.0
    if len(known) < 2:
        return share
    chosen = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("d"), "d").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * per_class ids
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"))
    sample = written(texts.join(F.broadcast(chosen), "d").dropDuplicates(["d"]).select("t", "d", "y"), "toxicity-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return share

    def seen(batches: Iterator[pa.RecordBatch]):
        found: list[Counter] = [Counter(), Counter()]
        for part, group in text_groups(batches, 0):
            for t, y in zip(group, part.column(2).to_pylist()):
                found[y].update(all_features(t))
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)], ["f", "b", "a"])

    table = sample.mapInArrow(seen, "f string, b long, a long").groupBy("f").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    p, q = float(n[1]), float(n[0])
    a, b = F.col("a"), F.col("b")
    chi = (p + q) * F.pow(a * (q - b) - b * (p - a), F.lit(2)) / ((a + b) * (p + q - a - b) * p * q)
    names = [r["f"] for r in table.where((a + b < p + q) & (a + b >= 5)).withColumn("chi", chi).where(F.col("chi") > SIGNIFICANT).orderBy(F.desc("chi"), "f").limit(features).collect()]
    if not names:
        return share

    def frequencies(batches: Iterator[pa.RecordBatch]):
        vectors, df, total = Vectors(names), np.zeros(len(names), np.int64), 0
        for _, group in text_groups(batches, 0):
            total += len(group)
            for c in vectors.counts(group):
                df[list(c)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(names))], pa.int32()), pa.array([total, *df.tolist()], pa.int64())], ["f", "n"])

    df = dict(tuple(r) for r in texts.select("t").mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n")).collect())  # one row per feature
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(names))]))) + 1

    def counted(batches: Iterator[pa.RecordBatch]):
        vectors = Vectors(names)
        for part, group in text_groups(batches, 0):
            c = vectors.counts(group)
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int64()), part.column(2), pa.array([list(x) for x in c], pa.list_(pa.int32())), pa.array([list(x.values()) for x in c], pa.list_(pa.int32()))], ["d", "y", "f", "n"])

    examples = sorted(sample.mapInArrow(counted, "d long, y int, f array<int>, n array<int>").collect())
    return Classifier(names, idf, [r["d"] for r in examples], np.array([r["y"] for r in examples]), [dict(zip(r["f"], r["n"])) for r in examples], (1 - share, share), k)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = 2_000, features: int = 1_000, k: int = 15) -> DataFrame:
    """(doc_id, score, evidence): the calibrated score and the ids of the nearest examples, nearest first."""
    model = train(docs, labels, doc_id, text, toxic, per_class, features, k)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]):
        model = held.value
        vectors = Vectors(model.names) if isinstance(model, Classifier) else None
        for part, group in text_groups(batches):
            found = model.scores(vectors.counts(group)) if vectors else [(model, [])] * len(group)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["d", "score", "evidence"])

    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(scored, f"d {rows.schema['d'].dataType.simpleString()}, score double, evidence array<long>").withColumnRenamed("d", "doc_id")
