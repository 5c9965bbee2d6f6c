"""Exact top-k inner-product search over norm-sorted vectors.

Vectors are integers: ``floor(scale * component)``.  They are range-partitioned and sorted
by descending length and written once.  The rotation of the SVD (eigenvectors of the sum of
``v v'``, gathered as d x d sums) puts most of every inner product into the first ``head``
dimensions.  Each task walks its vectors from the longest on: a block is skipped for a query
when ``|q| * longest`` stays below the query's k-th best score, and a pair when its partial
sum over the head plus the Cauchy-Schwarz bound of the rest does.  What remains is scored
exactly in integers.  The first thresholds come from the ``seeds`` longest vectors.

Queries go out in chunks of about ``chunk`` rows, so what is broadcast is bounded; a task sends
at most k rows per query.

Cases: vectors that are null or hold null or non-finite components take no part, nor do null
ids; rows repeating an id count once (the largest vector); shorter vectors count as padded
with zeros; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigtrace.llm.common import written

BLOCK = 1024


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v, norm2): usable rows, one per id."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    usable = rows.where(F.col(vec_id).isNotNull() & x.isNotNull()).where(finite)
    ints = usable.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))
    once = ints.groupBy("vec_id").agg(F.max("v").alias("v"))
    return once.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(ends), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, by descending singular value."""

    def summed(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(float)
            total += m.T @ m
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "x"])

    rows = vectors.select("v").mapInArrow(summed, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # width * width
    gram = np.zeros((width, width))
    for i, j, x in rows:
        gram[i, j] = x
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


class Queries:
    """A chunk of queries, rotated, with their best results so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, head: int, k: int):
        self.ids, self.vectors, self.turn, self.head, self.k = ids, vectors, turn, head, k
        turned = vectors @ turn
        self.top, self.norm = turned[:, :head], np.sqrt((turned**2).sum(1))
        self.rest = np.sqrt((turned[:, head:] ** 2).sum(1))
        self.least = np.full(len(ids), -np.inf)  # the k-th best score known

    def best_of(self, batches) -> dict[int, list[tuple[int, int]]]:
        """For each query (by place) its best ``(-score, vec_id)`` of these blocks ``(ids, vectors)``."""
        found: dict[int, list[tuple[int, int]]] = {}
        for ids, vectors in batches:
            norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
            slack = 1e-6 * (1 + norms.max(initial=0) * self.norm)
            active = np.flatnonzero(self.norm * norms.max(initial=0) + slack >= self.least)
            if not len(active) or not len(ids):
                continue
            turned = vectors @ self.turn
            rest = np.sqrt((turned[:, self.head :] ** 2).sum(1))
            bound = self.top[active] @ turned[:, : self.head].T + np.outer(self.rest[active], rest)
            hit = bound + slack[active, None] >= self.least[active, None]
            hit &= self.ids[active, None] != ids[None, :]
            for row in np.flatnonzero(hit.any(1)):
                q = int(active[row])
                own = np.flatnonzero(hit[row])
                scores = vectors[own] @ self.vectors[q]
                if len(own) > self.k:
                    order = np.lexsort((ids[own], -scores))[: self.k]
                    own, scores = own[order], scores[order]
                best = found.get(q, []) + list(zip((-scores).tolist(), ids[own].tolist()))
                best.sort()
                found[q] = best = best[: self.k]
                if len(best) == self.k:
                    self.least[q] = max(self.least[q], -best[-1][0])
        return found


def top_k(rows: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = 256, head: int = 16, seeds: int = 2_048, chunk: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row where ``is_query`` holds."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, vec_id, embedding, scale)
    # ids in the sort key: rows of one length can still be dealt to several partitions
    ordered = vectors.repartitionByRange(F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"), "vec_id")
    ordered = written(ordered, "search-vectors")
    asked = ordered.where(is_query(F.col("vec_id")))
    width, n = ordered.agg(F.max(F.size("v")), F.count("*")).first()
    n_asked = asked.count()
    result = "query_id long, vec_id long, score long"
    if not n or not n_asked or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(ordered, width)
    first = ordered.orderBy(F.desc("norm2"), "vec_id").limit(seeds).select("vec_id", "v").toArrow()
    longest = (first["vec_id"].to_numpy(), _matrix(first["v"].combine_chunks(), width))

    chunks = -(-n_asked // chunk)
    found = None
    for at in range(chunks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == at).select("vec_id", "v").toArrow()
        if not some.num_rows:
            continue
        queries = Queries(some["vec_id"].to_numpy(), _matrix(some["v"].combine_chunks(), width), turn, min(head, width), k)
        queries.best_of([longest])  # only for the thresholds
        held = spark.sparkContext.broadcast(queries)

        def searched(batches: Iterator[pa.RecordBatch], held=held):
            own = held.value
            queries = Queries(own.ids, own.vectors, own.turn, own.head, own.k)
            queries.least = own.least.copy()

            def blocks():
                for batch in batches:
                    for start in range(0, batch.num_rows, BLOCK):
                        part = batch.slice(start, BLOCK)
                        yield part.column(0).to_numpy(), _matrix(part.column(1), width)

            flat = [(int(queries.ids[q]), i, -s) for q, best in queries.best_of(blocks()).items() for s, i in best if -s >= own.least[q]]
            columns = list(zip(*flat)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        part = ordered.select("vec_id", "v").mapInArrow(searched, result)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
