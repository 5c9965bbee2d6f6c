"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

1. Tokenise: each document becomes pieces of at most ``capacity`` tokens (only longer
   documents are cut).  Chunks between white space are looked up in a bounded worker cache.
2. Range-sort: the pieces are ranked within their length.  Lengths are integers up to the
   capacity, so the sorted order is a run (length, count) per length: the ranks are counted
   inside each task and shifted by the counts of the tasks before it, and no task sees all
   pieces of a length.
3. Rounds: every run of documents, longest first, sweeps to its successor, the smallest gap
   it fits.  Where several documents seek one gap, the rank decides: the k-th document of
   the run gets the k-th gap and the rest sweeps on to the next larger gap.  After the round
   the gaps are updated; a gap takes one document a round.  When nothing fits, the longest
   documents open as many sequences as the rest needs at least.  Rounds work on runs (length
   or gap, first number, count) - a bounded number of them, whatever the corpus - and note
   moves ``(length, first rank, count) -> (first sequence, offset)``.
4. Every task looks its pieces up in the moves by length and rank.

Cases: null or empty text is a document of one token (the end token); repeated rows are
packed each; an empty table gives an empty result; columns beside the named two are ignored.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigtrace.llm.common import BoundedCache, released, text_groups, worker_state, written

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The characters that stand for the UTF-8 bytes of letters below U+0130, as byte-level tokenizers write them.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)}.difference(_SHOWN)))}
_LETTERS = {i: "".join(_BYTES[b] for b in chr(i).encode()) for i in range(0x130) if chr(i).isalpha()}
#: Marks that are no part of a word's pre-token, nor of an added token's name.
_MARKS = "".join(c for c in string.punctuation if c not in "'<|>")


def _western(text: str) -> bool:
    """Whether all code points are below U+0130."""
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return max(text) < "\u0130"


def _plain(chunks: set[str]) -> set[str]:
    """Those of Latin letters only (code points below U+0130)."""
    letters = set(filter(str.isalpha, chunks))
    return letters if _western("".join(letters)) else set(filter(_western, letters))


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, chunk by chunk through a bounded cache."""

    def __init__(self, path: str, cache_size: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges alone, for words that need no normalising and no splitting
        self.model = Tokenizer(self.tokenizer.model)
        self.cache = BoundedCache(limit=cache_size)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.ends[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks between spaces and line feeds.

        The tokenizer lower-cases; where its rule can't differ from Python's (code points below
        U+0130, no added token in the text) that is done first, so more chunks are alike.
        """
        if "<|" not in text and _western(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def _learn_words(self, words: list[str]) -> None:
        """Words of Latin letters only: each is one pre-token, so many are encoded at once."""
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            split = "\n".join(some).lower().translate(_LETTERS).split("\n")
            ids = np.array(self.model.encode_batch_fast([split], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            edges = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(edges) != len(some) + 1:
                raise ValueError("a word of letters is not one pre-token")
            ids = ids.tobytes()
            self.cache.learn(some, [ids[4 * a : 4 * b] for a, b in zip(edges, edges[1:])])

    def _learn(self, chunks: set[str]) -> None:
        words = _plain(chunks)
        others = list(chunks.difference(words))
        cores = [c.strip(_MARKS) for c in others]
        letters = _plain(set(cores))
        words |= letters
        self._learn_words([w for w in words if w not in self.cache])
        # a word with marks around it
        marked = [(c, *c.split(w, 1), w) for c, w in zip(others, cores) if w in letters]
        rest = {c for c, w in zip(others, cores) if w not in letters} | {m[1] for m in marked} | {m[2] for m in marked}
        rest = [c for c in rest if c not in self.cache]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.cache.learn(some, [np.array(c.ids, "<u4").tobytes() for c in coded])
        ids = self.cache
        self.cache.update({c: ids[before] + ids[w] + ids[after] for c, before, after, w in marked})

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        needed = set().union(*split)
        self._learn(self.cache.missing(needed, 2))  # a chunk and its word; marks are few
        return [b"".join(map(self.cache.__getitem__, chunks)) for chunks in split]


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, cache_size: int = 400_000) -> DataFrame:
    """One row per piece, with ``task`` and ``task_rank`` (its number among the task's pieces of that length)."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    state = ("packing", path, cache_size)

    def cut(batches: Iterator[pa.RecordBatch]):
        encoder = worker_state(state, lambda: WordEncoder(path, cache_size))
        try:
            yield from cut_with(encoder, batches)
        finally:
            encoder.cache = BoundedCache(limit=cache_size)  # an idle worker keeps the tokenizer, not the words

    def cut_with(encoder: WordEncoder, batches: Iterator[pa.RecordBatch]):
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for part, texts in text_groups(batches):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    held = ids[at : at + 4 * capacity]
                    n = len(held) // 4
                    row.append(i), piece.append(k), start.append(at // 4), length.append(n)
                    crc.append(zlib.crc32(held)), rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                ["d", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
            )

    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["d"].dataType.simpleString()
    return rows.mapInArrow(released(cut, state), f"d {kind}, piece int, start long, length long, ids_crc32 long, task int, task_rank long").withColumnRenamed("d", "doc_id")


class Rounds:
    """The bulk-synchronous rounds over runs of documents and gaps."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
        self.sequences = 0
        self.moves: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.rounds = 0

    def place(self, length: int, sequence: int, count: int, gap: int, gaps: dict) -> None:
        self.moves.append((length, self.rank[length], count, sequence, self.capacity - gap))
        self.rank[length] += count
        self.left[length] -= count
        if gap > length:
            gaps.setdefault(gap - length, []).append((sequence, count))

    def open(self, length: int, count: int) -> None:
        self.place(length, self.sequences, count, self.capacity, self.gaps)
        self.sequences += count

    def sweep(self) -> bool:
        """One round; whether any document was placed."""
        sizes, fresh, placed = sorted(self.gaps), {}, False
        for length in sorted((n for n, k in self.left.items() if k), reverse=True):
            at = bisect_left(sizes, length)
            while self.left[length] and at < len(sizes):
                gap = sizes[at]
                first, count = self.gaps[gap].pop()
                taken = min(count, self.left[length])
                self.place(length, first, taken, gap, fresh)
                placed = True
                if taken < count:
                    self.gaps[gap].append((first + taken, count - taken))
                elif not self.gaps[gap]:
                    del self.gaps[gap], sizes[at]
        for gap, runs in fresh.items():
            self.gaps.setdefault(gap, []).extend(runs)
        self.rounds += 1
        return placed

    def run(self) -> "Rounds":
        for length in sorted(self.left, reverse=True):
            if 2 * length > self.capacity:  # no two of them share a sequence
                self.open(length, self.left[length])
        while any(self.left.values()):
            if not self.sweep():
                need = -(-sum(n * k for n, k in self.left.items()) // self.capacity)
                for length in sorted((n for n, k in self.left.items() if k), reverse=True):
                    if taken := min(need, self.left[length]):
                        self.open(length, taken)
                        need -= taken
        return self


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, cache_size: int = 400_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces_of(docs, doc_id, text, capacity, end_id, tokenizer, cache_size), "packing-pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    moves = np.array(sorted(Rounds(counts, capacity).run().moves), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(moves)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("task_rank") + F.col("shift")).alias("rank"))

    def look_up(batches: Iterator[pa.RecordBatch]):
        moves = held.value
        base = int(moves[:, 1].max(initial=0)) + 1  # length and rank as one sorted key
        keys = moves[:, 0] * base + moves[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            own = length.astype(np.int64) * base + np.minimum(rank, base - 1)
            at = np.searchsorted(keys, own, side="right") - 1
            sequence = moves[at, 3] + rank - moves[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(moves[at, 4], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(released(look_up), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
