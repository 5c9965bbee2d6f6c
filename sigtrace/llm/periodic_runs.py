"""Runs of periodic words inside a text, found by a dictionary of basic factors.

A run is a stretch of words with smallest period ``q`` that has at least ``min_length`` words and
``repeats`` periods and cannot be extended by a neighbouring word.

* **Names.**  Words of a document get numbers; the factor of ``2k`` words at ``i`` is named by
  the pair of names of the two halves at ``i`` and ``i + k``.  Equal names are equal factors, no
  hashes are involved.  A factor that occurs once in its document needs no longer ones, so the
  dictionary shrinks quickly in texts without repetition.
* **Proposals.**  At length ``k`` two successive occurrences of a factor that lie together within
  ``2k`` words, ``p <= k`` apart, propose the period ``p``; neighbouring positions proposing the
  same period are one progression.
* **Extension.**  A progression over the positions ``a .. b`` is the stretch ``a .. b + p + k``.
  It is maximal: ``p`` is the smallest period of a stretch with a factor no shorter than ``p``
  (a nearer occurrence would give a smaller period by Fine and Wilf), so every position of a run
  that has room for ``p + k`` words proposes ``p`` and no position outside does.
* **Duplicates.**  A run of period ``q`` has at least ``3 q >= q + k`` words for the least power
  of two ``k >= q``; only this ``k`` (or the first length, for small periods) reports it, so it is
  reported once.

All documents of a group of texts are worked on together in numpy; nothing is shuffled.

Cases: null and empty texts, and texts without words, have no runs and an empty collapsed text;
a null id is kept; very long texts are worked on whole (memory grows with the longest text);
repeated rows each get a row; an empty table gives an empty result; own columns replace columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm.common import text_groups

#: Characters worked on at once.
GROUP = 1_000_000


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` (what ``bytes.split`` takes for white space), in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal only for equal words of one document, and each word's document."""
    numbers, base = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
    owner = np.repeat(np.arange(len(documents)), [len(w) for w in documents])
    return (np.concatenate(numbers) if numbers else np.zeros(0, np.int64)), owner


def _renamed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of ``keys``, and which of them occur more than once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names, counts[names] > 1


def find_runs(numbers: np.ndarray, owner: np.ndarray, min_length: int = 24, repeats: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, ordered by start and period; starts count over all documents."""
    if repeats < 3 or min_length < 2:
        raise ValueError("runs need at least three periods and two words")
    first = 1
    while 4 * first <= min_length:
        first *= 2
    found = [np.zeros((0, 3), np.int64)]
    at = np.arange(len(numbers))
    names, repeated = _renamed(numbers)
    at, names = at[repeated], names[repeated]
    k = 1
    while len(at):
        if k >= first:
            found.append(_progressions(at, names, k, k // 2 if k > first else 0))
        # factors of twice the length: both halves occur more than once and lie in one document
        other = np.searchsorted(at, at + k)
        other[other == len(at)] = 0
        whole = (at[other] == at + k) & (owner[at] == owner[at[other]])
        keys = names[whole] * (int(names.max()) + 1) + names[other[whole]]
        at = at[whole]
        names, repeated = _renamed(keys)
        at, names = at[repeated], names[repeated]
        k *= 2
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(min_length, repeats * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _progressions(at: np.ndarray, names: np.ndarray, k: int, beyond: int) -> np.ndarray:
    """(start, length, period) of the stretches that successive occurrences ``beyond < p <= k`` apart propose."""
    order = np.argsort(names, kind="stable")
    here, nexts = order[:-1], order[1:]
    distance = at[nexts] - at[here]
    good = (names[here] == names[nexts]) & (distance <= k) & (distance > beyond)
    where, period = at[here[good]], distance[good]
    order = np.argsort(where)
    where, period = where[order], period[order]
    if not len(where):
        return np.zeros((0, 3), np.int64)
    breaks = np.flatnonzero((np.diff(where) != 1) | (np.diff(period) != 0)) + 1
    begin = np.concatenate(([0], breaks))
    end = np.concatenate((breaks, [len(where)])) - 1
    period = period[begin]
    return np.stack((where[begin], where[end] + period + k - where[begin], period), axis=1)


def _dropped(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words some run contains after its first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 24, repeats: int = 3, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` is an array of (start, length, period) by start and period; ``collapsed`` joins by one
    space the words that remain when every run keeps only its first period.  ``rewrite`` may change
    a document's words (id and words in UTF-8) before.
    """

    def searched(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_groups(batches, 1, GROUP):
            documents = [words_of(t) for t in texts]
            if rewrite is not None:
                documents = [rewrite(d, words) if words else words for d, words in zip(part.column(0).to_pylist(), documents)]
            numbers, owner = numbered(documents)
            start, length, period = find_runs(numbers, owner, min_length, repeats)
            drop = _dropped(len(numbers), start, length, period)
            edges = np.concatenate(([0], np.cumsum([len(w) for w in documents])))
            lists = np.searchsorted(start, edges)
            changed = np.add.reduceat(np.concatenate((drop, [False])).astype(np.int64), edges[:-1]) if len(edges) > 1 else []
            left = []
            for i, words in enumerate(documents):
                if words and changed[i]:
                    words = [w for w, gone in zip(words, drop[edges[i] : edges[i + 1]].tolist()) if not gone]
                left.append(b" ".join(words).decode("utf-8", "replace"))
            fields = [pa.array(x, pa.int64()) for x in (start - edges[:-1].repeat(np.diff(lists)), length, period)]
            runs = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edges), pa.int64()), runs, pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(searched, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
