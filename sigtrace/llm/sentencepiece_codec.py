"""SentencePiece encoding and decoding, batched over words.

A text falls into chunks that no piece crosses (``pieces.py``).  The distinct new chunks of
a group of texts are sorted by length and all chunks of one length advance together; pieces
are found by the hashes of substrings in the sorted array of piece hashes.

BPE models (``MergeCodec``): from single characters on, each step merges in every chunk the
two neighbours whose joined piece has the highest score, of equal ones the leftmost, until no
two neighbours form a piece: the library's own order of merges.  Chunks of a length that few
share, or very long ones, take the same merges from a heap.

Unigram models (``Codec``): a Viterbi search; at each end position the last 1..n characters
are probed, and one maximum over the piece length gives score and back-pointer of every chunk.
The segmentation found has the highest total of piece scores; of equal totals the one with the
longest last piece wins, as in the library.  A character without a piece costs
``unknown_penalty`` below the lowest score.  (The scores of a BPE model are merge ranks: the
highest sum of them is not its encoding.)

In both, a character without a piece becomes its UTF-8 byte pieces.

Decoding joins the pieces' bytes and drops the space mark the encoder puts in front, so
``decode(encode(text)) == text`` for every text without a literal U+2581, which the model
itself does not tell from a space.

Cases: null or empty text gives an empty list and decodes to an empty text; null ids decode
to an empty text; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm import pieces
from sigtrace.llm.common import BoundedCache, Slots, released, text_groups, worker_state

#: An odd multiplier of the substring hash, and cells of one Viterbi step held at once.
_P = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1_000_000
#: Characters encoded, and rows decoded, at once.
GROUP, ROWS = 500_000, 200
#: Chunks are merged one by one where fewer share a length, or where they are longer.
_FEW, _LONG = 16, 256
#: Chunks up to this part longer advance together.
_NEAR = 4


class Codec:
    """The model's pieces as sorted hashes with scores and ids."""

    def __init__(self, model: str, unknown_penalty: float = 10.0):
        sp = pieces.load(model)
        pieces.check_vocabulary(sp)
        ids = range(sp.get_piece_size())
        usable = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in usable]
        self.longest = max(map(len, names))
        hashes = np.array([self._hash(n) for n in names], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.scores = np.array([sp.get_score(i) for i in usable])[order]
        self.unknown = self.scores.min() - unknown_penalty
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.mark = sp.piece_to_id(pieces.MARK)
        self.bytes = [sp.id_to_piece(i).replace(pieces.MARK, " ").encode() for i in ids]
        for i in ids:
            if sp.is_control(i) or sp.is_unknown(i):
                self.bytes[i] = b""
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.written = pa.array(self.bytes, pa.large_binary())

    @staticmethod
    def _hash(name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def encode_keys(self, keys: list[str]) -> list[bytes]:
        """Ids (int32, as bytes) of each chunk key."""
        out: list[bytes] = [b""] * len(keys)
        words = [(pieces.MARK + k).replace(" ", pieces.MARK) for k in keys]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, edges):
            size = int(lengths[same[0]]) if len(same) else 0
            step = max(1, _CELLS // max(1, size))
            for at in range(0, len(same), step):
                self._advance(words, same[at : at + step], size, out)
        return out

    def _prefix(self, words: list[str], which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first 0..size characters of each word, and the powers of the multiplier."""
        n = len(which)
        text = "".join(words[i] for i in which)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * _P + codes[:, j]
        return prefix, np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(self.longest, _P))))

    def _advance(self, words: list[str], which: np.ndarray, size: int, out: list[bytes]) -> None:
        n = len(which)
        prefix, power = self._prefix(words, which, size)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((size + 1, n), np.int32)
        piece = np.full((size + 1, n), -1, np.int32)
        for end in range(1, size + 1):
            spans = range(min(self.longest, end), 0, -1)  # longest first: argmax keeps the first of equals
            hashes = np.stack([prefix[end] - prefix[end - s] * power[s] for s in spans])
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            score = np.where(hit, self.scores[at], -np.inf)
            score[-1] = np.where(hit[-1], score[-1], self.unknown)
            score += best[end - min(self.longest, end) : end]
            top = score.argmax(0)
            cols = np.arange(n)
            best[end] = score[top, cols]
            back[end] = len(spans) - top
            piece[end] = np.where(hit[top, cols], self.ids[at[top, cols]], -1)
        for col, i in enumerate(which):
            ids: list[int] = []
            end = size
            while end:
                span, found = int(back[end, col]), int(piece[end, col])
                if found >= 0:
                    ids.append(found)
                else:
                    ids.extend(reversed(self._bytes_of(words[i][end - 1])))
                end -= span
            out[i] = np.array(ids[::-1], np.int32).tobytes()

    def _bytes_of(self, character: str) -> list[int]:
        return [int(self.byte_ids[b]) for b in character.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        return self.decode_rows(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_rows(self, rows: pa.Array) -> list[str]:
        """The texts of rows of ids; the pieces of all rows are put one after the other at once."""
        bytes_ = self.written.take(rows.flatten())  # a null row has no ids
        n = rows.value_lengths().fill_null(0).to_numpy()
        _, offsets, data = bytes_.buffers()
        edges = np.frombuffer(offsets, np.int64, len(bytes_) + 1, 8 * bytes_.offset)[np.concatenate(([0], np.cumsum(n)))].tolist()
        data = memoryview(data or b"")
        texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(edges, edges[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


class MergeCodec(Codec):
    """Codec of a BPE model: merges in the order of the library."""

    def __init__(self, model: str):
        super().__init__(model)
        sp = pieces.load(model)
        if pieces.has_special_pieces(sp):
            raise ValueError("BPE models with user-defined or unused pieces are not supported")
        self.slots = Slots(self.keys)
        self.rank = np.append(self.scores, -np.inf)  # by place; -1 is no piece
        self.power = np.append(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.longest, _P)))), np.uint64(0))
        self.known = {sp.id_to_piece(int(i)): (float(s), int(i)) for i, s in zip(self.ids, self.scores)}

    def encode_keys(self, keys: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(keys)
        words = [(pieces.MARK + k).replace(" ", pieces.MARK) for k in keys]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        ordered, at = lengths[order], 0
        while at < len(order):
            least = int(ordered[at])
            stop = int(np.searchsorted(ordered, least + least // _NEAR, side="right"))
            stop = min(stop, at + max(1, _CELLS // int(ordered[stop - 1])))
            self._advance(words, order[at:stop], int(ordered[stop - 1]), out)
            at = stop
        return out

    def _advance(self, words: list[str], which: np.ndarray, size: int, out: list[bytes]) -> None:
        """Merge the words ``which`` of at most ``size`` characters together."""
        n = len(which)
        if n < _FEW or size > _LONG:
            for i in which:
                out[i] = self._merged(words[i])
            return
        some = [words[i] for i in which.tolist()]
        own = np.fromiter(map(len, some), np.int64, n)
        # filled up with characters that words don't have
        codes = np.frombuffer("".join([w.ljust(size) for w in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * _P + codes[:, j]
        prefix, wide = prefix.ravel(), size + 1

        def find(row, start, stop):
            span = stop - start
            row = row * wide
            return self.slots.find(prefix[row + stop] - prefix[row + start] * self.power[np.minimum(span, self.longest + 1)])

        # a symbol is the place where it starts; ``end`` is where the next one does, 0 once it is merged away
        place = np.arange(size)
        end = np.where(place < own[:, None], place + 1, 0)
        prev = np.tile(place - 1, (n, 1))
        # score of each symbol joined with the next; the last entry of ``rank`` is for what is no piece
        live, score = np.arange(n), np.full((n, size), -np.inf)
        if size > 1:
            pairs = self.slots.find((codes[:, :-1] * _P + codes[:, 1:]).ravel())
            score[:, :-1] = self.rank[pairs].reshape(n, size - 1)
        while len(live):
            top = score.argmax(1)  # the leftmost of equals
            rows = np.flatnonzero(score[np.arange(len(live)), top] > -np.inf)
            if len(rows) < 0.7 * len(live):
                live, score, top, rows = live[rows], score[rows], top[rows], np.arange(len(rows))
            elif len(rows) == 0:
                break
            word, left = live[rows], top[rows]
            right = end[word, left]
            stop = end[word, right]
            end[word, left], end[word, right] = stop, 0
            score[rows, left] = score[rows, right] = -np.inf
            after = np.flatnonzero(stop < own[word])
            prev[word[after], stop[after]] = left[after]
            before = prev[word, left]
            ahead = np.flatnonzero(before >= 0)
            # the joined symbol with the next one, and the one before with it
            row = np.concatenate((word[after], word[ahead]))
            begin = np.concatenate((left[after], before[ahead]))
            close = np.concatenate((end[word[after], stop[after]], stop[ahead]))
            score[np.concatenate((rows[after], rows[ahead])), begin] = self.rank[find(row, begin, close)]
        row, start = np.nonzero(end)
        at = find(row, start, end[row, start])
        hit = at >= 0
        ids = np.where(hit, self.ids[at], -1).astype(np.int32)
        edges = np.searchsorted(row, np.arange(n + 1))
        odd = set(row[~hit].tolist())
        packed, edges = ids.tobytes(), edges.tolist()
        for k, i in enumerate(which.tolist()):
            lo, hi = edges[k], edges[k + 1]
            if k in odd:
                symbols = zip(ids[lo:hi].tolist(), start[lo:hi].tolist())
                out[i] = self._packed((p, words[i][s]) for p, s in symbols)
            else:
                out[i] = packed[4 * lo : 4 * hi]

    def _packed(self, symbols) -> bytes:
        """Ids of (id or -1, first character) as bytes."""
        ids: list[int] = []
        for found, character in symbols:
            ids.extend([found] if found >= 0 else self._bytes_of(character))
        return np.array(ids, np.int32).tobytes()

    def _merged(self, word: str) -> bytes:
        """The same merges for one word, from a heap."""
        size, known = len(word), self.known
        end, prev = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int, stop: int) -> None:
            if stop - left <= self.longest and (piece := known.get(word[left:stop])):
                heapq.heappush(heap, (-piece[0], left, right, stop))

        for left in range(size - 1):
            offer(left, left + 1, left + 2)
        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if end[left] != right or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            if stop < size:
                prev[stop] = left
                offer(left, stop, end[stop])
            if prev[left] >= 0:
                offer(prev[left], left, stop)
        spans = [(s, e) for s, e in enumerate(end) if e]
        return self._packed((known.get(word[s:e], (0, -1))[1], word[s]) for s, e in spans)


def codec_of(model: str) -> Codec:
    return MergeCodec(model) if pieces.is_bpe(pieces.load(model)) else Codec(model)


def _kept(model: str, cache_size: int) -> tuple:
    """Names what a worker keeps: the same for encoding and decoding, which share workers."""
    return ("sentencepiece", model, cache_size)


def _codec(model: str, cache_size: int):
    return worker_state(_kept(model, cache_size), lambda: (codec_of(model), BoundedCache(limit=cache_size)))


def _passed(docs: DataFrame, keep: tuple[str, ...], column: str, kind: str) -> tuple[DataFrame, str]:
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(column).cast(kind).alias("v"))
    return rows, "".join(f"k{i} {rows.schema[i].dataType.simpleString()}, " for i in range(len(keep)))


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, cache_size: int = 300_000) -> DataFrame:
    """``keep`` columns with ``ids`` (array<int>) and ``n_tokens`` of each row's whole text."""
    model = model or pieces.default_model()

    def encoded(batches: Iterator[pa.RecordBatch]):
        codec, cache = _codec(model, cache_size)
        for part, texts in text_groups(batches, len(keep), GROUP):
            split = [pieces.chunk_keys(t) for t in texts]
            needed = set().union(*split)
            new = list(cache.missing(needed))
            cache.learn(new, codec.encode_keys(new))
            ids = [b"".join(map(cache.__getitem__, keys)) for keys in split]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists, pa.array(np.diff(ends), pa.int64())], [*(f"k{i}" for i in range(len(keep))), "ids", "n_tokens"])

    rows, head = _passed(docs, keep, text, "string")
    return rows.mapInArrow(released(encoded, _kept(model, cache_size)), f"{head}ids array<int>, n_tokens long").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def decode(coded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, cache_size: int = 300_000) -> DataFrame:
    """``keep`` columns with the decoded ``text`` of each row's ids."""
    model = model or pieces.default_model()

    def decoded(batches: Iterator[pa.RecordBatch]):
        codec, _ = _codec(model, cache_size)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = codec.decode_rows(batch.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*(f"k{i}" for i in range(len(keep))), "text"])

    rows, head = _passed(coded, keep, ids, "array<int>")
    return rows.mapInArrow(released(decoded, _kept(model, cache_size)), f"{head}text string").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
