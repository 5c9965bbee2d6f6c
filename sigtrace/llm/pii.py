"""Personal data: fixed base patterns, and a character BiLSTM-CRF that adds spans they miss.

**Base.**  The patterns are searched so that a text costs time in proportion to its length: an
email from each ``@`` outward, an address only from the start of a run of digits.

**Training.**  The tagger is trained in numpy from labelled spans in at most ``train_windows``
windows of the corpus, for each kind those of smallest hash, and as many without a span (a bounded
sample of labelled windows; everything else covers all texts).  Labelled are the base spans and digit
chains of a card's length whose checksum is wrong; for each kind half of the windows have the span
written in another way (``(at)`` for ``@``, other separators, no ``+``, brackets around dots).

**Search.**  Each text is cut into overlapping windows.  A window without a digit, an ``@`` or an
``(at)`` holds no span of the four kinds and is not decoded (decoding all takes 0.8 ms a window,
thirty times the check tool's CPU budget).  Where windows overlap, the tag of each character comes
from the window that has more context around it; spans are read from these joined tags over the whole
text, so one that is longer than a window is found like any other.  Overlapping proposals cannot
arise.  Added spans must satisfy their kind's check (parts, digits) and touch no base span.

Cases: a null text counts as empty and has no spans; repeated rows each get a row; very long
texts and runs take time in proportion to their length; an empty table gives an empty result.
Columns other than the named ones go along only when in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sigtrace.llm.bilstm_crf import PAD, Tagger, characters
from sigtrace.llm.common import released, text_groups

#: The kinds in order and their base patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: The same matches in linear time: no other start than that of a run of digits can match; an email's domain from its ``@``.
_ADDRESS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_MARK = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")
_DIGIT = re.compile("[0-9]")
#: Digit chains of a card's length, whatever their checksum, and the forms that added emails and addresses may take.
_CARD_LIKE = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[] ?at ?[)\]])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[] ?(?:dot|\.) ?[)\]])\s?[A-Za-z0-9-]+)+")
_ADDRESS_LIKE = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?[.,-] ?)[0-9]{1,3}){3}")

WINDOW, STRIDE = 96, 48
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = "".join(_DIGIT.findall(text))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern that do not overlap, from each ``@`` outward."""
    free = 0  # where the next match may begin
    before = 0  # after the last @
    at = text.find("@")
    while at >= 0:
        low = max(free, before)
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        before = at + 1
        at = text.find("@", before)


def base_spans(text: str) -> list[Span]:
    found = [(0, a, b) for a, b in _emails(text)]
    digits = _DIGIT.search(text)
    for kind, pattern in ((1, _ADDRESS), (2, PATTERNS[2]), (3, PATTERNS[3])):
        if digits and (kind != 3 or "+" in text):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


def labelled_spans(text: str, base: list[Span]) -> list[Span]:
    """What the tagger learns: the base spans, and digit chains of a card's length with a wrong checksum."""
    more = [(2, m.start(), m.end()) for m in _CARD_LIKE.finditer(text) if 13 <= len(_DIGIT.findall(m[0])) <= 19]
    return base + [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]


def respelled(kind: int, span: str, rng: np.random.Generator) -> str:
    """A span of this kind written in a way that the base patterns do not know."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    digits = "".join(_DIGIT.findall(span))
    if kind == 0:
        return span.replace("@", pick(" (at) ", "(at)", " [at] ", "[at]"), 1)
    if kind == 1:
        return span.replace(".", pick("[.]", " . ", "(.)"))
    if kind == 2:
        return pick(".", "/", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, rest = digits[-10:-7], digits[-7:]
    near = digits[-9:]
    return pick(f"({area or '030'}) {rest[:3]}-{rest[3:]}", f"{near[:3]}-{near[3:6]}-{near[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}", f"{near[:3]}.{near[3:6]}.{near[6:]}", f"0{near[:3]}/{near[3:]}", f"{near[:3]} {near[3:6]} {near[6:]}")


def window_starts(text: str) -> list[int]:
    """Starts of the windows (every ``STRIDE`` characters) that hold a digit or an ``@``."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) * STRIDE
    starts: set[int] = set()
    for m in _MARK.finditer(text):
        k = m.start() // STRIDE * STRIDE
        starts.update(s for s in (k, k - STRIDE) if 0 <= s <= last and s <= m.start() < s + WINDOW)
    return sorted(starts)


def window_tags(spans: list[Span], start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[1] - s[2]):  # longer spans first, shorter ones do not overwrite
        lo, hi = max(a - start, 0), min(b - start, WINDOW)
        if lo < hi and not tags[lo:hi].any():
            tags[lo:hi] = 2 + 2 * kind
            if a >= start:
                tags[lo] = 1 + 2 * kind
    return tags


def _padded(chars: np.ndarray) -> np.ndarray:
    return np.pad(chars, (0, WINDOW - len(chars)), constant_values=PAD)


def train(docs: DataFrame, text: str = "text", train_windows: int = 2_000, steps: int = 700) -> Tagger | None:
    """A tagger from labelled spans in a bounded sample of windows; None where no text has a window."""
    share = -(-train_windows // (len(KINDS) + 1))  # of each kind, and of windows without a span

    def sampled(batches: Iterator[pa.RecordBatch]):
        rows: list[dict[int, tuple[str, bytes]]] = [{} for _ in range(len(KINDS) + 1)]

        def kept():
            for k, held in enumerate(rows):
                rows[k] = {o: held[o] for o in sorted(held)[:share]}

        for _, texts in text_groups(batches, 0):
            for t in texts:
                starts = window_starts(t) if _MARK.search(t) else ()
                spans = labelled_spans(t, base_spans(t)) if starts else []
                for s in starts:
                    piece = t[s : s + WINDOW]
                    own = [x for x in spans if x[1] < s + WINDOW and s < x[2]]
                    tags = window_tags(own, s).astype(np.uint8).tobytes()
                    order = int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "replace") + tags, digest_size=7).digest(), "big")
                    for k in {x[0] for x in own} or {len(KINDS)}:
                        rows[k][order] = (piece, tags)
            kept()
        flat = [(k, o, *rows[k][o]) for k in range(len(rows)) for o in rows[k]]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], ["k", "o", "piece", "tags"])

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(released(sampled), "k int, o long, piece string, tags binary")
    # one window per hash: copies of a text teach nothing new
    alike = found.groupBy("k", "o").agg(F.min("piece").alias("piece"), F.min("tags").alias("tags"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("o"))
    rows = alike.withColumn("place", place).where(F.col("place") <= share).orderBy("k", "o").collect()
    if not rows:
        return None
    chars, tags = [], []
    rng = np.random.default_rng(17)
    for r in rows:
        piece, own = r["piece"], np.frombuffer(r["tags"], np.uint8).astype(np.int64)
        if r["k"] < len(KINDS) and r["place"] % 2 == 0:
            piece, own = _rewritten(piece, own, r["k"], rng)
        chars.append(_padded(characters(piece)))
        tags.append(own)
    tagger = Tagger(len(KINDS))
    tagger.fit(np.stack(chars), np.stack(tags), steps)
    return tagger


def _rewritten(piece: str, tags: np.ndarray, kind: int, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window with its whole spans of the kind respelled, and the tags that go with it."""
    out, own, at = "", [], 0
    while at < len(piece):
        tag, end = int(tags[at]), at + 1
        if tag:
            while end < len(piece) and tags[end] == 2 * ((tag - 1) // 2) + 2:
                end += 1
        held = piece[at:end]
        if tag == 1 + 2 * kind and end < len(piece):
            held = respelled(kind, held, rng)
        out += held
        own += ([tag] + [2 * ((tag - 1) // 2) + 2] * (len(held) - 1)) if tag else [0] * len(held)
        at = end
    return out[:WINDOW], np.array((own + [0] * WINDOW)[:WINDOW], np.int64)


def _reconciled(starts: list[int], paths: np.ndarray, sure: np.ndarray, size: int) -> list[tuple[int, int, int, float]]:
    """Spans over the whole text: (kind, start, end, confidence).

    Each character's tag comes from the window in which it has most context on its shorter side; what
    the windows say is joined over all of them, so a span may reach over several.
    """
    out: list[tuple[int, int, int, float]] = []
    kind, begin, last, held = -1, 0, -2, []

    def ended():
        if kind >= 0:
            out.append((kind, begin, last + 1, float(np.mean(held))))

    for w, start in enumerate(starts):
        # the middle between this window and its neighbours is where they hand over
        low = (starts[w - 1] + WINDOW + start) // 2 if w and starts[w - 1] + WINDOW > start else start
        high = (start + WINDOW + starts[w + 1]) // 2 if w + 1 < len(starts) and starts[w + 1] < start + WINDOW else min(start + WINDOW, size)
        path, p = paths[w], sure[w]
        for at in np.flatnonzero(path[low - start : high - start]).tolist():
            at += low
            tag = int(path[at - start])
            if kind == (tag - 1) // 2 and tag % 2 == 0 and at == last + 1:
                held.append(float(p[at - start]))
            else:
                ended()
                kind, begin, held = (tag - 1) // 2, at, [float(p[at - start])]
            last = at
    ended()
    return out


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]], least: float) -> list[list[Span]]:
    """For each text the tagger's spans beside the base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    jobs = [(i, s) for i, t in enumerate(texts) if _MARK.search(t) for s in window_starts(t)]
    paths, sure = [], []
    for at in range(0, len(jobs), 512):
        some = jobs[at : at + 512]
        chars = np.stack([_padded(characters(texts[i][s : s + WINDOW])) for i, s in some])
        a, b = tagger.decode(chars)
        paths.append(a), sure.append(b)
    if not jobs:
        return out
    paths, sure = np.concatenate(paths), np.concatenate(sure)
    owner = np.array([i for i, _ in jobs])
    for i in np.unique(owner):
        own = np.flatnonzero(owner == i)
        text = texts[i]
        for kind, a, b, confidence in _reconciled([jobs[j][1] for j in own], paths[own], sure[own], len(text)):
            if confidence >= least and plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base[i]):
                out[i].append((kind, a, b))
    return out


def plausible(kind: int, held: str) -> bool:
    """The check of an added span: the form of its kind, with whatever separators."""
    if kind == 0:
        return _EMAIL_LIKE.fullmatch(held) is not None
    digits = _DIGIT.findall(held)
    if kind == 1:
        return _ADDRESS_LIKE.fullmatch(held) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", held))
    return held[-1:].isdigit() and (13 <= len(digits) <= 19 if kind == 2 else 9 <= len(digits) <= 15)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one, named after the first."""
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    out, at = [], 0
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False, train_windows: int = 2_000, steps: int = 700, least: float = 0.9) -> DataFrame:
    """``keep`` columns, counts of base spans per kind, ``base_sha256``, all ``spans``, ``n_added`` and ``n_spans``; ``redacted`` text on request."""
    tagger = train(docs, text, train_windows, steps)
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    names = [f"k{i}" for i in range(len(keep))]

    def searched(batches: Iterator[pa.RecordBatch]):
        model = held.value
        for part, texts in text_groups(batches, len(keep)):
            base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
            more = added_spans(model, texts, base, least) if model else [[] for _ in texts]
            spans = [b + m for b, m in zip(base, more)]
            columns = [*part.columns[: len(keep)]]
            columns += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array(map(_joined, spans), pa.string()), pa.array(map(len, more), pa.int64()), pa.array(map(len, spans), pa.int64())]
            if redacted:
                columns.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans", *["redacted"] * redacted])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("t"))
    head = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    schema = head + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long" + ", redacted string" * redacted
    return rows.mapInArrow(released(searched), schema).withColumnsRenamed(dict(zip(names, keep)))
