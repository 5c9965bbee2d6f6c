"""Near-duplicate classes: a size-aware heavy-light Jaccard join on word shingles.

Two texts link when ``100 * intersection >= percent * union`` of their shingle sets; the
result is the connected component of every document.

* Equal sets are one node (a 64-bit hash of the set), so exact copies are never paired.
* **Boundary.** Sizes a <= b can link only with an overlap of ``o(a, b)``.  From the counts
  of small sizes the boundary is the size that makes enumerated subsets plus postings cheapest.
* **Light side** (smaller set within the boundary): both sets enumerate their subsets of
  size ``o(a, b)``.  Sharing one *is* a link, so no check follows.
* **Heavy side**: inverted lists.  A set posts its extended prefix (the smallest hashes; any
  linked pair shares several of these), and sets that share too few of them with any other are
  out - most of the corpus.  The rest post a longer prefix, about half of their shingles (all of a
  small set); a set of which others hold less than linked pairs share there is out, too.  Of the shared
  ones each set keeps its rarest, enough that linked pairs still meet in one.  The lists are scanned in rounds: every list that is
  open (its members are in different components) tests them against one centre, then against
  about ``WIDER``, ``WIDER`` squared, ... centres, until no list is open or all its members have been
  centres; members already in one component need no test.  So a group of m near copies costs
  about m tests, and no link between different components is missed.

Tests run on the whole texts.  Shingles and set ids are 64-bit hashes.

A set's text is found again by id and text hash, since rows can share an id but not the text.

Cases: null or empty texts, and texts without words, have an empty set and are alone; a row
with a null id takes no part in components (its ``component_id`` is null); repeated rows each
get a row, in one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm.common import compressed, in_bitmap, key_bitmap, released, text_groups, unpacked_groups, written
from sigtrace.llm.kneser_ney import text_hash
from sigtrace.llm.shingles import set_id, shingle_sets
from sigtrace.plans.components import connected_components

#: Sizes the boundary is chosen from, and what testing costs per shingle beside posting one.
MAX_LIGHT = 16
TEST_COST = 2.0
#: The extended prefix holds ``size / EXTRA`` shingles more than a plain one, and at least so many.
EXTRA, EXTRA_LEAST = 16, 32
#: Of the least overlap beyond ``EXTRA_LEAST`` so many 8ths are not posted by candidates.
OUTSIDE = 5
#: Centres of a list grow by this factor from round to round.
WIDER = 32


class Bounds:
    """Overlaps and prefix lengths for one threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a: int, b: int) -> int:
        """Least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, size: int) -> int:
        """Least overlap, which is also the least partner, of a set of this size."""
        return -(-self.percent * size // 100)

    def most(self, size: int) -> int:
        return 100 * size // self.percent

    def extra(self, size: int) -> int:
        return min(self.least(size), max(EXTRA_LEAST, -(-size // EXTRA)))

    def prefix(self, size: int) -> int:
        return min(size, size - self.least(size) + self.extra(size))

    def shared(self, size: int) -> int:
        """Shingles of its extended prefix that a set shares with the prefix of any partner."""
        return self.extra(self.least(size))

    def outside(self, size: int) -> int:
        """How many of its largest hashes a candidate does not post; grows with the size, but less than the least overlap."""
        return max(0, self.least(size) - EXTRA_LEAST) * OUTSIDE // 8

    def classes(self, size: int, boundary: int) -> list[tuple[int, int]]:
        """Size classes (a, b), a <= b, with a within the boundary, that a set of this size belongs to."""
        pairs = [(p, size) for p in range(self.least(size), size)] + [(size, p) for p in range(size, self.most(size) + 1)]
        return [(a, b) for a, b in pairs if 0 < a <= boundary]

    def subsets(self, size: int, boundary: int) -> int:
        return sum(comb(size, self.overlap(a, b)) for a, b in self.classes(size, boundary))

    def boundary(self, counts: dict[int, int]) -> int:
        """The boundary of least cost for so many sets of each small size."""
        sizes = range(1, self.most(MAX_LIGHT) + 1)

        def cost(edge: int) -> float:
            light = sum(counts.get(s, 0) * self.subsets(s, edge) for s in sizes)
            heavy = sum(counts.get(s, 0) * (self.prefix(s) + TEST_COST * s) for s in sizes if s > edge)
            return light + heavy

        return min(range(1, MAX_LIGHT + 1), key=cost)


def _sets(batches: Iterator[pa.RecordBatch], words: int, column: int = 1):
    for part, texts in text_groups(batches, column):
        yield part, shingle_sets(texts, words)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(d, n, node, x): id, set size, set id and text hash of each row (d, t, x); no node for an empty set."""

    def profiled(batches):
        for part, sets in _sets(batches, words):
            node = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield _rows(["d", "n", "node", "x"], part.column(0), pa.array(map(len, sets), pa.int64()), node, part.column(2))

    return docs.mapInArrow(released(profiled), f"d {docs.schema['d'].dataType.simpleString()}, n long, node long, x long")


def _light_edges(docs: DataFrame, words: int, bounds: Bounds, boundary: int) -> DataFrame:
    """(src, dst) links of classes whose smaller size is within the boundary."""
    largest = bounds.most(boundary)

    def enumerated(batches):
        for _, sets in _sets(batches, words):
            seen, high, low, upper, node = set(), [], [], [], []
            for s in sets:
                if not 0 < len(s) <= largest or (own := set_id(s)) in seen:
                    continue
                seen.add(own)
                for a, b in bounds.classes(len(s), boundary):
                    for subset in combinations(s.tolist(), bounds.overlap(a, b)):
                        key = hashlib.blake2b(np.array([a, b, *subset], np.uint64).tobytes(), digest_size=16).digest()
                        high.append(int.from_bytes(key[:8], "little", signed=True))
                        low.append(int.from_bytes(key[8:], "little", signed=True))
                        upper.append(0 if a == b else 1 + (len(s) == b))
                        node.append(own)
            yield _rows(["high", "low", "side", "node"], pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(upper, pa.int32()), pa.array(node, pa.int64()))

    keys = written(docs.mapInArrow(released(enumerated), "high long, low long, side int, node long"), "jaccard-subsets")
    # a subset links its members when both sizes hold it (or two sets, where the sizes are equal)
    found = keys.groupBy("high", "low").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min("side").alias("s1"), F.max("side").alias("s2"))
    found = found.where("least != most AND (s1 = 0 OR s1 != s2)").select("high", "low", "least")
    return keys.join(found, ["high", "low"]).where("node != least").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct()


def _postings(docs: DataFrame, words: int, bounds: Bounds, boundary: int, common=None) -> DataFrame:
    """(h, node, size): the extended prefix of every set above the boundary, or what of it passes the bitmap ``common``."""

    def posted(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, words):
            if len(seen) > 500_000:
                seen.clear()
            held, node, size = [], [], []
            for s in sets:
                if len(s) > boundary and (own := set_id(s)) not in seen:
                    seen.add(own)  # copies within a task are posted once
                    held.append(s[: bounds.prefix(len(s))])
                    node.append(own), size.append(len(s))
            if held:
                n = [len(x) for x in held]
                h, node, size = np.concatenate(held), np.repeat(np.array(node, np.int64), n), np.repeat(np.array(size, np.int32), n)
                if common is not None:
                    some = in_bitmap(common.value, h >> np.uint64(16))
                    h, node, size = h[some], node[some], size[some]
                yield _rows(["h", "node", "size"], h.view(np.int64), node, size)

    return docs.mapInArrow(released(posted), "h long, node long, size int")


def _candidates(docs: DataFrame, words: int, bounds: Bounds, boundary: int) -> DataFrame:
    """(node): heavy sets that share enough of their extended prefix with others to have a partner."""
    # counts of the leading 48 bits: at least those of the shingle
    group = F.shiftrightunsigned("h", 16).alias("g")
    counts = written(_postings(docs, words, bounds, boundary).select(group).groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"), "jaccard-repeated")
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(counts))
    # most shingles occur once and stay in their task
    common = _postings(docs, words, bounds, boundary, bits).withColumn("g", group).join(counts, "g", "left_semi")
    least = F.ceil(F.col("size") * bounds.percent / 100)
    own = F.ceil(least * bounds.percent / 100)
    shared = F.least(own, F.greatest(F.lit(EXTRA_LEAST), F.ceil(least / EXTRA)))  # Bounds.shared
    return common.groupBy("node").agg(F.first("size").alias("size"), F.count("*").alias("k")).where(F.col("k") >= shared).select("node")


def _lists(texts: DataFrame, words: int, bounds: Bounds) -> DataFrame:
    """(h, node, size, left): inverted lists of the candidates in which every linked pair meets.

    Of a linked pair's common shingles, at least ``least`` of the larger set, at most its ``outside`` are not posted
    by both, as the smaller set leaves out no more.  ``left`` is how many shared shingles the set can have from this
    one on, rarest first: the posted ones, and those it has not posted.
    """

    def posted(batches):
        for part, group in unpacked_groups(batches, 1):
            sets = shingle_sets(group, words)
            held = [s[: len(s) - bounds.outside(len(s))] for s in sets]
            n = np.array([len(x) for x in held], np.int64)
            size = np.array([len(x) for x in sets], np.int32)
            yield _rows(["h", "node", "size"], np.concatenate(held).view(np.int64), np.repeat(part.column(0).to_numpy(), n), np.repeat(size, n))

    posts = texts.select("node", "z").mapInArrow(released(posted), "h long, node long, size int")
    # written, so that what was shuffled to count is gone before the join
    counts = written(posts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-counts", "zstd")
    kept = posts.join(counts, "h").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("held"))
    least = F.ceil(F.col("size") * bounds.percent / 100).cast("int")
    outside = F.floor(F.greatest(F.lit(0), least - EXTRA_LEAST) * OUTSIDE / 8).cast("int")  # Bounds.outside
    shared = least - outside
    short = kept.where(F.size("held") >= shared).select("node", "size", outside.alias("outside"), F.size("held").alias("n_held"), F.slice("held", F.lit(1), F.size("held") - shared + 1).alias("held"))
    listed = short.select("node", "size", F.posexplode("held.h").alias("at", "h"), "n_held", "outside")
    return listed.select("h", "node", "size", (F.col("n_held") - F.col("at") + F.col("outside")).alias("left"))


def _testable(bounds: Bounds, a: str, b: str, left_a: str, left_b: str):
    """Whether sets of these sizes can link if this is the first shingle they share: what is left must suffice."""
    return F.least(left_a, left_b) * (100 + bounds.percent) >= (F.col(a) + F.col(b)) * bounds.percent


def _tested(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(src, dst, linked) for each pair, by the whole sets."""
    import zstandard

    left = pairs.join(texts.select(F.col("node").alias("src"), F.col("z").alias("z1")), "src")
    both = left.join(texts.select(F.col("node").alias("dst"), F.col("z").alias("z2")), "dst").select("src", "dst", "z1", "z2")

    def compared(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets: dict[int, np.ndarray] = {}
                for k in (0, 1):
                    for node, z in zip(part.column(k).to_pylist(), part.column(k + 2)):
                        if node not in sets:
                            sets[node] = shingle_sets([unpack.decompress(z.as_py()).decode("utf-8", "surrogatepass")], words)[0]
                linked = []
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    linked.append(100 * common >= percent * (len(sets[a]) + len(sets[b]) - common))
                yield _rows(["src", "dst", "linked"], part.column(0), part.column(1), pa.array(linked, pa.bool_()))

    return both.mapInArrow(released(compared), "src long, dst long, linked boolean")


def _merged(label: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, component) of ``label`` after joining what ``linked`` (src, dst) links: only components are linked, not their sets."""
    for end in ("src", "dst"):
        linked = linked.join(label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of")), end)
    found = connected_components(linked.where("src_of != dst_of").select(F.col("src_of").alias("src"), F.col("dst_of").alias("dst")))
    found = found.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return written(label.join(found, "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "jaccard-labels")


def _heavy_edges(docs: DataFrame, sizes: DataFrame, words: int, bounds: Bounds, boundary: int) -> DataFrame:
    """(src, dst) links of each connected set above the boundary, but the smallest, with the smallest it is connected with."""
    # one row of each candidate's set stands for it
    candidates = _candidates(docs, words, bounds, boundary)
    stand_in = written(sizes.join(candidates, "node", "left_semi").groupBy("node").agg(F.min(F.struct("d", "x")).alias("d")), "jaccard-candidates")
    wanted = docs.sparkSession.sparkContext.broadcast(key_bitmap(stand_in.select("d.x")))
    packed = compressed(docs.select(F.struct("d", "x").alias("d"), "t", "x"), wanted)
    texts = written(packed.join(stand_in, "d").select("node", "z").dropDuplicates(["node"]), "jaccard-texts")
    lists = written(_lists(texts, words, bounds), "jaccard-lists")
    span = lists.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("h")
    lists = written(lists.join(span, "h"), "jaccard-shared")
    label = written(lists.select("node", F.col("node").alias("component")).distinct(), "jaccard-labels")

    tested, turn, centres = None, 0, 1
    while True:
        held = lists.join(label, "node")
        open_lists = held.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("h", "m")
        held = written(held.join(open_lists, "h"), "jaccard-open")
        longest = held.agg(F.max("m")).first()[0]
        if longest is None:
            break
        centre = F.struct(F.col("node").alias("src"), F.col("size").alias("a"), F.col("left").alias("left_a"), F.col("component").alias("of"))
        if turn == 0:
            chosen = held.groupBy("h").agg(F.min_by(centre, F.xxhash64("node")).alias("x"))
        else:  # about so many of each list, in the end all
            chosen = held.where(F.pmod(F.xxhash64("node", F.lit(turn)), "m") < centres).select("h", centre.alias("x"))
        pairs = held.join(chosen.select("h", "x.*"), "h").where("component != of")
        pairs = pairs.where(_testable(bounds, "a", "size", "left_a", "left")).select(F.least("src", "node").alias("src"), F.greatest("src", "node").alias("dst")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("src", "dst"), ["src", "dst"], "left_anti")
        result = written(_tested(pairs, texts, words, bounds.percent), "jaccard-tested")
        tested = result if tested is None else tested.unionByName(result)
        label = _merged(label, result.where("linked"))
        if turn and longest <= centres:
            break
        turn, centres = turn + 1, centres * WIDER
    wanted.destroy()
    return label.where("node != component").select(F.col("node").alias("src"), F.col("component").alias("dst"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, grouped: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; a component is named after its smallest id.

    ``grouped`` adds ``text_hash`` and ``group``, the component itself (null for an empty set): two components can have
    one smallest id where rows share an id but not the text.
    """
    bounds = Bounds(percent)
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).withColumn("x", text_hash(F.col("t")))
    known = written(profiles(rows, words), "jaccard-profiles")
    sized = known.where("node IS NOT NULL AND d IS NOT NULL")
    counts = sized.where(F.col("n") <= bounds.most(MAX_LIGHT)).groupBy("n").agg(F.countDistinct("node").alias("k")).collect()  # a few sizes
    boundary = bounds.boundary({r["n"]: r["k"] for r in counts})

    present = rows.where("d IS NOT NULL")
    edges = _light_edges(present, words, bounds, boundary).unionByName(_heavy_edges(present, sized.select("d", "node", "x"), words, bounds, boundary))
    nodes = sized.groupBy("node").agg(F.min("d").alias("first"))
    component = connected_components(edges).join(nodes, "node")
    least = component.groupBy("component").agg(F.min("first").alias("least"))
    joined = component.join(least, "component").select("node", "component", "least")
    named = nodes.join(joined, "node", "left").select("node", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "node").alias("group"))
    out = known.join(named, "node", "left")
    more = [F.col("x").alias("text_hash"), "group"] if grouped else []
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.coalesce("component_id", "d")).alias("component_id"), *more)
