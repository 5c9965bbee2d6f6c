"""Joins, models and searches against brute force."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from tests.llm.odd import TEXTS, no_docs, odd_docs


def brute_sets(text, words=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(rows, percent=80):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join_against_brute_force(spark):
    from sigtrace.llm.jaccard_join import near_duplicates

    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 60)}"
    rows = []
    passage = [word() for _ in range(40)]
    for size in (6, 9, 12, 14, 20, 60, 150):
        for _ in range(4):
            base = [word() for _ in range(size)]
            rows.append(base)
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, 2 + size // 50)):
                    copy[rng.randrange(len(copy))] = word()
                rows.append(copy[: len(copy) - rng.randint(0, 1)])
    rows += [passage + [word() for _ in range(rng.randint(1, 30))] for _ in range(25)]
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    want = brute_components(table)
    assert len({c for _, c in want.values()}) < len(table) - 40
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_links_found_in_earlier_rounds_are_not_passed_on_again(spark, monkeypatch):
    from sigtrace.llm import jaccard_join

    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):  # near copies that differ in several places each
        words = list(base)
        for at in rng.sample(range(90), rng.randint(0, 2)):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(40))) for i in range(20)]
    passed, connect = [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges, *a: passed.append(edges.distinct().count()) or connect(edges, *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    nodes, components = len({frozenset(brute_sets(t)) for _, t in rows}), len({c for _, c in got.values()})
    assert passed[-1] == nodes - components  # before: every link that was found


def test_jaccard_join_odd_rows(spark):
    from sigtrace.llm.jaccard_join import Bounds, near_duplicates

    got = near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(TEXTS)
    of = collections.defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.component_id)
    assert of[1] == {1} and of[10] == {1} and of[6] == {5} and of[2] == {2} and of[3] == {3} and of[None] == {None}
    assert of[12] == {11} and of[13] == {13}
    assert near_duplicates(no_docs(spark)).count() == 0
    b = Bounds(80)
    for a in range(1, 60):
        for c in range(a, b.most(a) + 1):
            o = b.overlap(a, c)
            assert 100 * o >= 80 * (a + c - o) and 100 * (o - 1) < 80 * (a + c - o + 1)
            assert b.shared(c) <= min(b.extra(a), b.extra(c)) and b.shared(a) <= min(b.extra(a), b.extra(c))


def brute_kneser_ney(train, grams, order, discounts):
    """Interpolated modified Kneser-Ney by the textbook, with given discounts per order."""
    counts = {order: collections.Counter(g for t in train for g in t)}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    size = len(counts[1]) + 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1.0 / size
        lower = p(g[1:])
        after = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not after:
            return lower
        total, d = sum(after.values()), discounts[k]
        of = lambda n: d[min(n, 3) - 1]
        mass = sum(of(n) for n in after.values())
        n = after.get(g, 0)
        return (max(n - of(n), 0) if n else 0) / total + mass / total * lower

    return {g: p(g) for g in grams}


def test_kneser_ney_against_brute_force(spark, monkeypatch):
    from sigtrace.llm import kneser_ney as K

    order = 3
    rng = random.Random(3)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 30))) for _ in range(30)]
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(words)]
    docs = spark.createDataFrame(rows, "d long, t string, good boolean")
    from sigtrace.llm.common import compressed

    counts = K.gram_counts(compressed(docs).join(docs.select("d", "good"), "d"), order)
    split = lambda t: [(K.PAD * (order - 1) + t + K.END)[i : i + order] for i in range(len(t) + 1)]
    held = {r.gram: (r.n, r.trusted) for r in counts.collect()}
    everything = collections.Counter(g for t in words for g in split(t))
    assert {g: n for g, (n, _) in held.items()} == dict(everything)
    seen = []
    keep = K._discounts
    monkeypatch.setattr(K, "_discounts", lambda c: seen.append(keep(c)) or seen[-1])
    got = {r.gram: r.logp for r in K.probabilities(counts, order).collect()}
    want = brute_kneser_ney([split(t) for _, t, good in rows if good], everything, order, {k: seen[k - 1] for k in (1, 2, 3)})
    assert got.keys() == want.keys()
    assert all(math.exp(got[g]) == pytest.approx(want[g], rel=1e-9) for g in want)


def test_quality_scores_do_not_depend_on_the_frequent_tier(spark):
    from sigtrace.llm.kneser_ney import classify

    trusted = spark.createDataFrame([(1,), (5,), (6,), (6,), (None,), (99,)], "doc_id long")
    many = classify(odd_docs(spark), trusted, order=3)
    none = classify(odd_docs(spark), trusted, order=3, frequent=0)
    key = lambda r: (r.doc_id or -1, r.text_hash)
    a, b = sorted(many.collect(), key=key), sorted(none.collect(), key=key)
    assert len(a) == len(TEXTS) and [r.n_scored for r in a] == [r.n_scored for r in b]
    assert np.allclose([r.perplexity for r in a], [r.perplexity for r in b])
    assert classify(no_docs(spark), trusted).count() == 0
    assert classify(odd_docs(spark), trusted.where("doc_id < 0")).where("NOT kept").count() == 0


def test_quality_separates_held_out_labels(spark):
    from sigtrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = QUERIES["op1_quality_classifier"](spark, sf).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in judged}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n[(0, False)] >= 0.8 * (n[(0, False)] + n.get((0, True), 0))


def test_nearest_examples_are_exact():
    from sigtrace.llm.toxicity import Index

    rng = random.Random(8)
    vectors = []
    for _ in range(400):
        v = {rng.randrange(30): rng.choice([0.5, 1.0]) for _ in range(rng.randint(1, 6))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({f: x / norm for f, x in v.items()})
    ids = list(range(1000, 1400))
    index = Index(ids, np.array([i % 2 for i in ids]), vectors, 30, (1.0, 1.0))
    for q in vectors[:40] + [{0: 1.0}]:
        at, cosine = index.nearest(q, 7)
        brute = sorted((-round(sum(w * v.get(f, 0) for f, w in q.items()), 12), i) for i, v in zip(ids, vectors))
        brute = [(s, i) for s, i in brute if s < 0][:7]
        assert [(-round(float(c), 12), int(index.ids[a])) for a, c in zip(at, cosine)] == brute


def test_toxicity_on_held_out_labels(spark):
    from sigtrace.llm.queries import QUERIES
    from sigtrace.llm.toxicity import score

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.93 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = score(odd_docs(spark), spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(TEXTS)
    assert score(no_docs(spark), labels).count() == 0
    assert {r.score for r in score(odd_docs(spark), labels.where("doc_id < 0")).collect()} == {0.0}


def test_top_k_against_brute_force(spark):
    from sigtrace.llm.topk_search import top_k

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 7)]) for i in range(300)]
    rows += [(300, [0.5] * 6), (301, [0.5] * 6), (301, [0.5] * 6), (302, None), (303, [1.0, None] + [0.0] * 4), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6), (350, [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS norm2", "'v' AS v")
    usable = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for chunk, seeds in ((16_384, 2_048), (3, 10)):
        got = top_k(table, lambda i: i % 50 == 0, chunk=chunk, seeds=seeds, head=2).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(table.where("vec_id < 0"), lambda i: i % 50 == 0).count() == 0


HEAD = "<html><head><title>x</title></head><body>"


def test_main_text_of_pages(spark):
    from sigtrace.llm.style_tree import extract

    article = "<article class=post><h1>Head &amp; tail</h1><p>One <b>bold</b>word&nbsp;here<p>Two<br>lines<script>var a='</p>';</script></p></article>"
    pages = [
        (1, "http://a.org/1", f"{HEAD}<nav><ul><li>Home</ul></nav>{article}<footer>F</footer></body></html>"),
        (2, "http://a.org/2", None), (3, None, ""), (4, "http://a.org/3", "plain < text &lt;b&gt;"),
        (5, "http://a.org/5", f"{HEAD}<div class='site-menu'>Menu</div><div id=cookie-bar>Accept</div><div><p>Body text.</p></div><!-- c --><div class=comments>Hi</div>"),
        (1, "http://a.org/1", f"{HEAD}<nav><ul><li>Home</ul></nav>{article}<footer>F</footer></body></html>"),
    ]
    # a banner named like nothing, alike on every page of its host
    pages += [(100 + i, f"http://b.org/{i}", f"{HEAD}<div class=zz>Buy one get one</div><div class=qq><p>Story {i} has its own words {i * 7}.</p></div>") for i in range(8)]
    # copies of an article on one host
    pages += [(200 + i, f"http://c.org/{i}", f"{HEAD}<article><p>Same text.</p></article>") for i in range(8)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS low", "'y' AS host")
    got = collections.defaultdict(set)
    for r in extract(table).collect():
        got[r.page_id].add(r.text)
    assert got[1] == {"Head & tail One boldword here Two lines"}
    assert got[2] == got[3] == {""} and got[4] == {"plain < text <b>"} and got[5] == {"Body text."}
    assert all(got[100 + i] == {f"Story {i} has its own words {i * 7}."} for i in range(8))
    assert all(got[200 + i] == {"Same text."} for i in range(8))
    assert extract(table.where("page_id < 0")).count() == 0


def test_join_where_rows_share_an_id_but_not_the_text(spark):
    import corpus_pipeline
    from sigtrace.llm.jaccard_join import near_duplicates

    rng = random.Random(8)
    rows, pairs = [], 12
    for k in range(pairs):
        one, two = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(2))
        # one id for both texts, and a near copy of each
        rows += [(k, one), (k, two), (100 + k, one + " end"), (200 + k, two + " end")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, grouped=True).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id % 100 for r in got)
    assert len({r.group for r in got}) == 2 * pairs
    kept = corpus_pipeline.jaccard_join(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(x for x in rows if x[0] < 100)


def test_main_text_is_decided_by_the_tree(spark):
    from sigtrace.llm.style_tree import extract

    low = "<ul class=m1><li>Start<li>Shop</ul><section class=x>Same note.</section><table><tr><td>Same cell</table><p class=n>Same line.</p>"
    hosts = {
        "a.org": f"{HEAD}{low}<div class=qq><h2>Story</h2><p>Text {{i}} of its own.</p></div>",
        "b.org": f"{HEAD}<article><h1>News {{i}}</h1>{low}<p>Text {{i}} of its own.</p><ul><li>Always<li>Now {{i}}</ul></article>",
        "c.org": f"{HEAD}<form id=f><div class='page widget'>{low}<article><p>Text {{i}} of its own.</p></article></div></form>",
        "d.org": f"{HEAD}<div class=banner-page>Name<div class=qq>Text {{i}} of its own.</div></div><div class=ad>Ad {{i}}</div>",
        "e.org": f"{HEAD}<p>Day {{i}}</p><article><p>The same article on every page.</p></article>",
        "f.org": f"{HEAD}<article class=promo>Buy.</article><div class=qq>Text {{i}} of its own.</div>",
    }
    want = {
        "a.org": "Story Text {i} of its own.", "b.org": "News {i} Text {i} of its own. Always Now {i}", "c.org": "Text {i} of its own.",
        "d.org": "Text {i} of its own.", "e.org": "Day {i} The same article on every page.", "f.org": "Text {i} of its own.",
    }
    pages = [(i, f"http://{host}/{i}", html.format(i=i)) for host, html in hosts.items() for i in range(8)]
    for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert r.text == want[r.url.split("/")[2]].format(i=r.page_id), r.url


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name))
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), sf)
        assert out.columns == columns, name
        rows = out.collect()
        kept = {r.doc_id for r in rows}
        assert kept and kept <= ids and len(rows) == len(kept), name
        docs, ids = spark.createDataFrame(rows, out.schema), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == ids
    from sigtrace.llm.pii import base_spans

    assert not any(base_spans(r.text) for r in docs.collect())


def test_pipeline_of_odd_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            columns, out = docs.columns, stage(spark, docs, sf)
            assert name == "best_fit_packing" or out.columns == columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
