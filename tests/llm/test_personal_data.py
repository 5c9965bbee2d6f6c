"""Base spans in linear time, the decoder and the tagger against brute force and unseen forms."""

from __future__ import annotations

import hashlib
import itertools
import random
import time

import numpy as np
import pytest


def brute_base(text):
    from sigtrace.llm.pii import PATTERNS, valid

    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if valid(k, m[0])]


def test_base_spans_are_the_patterns_own():
    from sigtrace.llm.pii import base_spans

    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1.@+- ()_%9.0@") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "a" * 500_000 + "@" + "b" * 500_000, "a@" * 500_000, "1." * 500_000, "+1" + " " * 1_000_000, "1 " * 500_000, "ab.c" * 250_000 + "@x"])
def test_long_runs_take_linear_time(text):
    from sigtrace.llm.pii import base_spans

    start = time.perf_counter()
    base_spans(text)
    assert time.perf_counter() - start < 3  # quadratic search takes hours


def test_best_path_and_marginals_by_enumeration():
    from sigtrace.llm.bilstm_crf import Tagger

    tagger = Tagger(1, hidden=4, embedding=3, seed=3)
    rng = np.random.default_rng(5)
    tagger.p["trans"] = rng.standard_normal((3, 3)).astype(np.float32)
    chars = rng.integers(30, 60, (3, 5))
    e, *_ = tagger.emissions(chars)
    trans = tagger.p["trans"] + tagger.barred
    paths, sure = tagger.decode(chars)
    for b in range(3):
        scores = {p: sum(e[t, b, k] for t, k in enumerate(p)) + tagger.first[p[0]] + sum(trans[i, j] for i, j in zip(p, p[1:])) for p in itertools.product(range(3), repeat=5)}
        best = max(scores, key=scores.get)
        assert tuple(paths[b]) == best
        z = sum(np.exp(s) for s in scores.values())
        for t, k in enumerate(best):
            assert sure[b, t] == pytest.approx(sum(np.exp(s) for p, s in scores.items() if p[t] == k) / z, abs=1e-4)


def test_spans_reach_over_windows():
    """Joined tags give a span of any length and place as one span."""
    from sigtrace.llm.pii import STRIDE, WINDOW, _reconciled

    rng = random.Random(4)
    for _ in range(200):
        size = rng.randint(WINDOW, 900)
        tags = np.zeros(size + WINDOW, np.int64)
        want, at = [], rng.randint(0, 30)
        while at < size - 2:
            kind, end = rng.randint(0, 3), min(size, at + rng.randint(1, 250))
            tags[at], tags[at + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
            want.append((kind, at, end))
            at = end + rng.randint(0, 60)
        starts = list(range(0, max(1, size - WINDOW + STRIDE), STRIDE))
        paths = np.stack([tags[s : s + WINDOW] for s in starts])
        assert [s[:3] for s in _reconciled(starts, paths, np.ones(paths.shape), size)] == want


@pytest.fixture(scope="module")
def tagger(spark):
    from sigtrace.llm.pii import train

    return train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize(("kind", "form"), [(0, "ann.lee (at) mail7.example.com"), (1, "10[.]20[.]30[.]40"), (2, "9807915762804490"), (2, "4111/1111/1111/1112"), (3, "555-123-4567"), (3, "(017) 555-7713"), (3, "017.555.7713")])
def test_forms_that_the_base_misses(tagger, kind, form):
    from sigtrace.llm.pii import added_spans, base_spans

    assert not base_spans(form)
    rng, hits = random.Random(7), 0
    for _ in range(30):
        words = [" ".join(rng.choice("the of that erthe queche dell verbe ist zu que los".split()) for _ in range(20)) for _ in range(2)]
        text = f"{words[0]} {form} {words[1]}"
        hits += (kind, len(words[0]) + 1, len(words[0]) + 1 + len(form)) in added_spans(tagger, [text], [[]], 0.9)[0]
    assert hits >= 21


def test_query_counts_and_hash(spark):
    """Counts and hash of every row from the patterns themselves; added spans are beside them."""
    from sigtrace.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    names = ("email", "ip", "card", "phone")
    rows = QUERIES["op2_personal_data"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = sorted(brute_base(docs[r.doc_id]))
        text = [f"{names[k]}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(text) <= set(spans) and len(spans) == r.n_spans == len(base) + r.n_added
        order = [(names.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
    assert sum(r.n_added for r in rows) > 0
