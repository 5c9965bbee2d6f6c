"""Backoff model, periodic runs and phrases against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import TEXTS, no_docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- Katz backoff ---------------------------------------------------------------------------------


class BruteKatz:
    """Straight from the definitions, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            for k in range(1, order + 1):
                self.counts[k].update(self.grams(t, k))
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.ratio = {k: self.ratios(Counter(self.counts[k].values())) for k in self.counts}
        self.total = {k: Counter() for k in range(2, order + 1)}
        self.followers = {k: defaultdict(list) for k in range(2, order + 1)}
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.total[k][g[:-1]] += c
                self.followers[k][g[:-1]].append(g[-1])
        self.freed = {k: {h: sum(self.counts[k][(*h, w)] - self.discounted(k, (*h, w)) for w in ws) for h, ws in f.items()} for k, f in self.followers.items()}
        self.freed1 = sum(c - self.discounted(1, g) for g, c in self.counts[1].items())

    @staticmethod
    def tokens(text):
        return [*WORD.findall(lowered(text)), "</s>"]

    def grams(self, text, k):
        t = ["<s>"] * (k - 1) + self.tokens(text)
        return [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]

    @staticmethod
    def ratios(n):
        for k in range(5, 0, -1):
            if all(n[r] for r in range(1, k + 2)):
                a = (k + 1) * n[k + 1] / n[1]
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)} if a < 1 else {0: 2}
                if all(0 < x < 1 for x in d.values()):
                    return d
        return {}

    def discounted(self, k, g):
        c = self.counts[k][g]
        return c * self.ratio[k].get(c, 1)

    def p(self, g):
        k = len(g)
        if k == 1:
            total = self.n if self.freed1 > 0 else self.n + 1
            unknown = self.freed1 / self.n if self.freed1 > 0 else 1 / (self.n + 1)
            return self.discounted(1, g) / total if g in self.counts[1] else unknown
        h = g[:-1]
        total = self.total[k][h]
        if not total:
            return self.p(g[1:])
        none = self.freed[k][h] <= 0
        if g in self.counts[k]:
            return self.discounted(k, g) / (total + none)
        mass = 1 / (total + 1) if none else self.freed[k][h] / total
        return mass / (1 - sum(self.p((*g[1:-1], w)) for w in self.followers[k][h])) * self.p(g[1:])

    def row(self, text):
        t = self.tokens(text)
        return len(t), sum((w,) in self.counts[1] for w in t), sum(math.log10((self.counts[1][(w,)] + 1) / (self.n + self.v + 1)) for w in t), sum(math.log10(self.p(g)) for g in self.grams(text, self.order))


def model_texts():
    rng = random.Random(4)
    words = [f"w{int(60 * rng.random() ** 3)}" for _ in range(4000)]
    texts, at = [], 0
    while at < len(words):
        n = rng.choice([0, 1, 3, 20, 60])
        texts.append(" ".join(words[at : at + n]))
        at += max(n, 5)
    train = texts + texts[:4] + [t or "" for _, t, *_ in TEXTS]
    return train, texts[:10] + ["w1 W2 unseen w3 unseen2", "unseen", "", None, "w0 w0 w0 w0 w59", texts[3]]


@pytest.mark.parametrize(("order", "common", "bucket"), [(2, 1 << 20, 2_500_000), (2, 5, 300), (3, 40, 400)])
def test_katz_against_brute_force(spark, monkeypatch, order, common, bucket):
    from sigtrace.llm import katz

    monkeypatch.setattr(katz, "COMMON", common)
    monkeypatch.setattr(katz, "BUCKET", bucket)
    train, asked = model_texts()
    brute = BruteKatz(train, order)
    model = katz.train(spark.createDataFrame([(t,) for t in train], "text string"), order=order)
    assert (model.n, model.v) == (brute.n, brute.v)
    assert (bucket < 1000) == (model.buckets > 3) and (bucket > 1000 or len(model.hot[2]) > 1)
    got = model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).collect()
    assert len(got) == len(asked)
    # texts marked as learned (and once more as unknown) score the same with fewer requests
    both = spark.createDataFrame([(i, t, known) for i, t in enumerate(train[:40]) for known in (True, False, None)], "doc_id long, text string, known boolean")
    marked = model.score(both, learned=F.col("known")).collect()
    assert len(marked) == 120
    for r in marked:
        assert r.score == pytest.approx(brute.row(train[r.doc_id])[3], abs=1e-7)
    for r in got:
        n, known, base, score = brute.row(asked[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=1e-7), asked[r.doc_id]


def test_katz_histories_sum_to_one():
    """The definitions that the model is compared with are normalised, in every order and for any history."""
    train, _ = model_texts()
    brute = BruteKatz(train[:200], 3)
    words = [w for (w,) in brute.counts[1]] + ["never seen"]
    for h in [(), ("w0",), ("w1", "w0"), ("<s>", "<s>"), ("<s>", "w3"), ("odd", "w1"), ("odd", "odd")]:
        assert sum(brute.p((*h, w)) for w in words) == pytest.approx(1, abs=1e-9)


def test_katz_odd_rows(spark):
    from sigtrace.llm import katz

    model = katz.train(odd_docs(spark))
    got = model.score(odd_docs(spark), keep=("doc_id", "x")).collect()
    assert len(got) == len(TEXTS) and all(r.x == "extra" and r.score <= 0 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 10)}) == 1
    empty = katz.train(no_docs(spark))
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in empty.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()] == [(3, 0, 0.0, 0.0)]
    assert model.score(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        katz.train(no_docs(spark), order=1)


def test_katz_query(spark, tmp_path):
    from sigtrace.llm.queries import QUERIES

    train, asked = model_texts()
    rows = list(enumerate(asked + train[:80]))
    spark.createDataFrame([(i, t) for i, t in rows] + [(None, "w1 w2")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    brute = BruteKatz([t for i, t in rows if i not in held] + ["w1 w2"], 2)
    got = {r.doc_id: r for r in QUERIES["op11_katz_backoff"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 1 and not got[None].held_out
    for i, t in rows:
        n, known, base, score = brute.row(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, n, known, brute.n)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=1e-7)


# -- periodic runs --------------------------------------------------------------------------------


def brute_runs(words, least=24, repeats=3):
    def smallest(a, b):
        return next((q for q in range(1, b - a) if all(words[i] == words[i + q] for i in range(a, b - q))), b - a)

    out = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, repeats * q) and smallest(a, i + q) == q:
                out.append((a, i - a + q, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng, count):
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            base = [rng.choice("abc") for _ in range(rng.randint(1, rng.choice([2, 5, 20])))]
            words += base * rng.randint(1, 12) + [rng.choice("abcdef") for _ in range(rng.randint(0, 4))]
        yield words


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (2, 3), (9, 4)])
def test_runs_against_brute_force(least, repeats):
    from sigtrace.llm.periodic_runs import find_runs, numbered

    rng, some = random.Random(least), 0
    for _ in range(60):
        documents = list(periodic_texts(rng, 4))
        numbers, owner = numbered([[w.encode() for w in d] for d in documents])
        got = list(zip(*(x.tolist() for x in find_runs(numbers, owner, least, repeats))))
        want, at = [], 0
        for d in documents:
            want += [(a + at, n, q) for a, n, q in brute_runs(d, least, repeats)]
            at += len(d)
        assert got == want
        some += len(want)
    assert some > 100
    with pytest.raises(ValueError):
        find_runs(numbers, owner, 24, 2)


def test_runs_in_a_long_text_are_found_quickly():
    from sigtrace.llm.periodic_runs import find_runs, numbered

    words = [b"x"] * 200_000 + [f"{i % 70_001}".encode() for i in range(230_000)]
    numbers, owner = numbered([words])
    assert list(zip(*(x.tolist() for x in find_runs(numbers, owner)))) == [(0, 200_000, 1), (200_000, 230_000, 70_001)]


def test_runs_query(spark, tmp_path):
    from sigtrace.llm.queries import QUERIES

    rng = random.Random(8)
    rows = [(i, "  ".join(w)) for i, w in enumerate(periodic_texts(rng, 60))] + [(i, t) for i, t, *_ in TEXTS if i is not None and t != TEXTS[6][1]]
    rows = list({i + 1000 * (j >= 60): t for j, (i, t) in enumerate(rows)}.items()) + [(5000, " ".join(str(rng.randint(0, 9)) for _ in range(400)))]
    spark.createDataFrame(rows + [(None, "a " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 1 and (got[None].n_runs, got[None].start, got[None].length, got[None].period) == (1, 0, 30, 1)
    changed = 0
    for i, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            changed += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        gone = {j for a, m, q in runs for j in range(a + q, a + m)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best), (i, words)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()
    assert changed > 2


def test_runs_odd_rows(spark):
    from sigtrace.llm.periodic_runs import periodic_runs

    got = periodic_runs(odd_docs(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == 0 and by[2].runs == [] and by[2].collapsed == "" and by[3].collapsed == "" and by[4].collapsed == ""
    assert [tuple(r) for r in by[9].runs] == [tuple(r) for r in brute_runs(TEXTS[10][1].split())]
    assert periodic_runs(no_docs(spark)).count() == 0


# -- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, support, longest=5, absorb=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= support and len(p) > 1}
        scored = []
        for p, a in often.items():
            if any(100 * b >= absorb * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, cut = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(6)
    fixed = ["new york city", "of the", "a b a b a", "once upon a time there"]
    rows = []
    for i in range(400):
        words = [rng.choice(fixed) if rng.random() < 0.2 else f"{rng.choice('xyz')}{int(30 * rng.random() ** 2)}" for _ in range(rng.randint(0, 40))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " New "]) for w in words), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(t, lang) for _, t, lang, *_ in TEXTS]


@pytest.mark.parametrize(("support", "absorb", "top"), [(7, 100, 2000), (20, 80, 5), (40, 100, None)])
def test_phrases_against_brute_force(spark, monkeypatch, support, absorb, top):
    from sigtrace.llm import phrases

    monkeypatch.setattr(phrases, "SMALL_SHARD", 300)
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(13), support=support, absorb=absorb, top=top).collect()
    want = brute_phrases(rows, support, absorb=absorb, top=top)
    assert sorted(tuple(r) for r in got) == want and len(want) > 5


def test_phrases_odd_rows(spark):
    from sigtrace.llm.phrases import collocations

    got = collocations(odd_docs(spark), support=4).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases([(t, lang) for _, t, lang, *_ in TEXTS], 4)
    assert collocations(no_docs(spark)).count() == 0


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    score = "(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    a, n, l, r = 10**12 + 7, 10**14 + 3, 10**13 + 1, 10**12 + 9
    assert spark.sql(f"SELECT {score} AS s FROM VALUES ({a}L, {n}L, {l}L, {r}L) AS t(a, n, l, r)").first().s == 1000 * a * n // (l * r)
