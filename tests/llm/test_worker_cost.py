"""What a worker keeps and repeats in the text operators."""

from __future__ import annotations

import numpy as np

from sigtrace.llm import sentencepiece_codec, toxicity


def test_nearest_sorts_only_blocks_that_hold_a_nearer_example(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [{f: float(rng.random()) + 0.1 for f in rng.choice(40, 6, replace=False).tolist()} for _ in range(1500)]
    ids = rng.permutation(1500).tolist()
    index = toxicity.Index(ids, np.array([i % 2 for i in ids]), vectors, 40, (0.5, 0.5))
    by_id = dict(zip(ids, vectors))
    calls, sort = [], np.lexsort
    monkeypatch.setattr(toxicity.np, "lexsort", lambda keys: calls.append(1) or sort(keys))
    for q in range(0, 1500, 300):
        query = vectors[q]
        want = sorted((-round(sum(w * v.get(f, 0.0) for f, w in query.items()), 12), i) for i, v in by_id.items() if set(v) & set(query))[:15]
        at, cosine = index.nearest(query, 15)
        assert index.ids[at].tolist() == [i for _, i in want]
        assert np.allclose(cosine, [-c for c, _ in want])
    assert len(calls) < 5 * len(index.rows)  # before: every block that shares a feature


def test_codec_state_is_shared_and_counted_as_worker_state():
    from sigtrace.llm import common, pieces

    model = pieces.default_model()
    first = sentencepiece_codec._codec(model, 1_000)
    assert sentencepiece_codec._codec(model, 1_000) is first
    assert common._STATE["key"] == sentencepiece_codec._kept(model, 1_000)
    common._STATE.clear()


def test_words_asked_for_again_stay_when_the_cache_overflows(monkeypatch):
    from sigtrace.llm.packing import WordEncoder, default_tokenizer

    encoder, learned = WordEncoder(default_tokenizer(), 400), []
    learn = encoder._learn_words
    monkeypatch.setattr(encoder, "_learn_words", lambda words: learned.extend(words) or learn(words))
    name = lambda n: "".join(chr(97 + int(d)) for d in f"{n:05d}")
    common = " ".join(name(n) for n in range(50)) + " (Word), end."
    for k in range(40):
        text = common + " " + " ".join(name(1_000 + 60 * k + n) for n in range(60))
        ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.cache) <= 500
    assert learned.count(name(7)) == learned.count("word") == 1  # before: once after every overflow


def test_rows_are_decoded_and_words_of_near_lengths_merged_together(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    from sigtrace.llm import pieces

    codec = sentencepiece_codec.codec_of(pieces.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = np.random.default_rng(5)
    alphabet = list("aabcdeeehinorsttu.,é日▁x")
    words = sorted({"".join(rng.choice(alphabet, n)).replace("▁", "") for n in rng.integers(1, 30, 3_000).tolist()} - {""})
    advanced, advance = [], type(codec)._advance
    monkeypatch.setattr(type(codec), "_advance", lambda self, words, which, size, out: advanced.append(size) or advance(self, words, which, size, out))
    coded = [np.frombuffer(x, np.int32).tolist() for x in codec.encode_keys(words)]
    assert coded == [sp.encode(w) for w in words]
    assert len(advanced) < 16  # before: one step for each of 30 lengths
    rows = pa.array([None, [], *coded, coded[0] + coded[-1]], pa.list_(pa.int32()))
    want = ["", "", *words, words[0] + " " + words[-1]]
    monkeypatch.setattr(type(codec), "decode", None)  # before: one call a row
    assert codec.decode_rows(rows) == want
    assert codec.decode_rows(rows.slice(1, 9)) == want[1:10]


def test_documents_that_take_a_block_take_it_together():
    rng = np.random.default_rng(4)
    vectors = [{f: float(rng.random()) + 0.1 for f in rng.choice(40, 6, replace=False).tolist()} for _ in range(700)]
    ids = rng.permutation(700).tolist()
    index = toxicity.Index(ids, np.array([i % 2 for i in ids]), vectors, 40, (0.5, 0.5))
    products = []

    class Counted(np.ndarray):
        def __rmatmul__(self, other):
            products.append(len(other))
            return np.asarray(other) @ np.asarray(self)

        __array_ufunc__ = None

    index.rows = [x.view(Counted) for x in index.rows]
    place = {int(i): n for n, i in enumerate(index.ids)}
    got = index.nearest_of(vectors[:300], 15, np.array([place[i] for i in ids[:300]]))
    by_id = dict(zip(ids, vectors))
    for q in range(0, 300, 37):
        want = sorted((-round(sum(w * v.get(f, 0.0) for f, w in vectors[q].items()), 12), i) for i, v in by_id.items() if i != ids[q] and set(v) & set(vectors[q]))[:15]
        assert index.ids[got[q][0]].tolist() == [i for _, i in want]
    assert len(products) <= 4 * len(index.rows)  # before: a product for each document and block


def test_packing_leaves_no_words_in_an_idle_worker(spark):
    from sigtrace.llm import common
    from sigtrace.llm.packing import pieces_of

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            held = common._STATE.get("value")
            yield pa.RecordBatch.from_arrays([pa.array([len(held.cache) if held is not None else 0], pa.int64())], ["n"])

    docs = spark.createDataFrame([(i, f"some words of text {chr(97 + i)}") for i in range(8)], "doc_id long, text string")
    assert pieces_of(docs).count() == 8
    found = spark.range(64).repartition(32).mapInArrow(kept, "n long").collect()
    assert not any(r["n"] for r in found)  # before: the words of the worker's last task


def test_requests_and_answers_of_common_words_are_small():
    from sigtrace.llm import katz

    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 63, 5_000).astype(np.uint64)
    common = katz._Common(words, np.arange(5_000, 0, -1))
    tokens = np.append(words, np.uint64(7))[np.minimum(rng.zipf(1.2, 50_000) - 1, 5_000)]  # the last one is rare
    before = katz.histories(tokens, 3)
    who = np.sort(rng.integers(0, 400, len(tokens)))
    owners = np.arange(9 << 32, (9 << 32) + 400, dtype=np.uint64)
    packed = katz._requests(before, tokens, owners, who, np.zeros(0, np.uint64), 40, common)
    got_owners, columns, got = katz._asked(katz._table(packed), 3, common)
    asked = sorted(zip(owners[who].tolist(), *(c.tolist() for c in before), tokens.tolist()))
    assert sorted(zip(got_owners.tolist(), *(c.tolist() for c in columns), got.tolist())) == asked
    assert sum(map(len, packed["words"].to_pylist())) < 3.1 * len(tokens) + 8 * np.count_nonzero(tokens == 7)  # before: 8 each
    # answers: one row a slice, not one an owner
    rows = list(katz._sliced(owners >> np.uint64(katz.SLICE), owners, np.arange(400.0)))
    assert len(rows) == 1
    import pyarrow as pa

    sums = katz._added(pa.Table.from_pylist(rows * 2)).to_pydict()
    assert sums == {"owner": owners.tolist(), "value": (2 * np.arange(400.0)).tolist()}


def test_candidates_post_half_of_their_shingles_and_linked_pairs_share_enough():
    from sigtrace.llm.jaccard_join import Bounds

    for percent in (50, 80, 95):
        bounds = Bounds(percent)
        shared = [bounds.least(n) - bounds.outside(n) for n in range(2_000)]
        assert shared == sorted(shared) and min(shared[1:]) > 0
        # the sets of a linked pair hold it in common at the least, less what one of them has not posted
        for b in range(1, 2_000, 7):
            for a in range(bounds.least(b), b + 1, 5):
                assert bounds.overlap(a, b) - max(bounds.outside(a), bounds.outside(b)) >= shared[b]
    assert 1_000 - Bounds(80).outside(1_000) < 530  # before: all 1,000 shingles were posted
