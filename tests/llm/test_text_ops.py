"""Tokenizer-based operators, rules and personal data against the libraries and brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from sigtrace.llm import pieces
from tests.llm.odd import TEXTS, no_docs, odd_docs


def texts():
    return [t or "" for _, t, *_ in TEXTS]


def test_token_counts_are_the_library_s(spark):
    from sigtrace.llm.token_counts import count_tokens

    sp = pieces.load(pieces.default_model())
    got = count_tokens(odd_docs(spark), keep=("doc_id", "source"), table_size=3, head_size=5, cache_size=10).collect()
    want = sorted((len(t.encode()), len(sp.encode(t))) for t in texts())
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert count_tokens(no_docs(spark)).count() == 0


def test_chunks_are_independent():
    sp = pieces.load(pieces.default_model())
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice(" ab\n▁é日<>s.") for _ in range(rng.randint(0, 20)))
        parts = [len(sp.encode(k)) if k else 1 for k in pieces.chunk_keys(t)]
        assert sum(parts) == len(sp.encode(t)), repr(t)


def brute_viterbi(codec, names, text):
    """Best segmentation by plain dynamic programming; longest last piece wins a tie."""
    s = ("▁" + text).replace(" ", "▁")
    best = [(0.0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - codec.longest), end):
            piece = s[start:end]
            if piece in names:
                score, ids = names[piece][0], [names[piece][1]]
            elif end - start == 1:
                score, ids = codec.unknown, [int(codec.byte_ids[b]) for b in piece.encode()]
            else:
                continue
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + ids)
    return best[-1][1]


def test_viterbi_and_round_trip(spark):
    from sigtrace.llm.sentencepiece_codec import Codec, decode, encode

    codec = Codec(pieces.default_model())
    sp = pieces.load(pieces.default_model())
    names = {sp.id_to_piece(int(i)): (float(s), int(i)) for i, s in zip(codec.ids, codec.scores)}
    rng = random.Random(2)
    words = ["".join(rng.choice("abetio né日\U0001f600") for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["hello", "unbelievable"]
    for word, ids in zip(words, codec.encode_keys(words)):
        assert np.frombuffer(ids, np.int32).tolist() == brute_viterbi(codec, names, word), word
    coded = encode(odd_docs(spark), keep=("doc_id", "text"))
    back = decode(coded.drop("n_tokens").withColumnRenamed("text", "given"), keep=("doc_id", "given")).collect()
    assert len(back) == len(TEXTS)
    assert all(r.text == (r.given or "").replace("▁", " ") for r in back)
    assert encode(no_docs(spark)).count() == 0


def test_ids_are_the_library_s(spark, tmp_path):
    import io

    import sentencepiece

    from sigtrace.llm import sentencepiece_codec
    from sigtrace.llm.sentencepiece_codec import Codec, MergeCodec, codec_of, encode

    sp = pieces.load(pieces.default_model())
    codec = codec_of(pieces.default_model())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150).collect()
    rng = random.Random(3)
    words = {k for r in docs for k in pieces.chunk_keys(r.text or "")[:400]}
    words |= {"".join(rng.choice("abetio  né日\U0001f600<>\n\x00") for _ in range(rng.randint(1, 40))) for _ in range(3000)}
    words |= {"".join(rng.choice("theinanders") for _ in range(n)) for n in (2, 50, 300, 5000) for _ in range(3)} | {"a" * 999, "=" * 50, "hello"}
    words = sorted(words)
    want = [sp.encode(w) for w in words]
    assert isinstance(codec, MergeCodec)
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode_keys(words)] == want
    short = [i for i, w in enumerate(words) if len(w) < sentencepiece_codec._LONG]
    assert [np.frombuffer(codec._merged((pieces.MARK + words[i]).replace(" ", pieces.MARK)), np.int32).tolist() for i in short] == [want[i] for i in short]
    for r in encode(odd_docs(spark), keep=("text",)).collect():
        assert r.ids == sp.encode(r.text or "") and r.n_tokens == len(r.ids)
    # a unigram model keeps the search for the highest total
    model = io.BytesIO()
    lines = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) + rng.choice(["a", "is", "um"]) for _ in range(8)) for _ in range(200)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_writer=model, model_type="unigram", vocab_size=300, byte_fallback=True, hard_vocab_limit=False, normalization_rule_name="identity", minloglevel=2
    )
    (tmp_path / "u.model").write_bytes(model.getvalue())
    assert type(codec_of(str(tmp_path / "u.model"))) is Codec


def best_fit_decreasing(counts, capacity):
    """Sequences that one document after the other needs, longest first."""
    from bisect import bisect_left, insort

    gaps, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect_left(gaps, length)
            opened += at == len(gaps)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            insort(gaps, gap - length)
    return opened


def test_packing_is_exact_and_tight(spark):
    from tokenizers import Tokenizer

    from sigtrace.llm.packing import Rounds, default_tokenizer, pack

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = pack(odd_docs(spark)).collect()
    want = sorted(((i or -1), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, t, *_) in TEXTS for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [0]] for x in [ids[k : k + 2048] for k in range(0, len(ids), 2048)])
    assert sorted(((r.doc_id or -1), r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(no_docs(spark)).count() == 0
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(30)}
        done = Rounds(counts, 100).run()
        assert not any(done.left.values())
        assert done.sequences <= 1.04 * best_fit_decreasing(counts, 100) + 1


def test_word_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    from sigtrace.llm.packing import WordEncoder, default_tokenizer

    tokenizer, encoder = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer(), 500)
    rng = random.Random(4)
    alphabet = "aBc ÉéßIİıΣσς́ẞ'.,!?<|>\n\t\r\x0b\x1c\x85\xa0 日本５9Ⅻǅ"
    for k in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        t = t[:5] + rng.choice(["<|endoftext|>", "<|startoftext|> x", "don't I'LL they're", "<|ENDOFTEXT|>", ""]) + t[5:]
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_line_rules_against_brute_force(spark):
    from sigtrace.llm.line_rules import judge

    got = judge(odd_docs(spark)).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(map(brute_rules, texts()))
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[9] and not kept[2] and not kept[3] and kept[5]
    assert judge(odd_docs(spark)).where("kept").count() == sum(r.kept for r in got)
    assert judge(no_docs(spark)).count() == 0
    cleaned = judge(spark.createDataFrame([(1, "\n".join(["A fine sentence of words stands here."] * 9 + ["home | news | sport | more"]))], "doc_id long, text string")).first()
    assert "sport" not in cleaned.clean_text and cleaned.lost_chars == 26


def test_line_rules_against_duckdb(spark):
    import duckdb

    from sigtrace.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ORACLES["op8_line_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op8_line_rules"](spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want:
        assert (want[c] == got[c]).all(), c


def test_personal_data(spark):
    from sigtrace.llm.pii import base_spans, find, redact, window_starts

    t = TEXTS[9][1]
    assert [(k, t[a:b]) for k, a, b in base_spans(t)] == [(0, "ann.lee+x@mail.example.org"), (1, "10.0.0.255"), (2, "4111 1111 1111 1111"), (3, "+1 (555) 010-9999")]
    assert redact(t, base_spans(t)) == "Write to [EMAIL] or call [PHONE] now, card [CARD] at [IP] or 300.1.1.1."
    got = find(odd_docs(spark), keep=("doc_id", "spans"), redacted=True, steps=5).drop("spans").collect()
    assert len(got) == len(TEXTS)
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id == 8] == [(1, 1, 1, 1)]
    assert find(no_docs(spark)).count() == 0
    long = "x" * 500 + " 7 " + "y" * 500
    assert all(s <= long.index("7") < s + 96 for s in window_starts(long)) and window_starts(long)


def test_tagger_learns_spans():
    from sigtrace.llm import pii
    from sigtrace.llm.bilstm_crf import Tagger, characters

    rng = random.Random(6)

    def sample():
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
        phone = f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(1000000, 9999999)}"
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        t = " ".join([word(), word(), rng.choice([phone, ip, f"{word()}@{word()}.org"]), word(), word(), word()])
        return pii._padded(characters(t[: pii.WINDOW])), pii.window_tags(pii.base_spans(t), 0)

    train, held = zip(*(sample() for _ in range(300))), zip(*(sample() for _ in range(60)))
    (x, y), (hx, hy) = (tuple(map(np.stack, s)) for s in (train, held))
    tagger = Tagger(len(pii.KINDS), seed=1)
    losses = tagger.fit(x, y, 150)
    assert losses[-1] < losses[0] / 5
    path, _ = tagger.decode(hx)
    assert (path == hy).mean() > 0.95


def test_gradient_of_the_tagger():
    from sigtrace.llm.bilstm_crf import Tagger

    rng = np.random.default_rng(0)
    tagger = Tagger(1, hidden=3, embedding=2)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    chars, tags = rng.integers(0, 20, (3, 6)), np.array([[0, 1, 2, 2, 0, 0], [1, 2, 0, 1, 0, 0], [0, 0, 0, 0, 0, 0]])
    _, g = tagger._gradient(chars, tags)
    for name in ("out", "hf", "xb", "trans", "cf"):
        at = tuple(0 for _ in tagger.p[name].shape)
        loss = []
        for step in (1e-4, -1e-4):
            tagger.p[name][at] += step
            loss.append(tagger._gradient(chars, tags)[0])
            tagger.p[name][at] -= step
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=0.02, abs=2e-4), name
