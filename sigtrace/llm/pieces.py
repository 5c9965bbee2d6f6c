"""Splitting a text into chunks that SentencePiece encodes independently.

The model marks white space with U+2581 and puts one in front of the text.  No piece of
its vocabulary has another character before that mark (``check_vocabulary``), so no merge
and no piece crosses from a chunk into the next: a run of spaces with what follows it is
encoded alike wherever it stands.  A chunk's key leaves out one of its leading spaces.
"""

from __future__ import annotations

import re

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def _model(sp):
    from sentencepiece import sentencepiece_model_pb2

    return sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())


def is_bpe(sp) -> bool:
    """Whether the model encodes by merges; raises for kinds of model that are neither BPE nor unigram."""
    spec = _model(sp).trainer_spec
    if spec.model_type not in (spec.BPE, spec.UNIGRAM):
        raise ValueError("only BPE and unigram models can be encoded")
    return spec.model_type == spec.BPE


def has_special_pieces(sp) -> bool:
    """Whether pieces are user-defined or unused: these are not merged like others."""
    return any(p.type in (p.USER_DEFINED, p.UNUSED) for p in _model(sp).pieces)


def check_vocabulary(sp) -> None:
    inner = re.compile(f"[^{MARK}]{MARK}")
    bad = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if inner.search(p)]
    if bad:
        raise ValueError(f"pieces with an inner space mark, chunks are not independent: {bad[:5]}")


def chunk_keys(text: str) -> list[str]:
    """Keys of the chunks of ``text``; none for an empty text."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    keys = text.split(" ")
    if "" in keys:
        keys = [chunk[1:] for chunk in _CHUNK.findall(" " + text)]
    return keys
