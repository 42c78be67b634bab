"""Byte-level BPE through a sentencepiece model built from ranks (operator 6).

The vocabulary file lists byte strings with their merge rank. Each byte is
mapped to one printable character, so every vocabulary entry becomes a
sentencepiece piece; its score is the negative rank, so sentencepiece merges
the pair of lowest rank first, leftmost on ties, as byte-level BPE does. The
model is serialised directly (no training) with identity normalisation.
Pre-tokens are matched by the public pattern; each is encoded separately, and a
pre-token that is itself in the vocabulary is that one id. Decoding maps ids
back to their bytes.

Edge cases: a null text counts as empty; an empty text has no ids; texts of any
length are encoded whole, one at a time; repeated rows are encoded alike; an
empty table gives an empty result; other input columns are kept unless they
clash with an added one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import text_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHE_BOUND = 150_000
REMEMBERED = 64  # letters of the longest pre-token that is remembered


def load_ranks(path: str) -> list[bytes]:
    """Byte string of each rank, from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    pieces = [b""] * len(ranks)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def byte_characters() -> list[str]:
    """A printable character per byte: itself where Latin-1 prints it, else
    the next free character from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in shown}
    for b in range(256):
        chars.setdefault(b, chr(0x100 + len(chars) - len(shown)))
    return [chars[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """Serialised model: piece i has id i; an unknown piece, which a complete
    byte alphabet never yields, comes last. Field numbers are those of the
    public sentencepiece model format."""
    chars = byte_characters()
    out = []
    for rank, piece in enumerate(pieces):
        text = "".join(map(chars.__getitem__, piece)).encode()
        out.append(_message(1, _message(1, text) + b"\x15" + struct.pack("<f", -float(rank))))
    unknown = _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)
    out.append(_message(1, unknown))
    none = (1 << 64) - 1  # -1: no such control piece
    trainer = (_number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) +
               _number(41, none) + _number(42, none) + _number(43, none))
    identity = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _message(2, trainer) + _message(3, identity)


class ByteBpe:
    """Encoder and decoder of one vocabulary. Ids of pre-tokens of at most
    ``REMEMBERED`` letters are remembered, about ``CACHE_BOUND`` of them."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import regex
        import sentencepiece
        self.pieces = load_ranks(path)
        self._names = list(map(str, range(len(self.pieces))))
        self._whole = {p: i for i, p in enumerate(self.pieces)}
        self._chars = dict(enumerate(byte_characters()))
        self._model = sentencepiece.SentencePieceProcessor(
            model_proto=sentencepiece_model(self.pieces))
        self._find = regex.compile(pattern).findall
        self._cache: dict[str, bytes] = {}

    def _pre_token(self, token: str) -> bytes:
        raw = token.encode()
        whole = self._whole.get(raw)
        ids = [whole] if whole is not None else \
            self._model.encode(raw.decode("latin-1").translate(self._chars), num_threads=1)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        tokens, cache = self._find(text), self._cache
        new = set(tokens).difference(cache)
        if len(cache) + len(new) > CACHE_BOUND:
            cache.clear()
            new = set(tokens)
        long = {}
        for token in new:
            (cache if len(token) <= REMEMBERED else long)[token] = self._pre_token(token)
        ids = map(cache.__getitem__, tokens) if not long else (cache[t] if t in cache else long[t] for t in tokens)
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def ids_digest(self, ids: np.ndarray) -> str:
        return sha256(",".join(map(self._names.__getitem__, ids.tolist())).encode()).hexdigest()


@lru_cache(maxsize=2)
def shared_bpe(path: str) -> ByteBpe:
    """One encoder per worker process."""
    return ByteBpe(path)


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def encode_texts(df: DataFrame, text: str = "text", vocabulary: str = RANKS, digests: bool = False,
                 keep_ids: bool = True) -> DataFrame:
    """Replaces ``text`` by ``ids``: its ids as little-endian unsigned 32-bit
    integers. With ``digests`` the ids are decoded again and n_tokens, ids_sha256
    (decimal ids joined by commas) and decoded_sha256 (the decoded bytes) are
    added. One pass: a task has one encoder, and no text leaves it."""
    added = ["ids"] * keep_ids + DIGESTS * digests
    kept = [c for c in df.columns if c not in [text, *added]]
    types = {"ids": T.BinaryType(), "n_tokens": T.LongType()}
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, types.get(c, T.StringType())) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(public_tokenizers.path(vocabulary))
        for batch in text_batches(batches, text, 1 << 20):
            out = {c: [] for c in added}
            for t in batch.column(text):
                ids = bpe.encode(t.as_py() or "")
                if keep_ids:
                    out["ids"].append(ids.tobytes())
                if digests:
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(bpe.ids_digest(ids))
                    out["decoded_sha256"].append(sha256(bpe.decode(ids)).hexdigest())
            columns = [pa.array(out[c], {"ids": pa.binary(), "n_tokens": pa.int64()}.get(c, pa.string())) for c in added]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, *added])

    return df.mapInArrow(run, schema)
