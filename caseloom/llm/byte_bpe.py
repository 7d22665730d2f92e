"""Byte-level BPE ids by a sentencepiece model written straight from a rank file, and their way back.

The model is not trained: its pieces are the tokens of the vocabulary, each byte written as one
printable character, and a piece's score is its negative rank, so that the best-scored pair is the
pair of lowest rank. Normalisation is the identity. A text is cut into pre-tokens by the
vocabulary's pattern; each is mapped, encoded alone and kept for the next time it comes up. Ids go
back to bytes through the same pieces and the inverse of the mapping.

The driver reads the vocabulary and broadcasts the serialised model, whose size depends on the
vocabulary alone (0.9 MB for 50,000 tokens); executors need no file. There is no shuffle.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_column, as_bytes, struct_of, without

#: Pre-tokens whose ids a worker remembers; beyond that it starts afresh, which changes no result.
REMEMBERED = 1 << 18
#: Characters of a pre-token that is still remembered.
SHORT = 64
#: Ids or pre-tokens of one text worked on at once.
PART = 1 << 18

#: Field numbers and constants of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
UNK_ID, BOS_ID, EOS_ID, PAD_ID = 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def byte_characters() -> list[str]:
    """One printable character per byte: itself where it prints, else the next one from U+0100 on."""
    out, spare = [], 256
    for byte in range(256):
        prints = 33 <= byte <= 126 or 161 <= byte <= 255 and byte != 173
        out.append(chr(byte if prints else spare))
        spare += not prints
    return out


_TO_CHARACTERS = dict(enumerate(byte_characters()))
_TO_BYTES = {ord(c): b for b, c in _TO_CHARACTERS.items()}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARACTERS)


def unmapped(piece: str) -> bytes:
    return bytes(_TO_BYTES[ord(c)] for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _held(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _score(n: float) -> bytes:
    return _varint(SCORE << 3 | 5) + struct.pack("<f", n)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The model of a vocabulary: a piece per token in the order of ranks, then the unknown piece.

    Every byte must be a token, so that no text is unknown; ranks must be exact as 32-bit floats.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")
    if len(set(ranks.values())) < len(ranks) or min(ranks.values()) < 0 or max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks are distinct numbers from 0 to 2**24")
    pieces = [_held(PIECES, _held(PIECE, mapped(token).encode()) + _score(-float(rank)) + _number(TYPE, NORMAL))
              for token, rank in sorted(ranks.items(), key=lambda item: item[1])]
    pieces.append(_held(PIECES, _held(PIECE, b"<unk>") + _score(0.0) + _number(TYPE, UNKNOWN)))
    trainer = _number(MODEL_TYPE, BPE) + _number(UNK_ID, len(ranks)) + b"".join(_number(f, -1) for f in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _held(NAME, b"identity") + b"".join(_number(f, 0) for f in (DUMMY_PREFIX, EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
    return b"".join(pieces) + _held(TRAINER, trainer) + _held(NORMALIZER, normalizer)


class Codec:
    """A model with its pre-token pattern; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, model: bytes, ranks: np.ndarray, pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks.astype("<u4")
        self.pattern = regex.compile(pattern)
        self.tokens = {int(rank): unmapped(self.processor.id_to_piece(i)) for i, rank in enumerate(ranks)}
        self.known = _Remembered(self._ids)

    def _ids(self, pretoken: str) -> bytes:
        written = mapped(pretoken.encode("utf-8"))
        whole = self.processor.piece_to_id(written)
        # a pre-token that is a token is that token, whatever the merges make of it
        found = self.processor.encode(written) if whole == self.processor.unk_id() else [whole]
        return self.ranks[found].tobytes()

    def encode(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if len(text) <= PART:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        out, matches = bytearray(), self.pattern.finditer(text)
        while part := [m.group() for m in islice(matches, PART)]:
            out += b"".join(map(self.known.__getitem__, part))
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        numbers, out = np.frombuffer(ids, "<u4"), bytearray()
        for at in range(0, len(numbers), PART):
            out += b"".join(map(self.tokens.__getitem__, numbers[at:at + PART].tolist()))
        return bytes(out)


class _Remembered(dict):
    """Ids by pre-token, worked out when missing; never more than ``REMEMBERED`` of them."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.work(pretoken)
        if len(pretoken) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pretoken] = ids
        return ids


@lru_cache(maxsize=2)
def _codec(model: bytes, ranks: bytes, pattern: str) -> Codec:
    return Codec(model, np.frombuffer(ranks, "<u4"), pattern)


def _shared(df: DataFrame, vocabulary: str, pattern: str | None):
    """The model and its ranks, broadcast."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ranks = read_ranks(vocabulary)
    numbers = np.sort(np.fromiter(ranks.values(), "<u4", len(ranks))).tobytes()
    return df.sparkSession.sparkContext.broadcast((serialised_model(ranks), numbers, pattern))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """The documents with ``ids``, little-endian unsigned 32-bit numbers, and ``n_tokens``.

    ``vocabulary`` is the path of a rank file. Each match of ``pattern`` (by default the one the
    public vocabularies share) is encoded by itself; no text spells a special token. Null and empty
    texts have no ids. Every row stays, repeated ones too; columns named like the new ones are replaced.
    """
    shared = _shared(docs, vocabulary, pattern)

    def encoded(texts: pa.Array) -> pa.Array:
        codec = _codec(*shared.value)
        ids = [codec.encode(t.as_py()) for t in texts]
        return struct_of(ids=(ids, pa.binary()), n_tokens=([len(i) // 4 for i in ids], pa.int64()))

    kept = [F.col(f"`{c}`") for c in without(docs, "ids", "n_tokens").columns]
    done = docs.withColumn("_bpe", arrow_column(encoded, "struct<ids:binary,n_tokens:bigint>", as_bytes(F.col(f"`{text}`"))))
    return done.select(*kept, "_bpe.*")


def decode_documents(docs: DataFrame, vocabulary: str, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that their ids stand for. Null ids give no bytes.

    An id that is not in the vocabulary is an error, as in the libraries.
    """
    shared = _shared(docs, vocabulary, pattern)

    def decoded(column: pa.Array) -> pa.Array:
        codec = _codec(*shared.value)
        return pa.array([codec.decode(i.as_py() or b"") for i in column], pa.binary())

    kept = [F.col(f"`{c}`") for c in without(docs, "decoded").columns]
    return docs.select(*kept, arrow_column(decoded, "binary", F.col(f"`{ids}`")).alias("decoded"))
