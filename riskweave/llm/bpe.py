"""Byte-level BPE encoding and decoding through a sentencepiece model written straight from a rank vocabulary.

A rank file (base64 bytes and rank, one token a line) becomes a sentencepiece BPE model without any training: every byte
is mapped to one printable code point, a token to the string of its bytes' code points, its score to minus its rank, and
normalisation to identity. sentencepiece then merges the pair of the best score first, leftmost on ties, which is the
order that rank vocabularies define. Texts are split into pre-tokens by the vocabulary's pattern; a pre-token that is a
token itself keeps that id, as the rank encoders do, and any other goes through the model.

Null texts count as empty: no ids, no bytes. Rows may repeat; other columns are not read. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "<unk>"
#: A worker forgets its memo of pre-tokens beyond this number; results do not depend on it.
MEMO = 400_000


def byte_symbols() -> list[str]:
    """One printable code point for each byte: Latin-1's own visible characters, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, at the place of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the unknown piece takes the first id after them.

    The numbers are those of the public sentencepiece_model.proto.
    """
    symbols = byte_symbols()
    pieces = []
    for rank, token in enumerate(tokens):
        piece = "".join(symbols[b] for b in token)
        # A gap among the ranks becomes a piece that no text has.
        pieces.append(_field(1, piece.encode() or f"{rank}".encode()) + _field(2, float(-rank)) + _field(3, 1 if piece else 5))
    pieces.append(_field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))  # model_type BPE, vocab_size, unk_id
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos, pad
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no removal or escaping of spaces
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encoder and decoder of one vocabulary; made once a worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(tokens))
        self.to_symbol = {b: ord(s) for b, s in enumerate(byte_symbols())}
        self.whole = {t.decode(): (r,) for r, t in enumerate(tokens) if t and _is_utf8(t)}
        #: decoding goes from the model's pieces back to bytes
        to_byte = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes_of = [bytes(to_byte[c] for c in self.model.id_to_piece(i)) if t else b"" for i, t in enumerate(tokens)]
        codec = self

        class Memo(dict):
            def __missing__(self, piece: str):
                ids = codec.whole.get(piece)
                if ids is None:
                    symbols = piece.encode().decode("latin-1").translate(codec.to_symbol)
                    ids = tuple(codec.model.encode(symbols))
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.memo = Memo()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if len(self.memo) > MEMO:
            self.memo.clear()
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, self.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _is_utf8(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def transcode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """``key``, n_tokens, ids (packed little-endian unsigned 32-bit integers) and, decoded from the ids, decoded (bytes).

    The vocabulary, of a fixed size, is read by the driver and broadcast; no executor opens the file.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern))
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*held.value)
        for batch in batches:
            # long texts leave in small batches, so that memory follows the longest text, not the batch
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                out = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decode:
                    out.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["key", "n_tokens", "ids", "decoded"][: len(out)])

    out = source.mapInArrow(run, f"key {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)
    return out.withColumnRenamed("key", key)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = transcode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
