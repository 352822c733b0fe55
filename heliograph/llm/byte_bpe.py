"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary's byte strings are mapped to printable characters, one for each
byte, and written as a sentencepiece BPE model: a piece's score is its negative
rank, so the library merges the pair of least rank first. The model has the
identity normaliser and no dummy prefix. Every pre-token goes through the model,
each distinct one once for as long as a worker remembers it; decoding maps ids
back to their byte strings.

Null texts are empty texts and have no ids. Rows with equal texts get equal
rows; ``doc_id`` may be null or repeat. Texts of any length are encoded whole. Columns other than ``doc_id`` and
``text`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.llm.pretokens import PretokenCache
from heliograph.llm.words import runs

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of every byte string of a rank file (base64 and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is printable Latin-1, else from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, integer or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a rank vocabulary: piece i has rank i, the last one is unknown."""
    chars = byte_characters()
    size = max(ranks.values()) + 1
    names: list[tuple[str, int]] = [(f"<unused_{i}>", 5) for i in range(size)]
    for piece, rank in ranks.items():
        names[rank] = ("".join(chars[b] for b in piece), 1)
    pieces = [_field(1, _field(1, name.encode()) + _field(2, float(-i)) + _field(3, kind)) for i, (name, kind) in enumerate(names)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder; one is made in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.pattern = regex.compile(pattern)
        self.characters = dict(enumerate(byte_characters()))
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.cache = PretokenCache(self.encode_alone)

    def encode_alone(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, its pre-tokens one by one through the model."""
        found = [self.pattern.findall(text) for text in texts]
        mapped = [token.encode().decode("latin-1").translate(self.characters) for tokens in found for token in tokens]
        ids = iter(self.model.encode(mapped, num_threads=1) if mapped else [])
        return [[i for _ in tokens for i in next(ids)] for tokens in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        counts, ids = self.cache.whole(texts)
        return np.split(ids.astype("<u4", copy=False), np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_MADE: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder for a rank file on its own disk, made at first use."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (binary) of every whole text. Map only: no shuffle."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            for rows, _, _ in runs(batch, 1):
                ids = bpe.encode([x or "" for x in rows.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document.

    The digests are taken in the same worker that encodes and decodes, so ids
    and bytes need not pass to the JVM. Map only: no shuffle.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            for rows, _, _ in runs(batch, 1):
                ids = bpe.encode([x or "" for x in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(kernel, SCHEMA)
