"""Encoding texts with a public byte-level BPE vocabulary, by a sentencepiece model serialised from its ranks."""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabularies; the environment variable names another.
VOCABULARIES = os.environ.get("PAGEFOLD_TOKENIZERS", "/opt/tokenizers")
#: Distinct pre-tokens a worker remembers, and the longest it remembers; the memory is dropped when full.
REMEMBERED, LONGEST = 200_000, 64

# Fixed value: how the vocabulary's authors split a text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it prints in Latin-1, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id; ids must run from 0 without a gap."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: the ids have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(*fields: tuple[int, object]) -> bytes:
    """Wire format of a message: whole numbers, floats, and bytes for strings and messages."""
    out = bytearray()
    for number, value in fields:
        if isinstance(value, bytes):
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += _varint(number << 3) + _varint(int(value))
    return bytes(out)


def bpe_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i in byte letters, scored -i, without normalisation.

    Lower ranks merge first, as scores fall with the id; one piece more is the unknown piece that such a model must
    have, which byte letters never need.
    """
    letters, unknown = byte_letters(), len(tokens)
    pieces = [(1, _message((1, "".join(letters[b] for b in t).encode()), (2, -float(i)), (3, 1))) for i, t in enumerate(tokens)]
    pieces.append((1, _message((1, b"<unk>"), (2, 0.0), (3, 2))))
    trainer = _message((3, 2), (4, unknown + 1), (40, unknown), (41, -1), (42, -1), (43, -1))
    normaliser = _message((1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0))
    return _message(*pieces, (2, trainer), (3, normaliser))


class ByteBpe:
    """Encoder and decoder of one vocabulary; the same ids as its own library gives, special tokens aside."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece

        letters = byte_letters()
        self._tokens = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(self._tokens))
        self._split = regex.compile(PRE_TOKEN).findall
        self._letters = {b: letters[b] for b in range(256)}
        self._known: dict[str, list[int]] = {}

    def _letters_of(self, pre_token: str) -> str:
        return pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)

    def _learn(self, pre_tokens: list[str]) -> list[str]:
        """Encodes the pre-tokens not remembered; gives back the long ones, which never are."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = [p for p in dict.fromkeys(pre_tokens) if p not in self._known]
        for p, ids in zip(new, self._model.encode([self._letters_of(p) for p in new], out_type=int, num_threads=1), strict=True):
            self._known[p] = ids
        return [p for p in new if len(p) > LONGEST]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; none for a null or empty one."""
        if not text:
            return []
        parts = self._split(text)
        long = self._learn(parts)
        out = [i for p in parts for i in self._known[p]]
        for p in long:
            del self._known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, by the inverse mapping of pieces to bytes."""
        return b"".join(self._tokens[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    """The encoder of a rank file, once per worker process."""
    return ByteBpe(path)


def rank_file(name: str, folder: str | None = None) -> str:
    return f"{folder or VOCABULARIES}/{name}.tiktoken"


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key, ids``: each row's text as ids, one row for each row of ``df``.

    Special tokens are plain text. A null and an empty text have no ids (an empty list). Repeated rows come out as
    often as they occur, null keys too. The vocabulary is read from ``folder`` on each worker, never shipped.
    """
    path = rank_file(vocabulary, folder)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path).encode
        for b in batches:
            ids = pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``df`` with the number of ids of ``text`` in place of ``text``; 0 for a null or empty one."""
    path, kept = rank_file(vocabulary, folder), [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path).encode
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*kept, out])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.LongType())])
    return df.select(*kept, text).mapInArrow(run, schema)
