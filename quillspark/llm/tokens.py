"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary (a rank file) is turned into a sentencepiece BPE model that is serialised here, field by field: each
token's bytes are mapped to printable code points, its score is the negative rank, normalisation is the identity.
A text is split by the vocabulary's pattern, each distinct pre-token is encoded by that model, and ids are joined
again; ids equal ranks, so decoding is the inverse byte mapping. The model (1.3 MB, of fixed size) is broadcast.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import spread

#: Fixed value: the splitting pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

VOCABULARY = os.environ.get("QUILLSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Distinct pre-tokens kept by a worker; at this many the memory is emptied and filled anew (results don't change).
KEPT = 400_000


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file, by rank. Ranks without a gap are required, as ids are positions."""
    found: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("the ranks have gaps")
    return [found[rank] for rank in range(len(found))]


def byte_letters() -> str:
    """256 distinct printable code points, one for each byte: U+0100 onwards in order.

    Any injective mapping will do, as the vocabulary's own bytes are mapped too; none of these is white space, which
    sentencepiece would treat in a way of its own.
    """
    return "".join(chr(0x100 + byte) for byte in range(256))


def _number(value: int) -> bytes:
    out = bytearray()
    while True:
        low, value = value & 0x7F, value >> 7
        out.append(low | 0x80 if value else low)
        if not value:
            return bytes(out)


def _varint_field(number: int, value: int) -> bytes:
    return _number(number << 3) + _number(value)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with one normal piece for each token, and an unknown piece after the last."""
    letters = byte_letters()
    pieces = [("".join(letters[byte] for byte in token), -float(rank), 1) for rank, token in enumerate(tokens)]
    pieces.append(("", -2.0 * len(tokens), 2))
    model = bytearray()
    for piece, score, kind in pieces:
        body = _bytes_field(1, piece.encode()) + _number(2 << 3 | 5) + struct.pack("<f", score) + _varint_field(3, kind)
        model += _bytes_field(1, body)
    model += _bytes_field(2, _varint_field(3, 2))  # trainer: BPE
    # normaliser: identity; no prefix, no collapsing, no escaping of white space
    model += _bytes_field(3, _bytes_field(1, b"identity") + _varint_field(3, 0) + _varint_field(4, 0) + _varint_field(5, 0))
    return bytes(model)


class Encoder:
    """Encodes and decodes texts with a serialised model."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(PATTERN).findall
        self._map = {byte: letter for byte, letter in enumerate(byte_letters())}
        self._seen: dict[str, list[int]] = {}

    def _letters(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self._map)

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts both give []."""
        parts = [self._split(text) if text else [] for text in texts]
        if len(self._seen) > KEPT:
            self._seen.clear()
        seen = self._seen
        new = list({part for row in parts for part in row if part not in seen})
        if new:
            seen.update(zip(new, self._pieces.encode([self._letters(part) for part in new], out_type=int, num_threads=1)))
        return [[i for part in row for i in seen[part]] for row in parts]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Only the numbers of ids."""
        parts = [self._split(text) if text else [] for text in texts]
        if len(self._seen) > KEPT:
            self._seen.clear()
        seen = self._seen
        new = list({part for row in parts for part in row if part not in seen})
        if new:
            seen.update(zip(new, self._pieces.encode([self._letters(part) for part in new], out_type=int, num_threads=1)))
        return [sum(len(seen[part]) for part in row) for row in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the inverse of encode for every text."""
        back = {letter: byte for byte, letter in enumerate(byte_letters())}
        return bytes(back[letter] for i in ids for letter in self._pieces.id_to_piece(i)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def shipped_model(df: DataFrame, vocabulary: str = VOCABULARY):
    """The model as a broadcast variable; only the driver reads the vocabulary file."""
    return df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))


def _with_column(df: DataFrame, name: str, kind: T.DataType, text: str, vocabulary: str, ids: bool, keep: list[str] | None) -> DataFrame:
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    if name == text:
        raise ValueError("the result may not replace the text")
    columns = [c for c in (df.columns if keep is None else keep) if c != name]
    back = len(columns)
    # the text goes to Python in the last place, and comes back only if it is kept
    kept = df.select(*columns, F.col(text).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(name, kind)])
    model = shipped_model(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(back).to_pylist()
                if ids:
                    made = pa.array(encoder.encode_all(texts), pa.list_(pa.int32()))
                else:
                    made = pa.array(encoder.count_all(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:back], made], names=schema.names)

    return spread(kept).mapInArrow(run, schema)


def token_ids(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Add the token ids of each row's whole text.

    Null and empty texts give an empty list, blank texts are encoded as they are, strings that look like special
    tokens are ordinary text. Rows are neither dropped nor merged: repeated rows stay repeated, an empty table stays
    empty. All columns pass through, or those of ``keep`` alone, which spares sending the texts back from Python; a column
    that already has the name ``ids`` is replaced. No shuffle, unless the scan has fewer partitions than the cluster has
    cores.
    """
    return _with_column(df, ids, T.ArrayType(T.IntegerType(), False), text, vocabulary, True, keep)


def token_counts(df: DataFrame, text: str = "text", count: str = "n_tokens", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Add the number of tokens of each row's whole text; null and empty texts have 0. Otherwise as token_ids."""
    return _with_column(df, count, T.LongType(), text, vocabulary, False, keep)
