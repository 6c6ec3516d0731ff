"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Pre-tokens are taken from every text with their positions. Each distinct one is
encoded once in the whole job, its ids are joined back to the slabs of texts that
hold it, and texts are put together by position. Decoding joins ids with the
table of token bytes, which the vocabulary bounds.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm import slabs
from quillgrid.llm.common import written

VOCABULARY = "byte_bpe_50k.tiktoken"
# What the standard library's classes say of other characters can differ from Unicode's L, N and White_Space.
_UNSURE = re.compile("[^\x00-\x1b\x20-\x7e¡-©«-±´¶-¸»¿-ʯ‐-‧‰-›€]")
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    import tiktoken

    # One match is all of a pre-token, which the pattern of the texts has already cut out.
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks(vocabulary), special_tokens={})


class Splitter:
    """Pre-tokens of a text, by the pattern of the public vocabularies.

    The standard library's engine gives the same matches twice as fast for
    texts of ASCII and Latin letters; any other text goes to the full engine.
    """

    def __init__(self):
        import regex

        self._full = regex.compile(public_tokenizers.PATTERN)

    def __call__(self, text: str) -> list[str]:
        return (self._full if _UNSURE.search(text) else _PLAIN).findall(text)


def _split(_ids: list, texts: list[str]) -> tuple:
    split, known = Splitter(), {}
    found, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = split(text)
        sizes[i] = len(words)
        found.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)))
    raw = [w.encode() for w in known]

    def pack(chosen: np.ndarray) -> bytes:
        words = [raw[k] for k in chosen]
        return slabs.pack_arrays(np.array([len(w) for w in words], "<u4"), np.frombuffer(b"".join(words), np.uint8))

    numbers = np.concatenate(found) if found else np.empty(0, np.int64)
    return numbers, sizes, np.array([zlib.crc32(w) for w in raw], np.int64), pack


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, finish=None, schema: str | None = None) -> DataFrame:
    """``doc_id, ids array<bigint>`` of every row of ``documents``, or what ``finish`` makes of them.

    ``finish`` takes the ids' Arrow array and an iterator of one array of token
    ids per text, and returns a record batch of ``schema``.
    """
    n = slabs.buckets(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    table = written(slabs.slab_rows(documents, _split, n), "bpe-slabs")

    def answer(pieces: Iterator) -> Iterator:
        encode_piece = _encoder(vocabulary).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for slab, piece in pieces:
            lengths, raw = slabs.unpack_arrays(piece, "<u4", "u1")
            ends, raw = np.cumsum(lengths, dtype=np.int64).tolist(), raw.tobytes()
            sizes, ids = [], []
            for a, b in zip([0, *ends[:-1]] if ends else [], ends):
                word = raw[a:b]
                tokens = known.get(word)
                if tokens is None:
                    known[word] = tokens = encode_piece(word.decode())
                sizes.append(len(tokens))
                ids.extend(tokens)
            yield slab, slabs.pack_arrays(np.array(sizes, "<u4"), np.array(ids, "<u4"))

    def arrays(ids: pa.Array, tokens: Iterator[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([t.astype(np.int64) for t in tokens], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    def unpack(value: bytes) -> list[np.ndarray]:
        return slabs.unpack_arrays(value, "<u4", "<u4")

    def put_together(parts: list, numbers: np.ndarray, sizes: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        lengths = np.concatenate([p[0] for p in parts]).astype(np.int64)
        flat = np.concatenate([p[1] for p in parts])
        starts = np.cumsum(lengths) - lengths
        ends = np.cumsum(sizes)

        def tokens() -> Iterator[np.ndarray]:
            for a, b in zip(ends - sizes, ends):
                units = numbers[a:b]
                size = lengths[units]
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield flat[np.repeat(starts[units], size) + within]

        return (finish or arrays)(ids, tokens())

    values = slabs.look_up(table, answer, n)
    return slabs.assemble(table, values, unpack, put_together, schema or f"doc_id {kind}, ids array<bigint>", n)


class Decoder:
    """Joins token ids with the table of token bytes; the table has one row per entry of the vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY):
        table = ranks(vocabulary)
        self._bytes = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self._bytes[rank] = token

    def __call__(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; NULL ids give a NULL text, invalid UTF-8 replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else decoder(np.array(ids, np.int64)).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``documents``.

    A NULL text is empty: no tokens, and the digests of nothing. Special tokens
    are ordinary text. Repeated rows give repeated results, rows without an id are
    encoded too, other columns are ignored, and an empty table gives no rows.
    """

    def digests(ids: pa.Array, tokens: Iterator[np.ndarray]) -> pa.RecordBatch:
        decoder, columns = Decoder(vocabulary), ([], [], [])
        for t in tokens:
            for column, x in zip(columns, (len(t), sha256(t.astype("<u4").tobytes()).hexdigest(), sha256(decoder(t)).hexdigest())):
                column.append(x)
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return encode(documents, vocabulary, digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
