"""Encoding of a corpus as token ids, token counts, and decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .bpe import Encoder, parse_ranks

VOCABULARY = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@cache
def _encoder(file: bytes) -> Encoder:
    return Encoder(parse_ranks(file))


def _vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The rank file, read on the driver (its size is that of the vocabulary)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens; ``offsets`` adds ``ends``, the byte offset behind each token.

    Empty and null texts have an empty list. Strings that look like special tokens are ordinary
    text. Whole texts of any length are encoded; repeated ids stay separate rows; other columns are
    not read. Rows are encoded where they are read, without a shuffle.
    """
    source = docs.select(doc_id, text)
    file = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value)
        for batch in batches:
            at = 0
            for ids, sizes in encoder.encode(_texts(batch.column(1))):
                borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns = [batch.column(0).slice(at, len(sizes)), pa.ListArray.from_arrays(borders, pa.array(ids.astype(np.int32)))]
                names = [doc_id, "ids"]
                if offsets:
                    ends = np.cumsum(encoder.widths[ids], dtype=np.int64)
                    base = np.concatenate([[0], ends])[borders[:-1]]
                    columns.append(pa.ListArray.from_arrays(borders, pa.array(ends - np.repeat(base, sizes))))
                    names.append("ends")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(sizes)

    kind = source.schema[doc_id].dataType.simpleString()
    return source.mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>" + (", ends array<bigint>" if offsets else ""))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; 0 for empty and null texts."""
    source = docs.select(doc_id, text)
    file = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value)
        for batch in batches:
            sizes = list(encoder.count(_texts(batch.column(1))))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64))], names=[doc_id, "n_tokens"])

    kind = source.schema[doc_id].dataType.simpleString()
    return source.mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) back from ids; null and empty lists give an empty text."""
    source = encoded.select(doc_id, ids)
    file = _vocabulary(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in _encoder(file.value).ranks.items()}
        for batch in batches:
            texts = [b"".join(tokens[i] for i in row or ()).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    kind = source.schema[doc_id].dataType.simpleString()
    return source.mapInArrow(run, f"`{doc_id}` {kind}, text string")
