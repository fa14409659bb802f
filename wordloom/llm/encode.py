"""The corpus as token ids of a public tokenizer (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from wordloom.llm.bpe import BytePairEncoder, encoder
from wordloom.llm.points import chunks

#: Place of the tokenizer file, the same on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: After a letter that no letter and no white space follows a word always begins.
BORDER = regex.compile(r"\p{L}(?=[^\s\p{L}])")


def _encoded(own: BytePairEncoder, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, texts, their ids one after the other and the texts' bounds, slice by slice; of
    a very long text the parts are encoded apart."""
    for first, part, starts in chunks(text, BORDER):
        if len(starts) > 1 and starts[1] > 0:
            found = [own.encode(part.slice(k, 1))[0] for k in range(len(part))]
            ids = np.concatenate(found)
            yield first, 1, ids, np.array([0, len(ids)])
        else:
            ids, bounds = own.encode(part)
            yield first, len(part), ids, bounds


def encode_corpus(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and ids (array of int, without special tokens) of every document.

    A null or empty text gives an empty list, a blank one the tokens of its white space;
    names of special tokens in a text are ordinary text.  Repeated rows are encoded each,
    other columns are ignored.  One pass over the text, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for first, count, ids, bounds in _encoded(own, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {_type(documents)}, ids array<int>")


def decode_corpus(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and text of every row of ids, the inverse of encode_corpus(); null and empty ids give an
    empty text.  Ids that spell no UTF-8 are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            data, bounds = own.decode(np.asarray(lists.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.large_string()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_type(encoded)}, text string")


def count_tokens(documents: DataFrame, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of each document and ``tokens``, its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            sizes = [np.diff(bounds) for _, _, _, bounds in _encoded(own, batch.column(0))]
            tokens = pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], tokens], [*keep, "tokens"])

    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "tokens bigint"])
    return documents.select("text", *keep).mapInArrow(run, schema)


def _type(documents: DataFrame) -> str:
    return dict(documents.dtypes)["doc_id"]
