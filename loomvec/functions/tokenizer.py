"""Texts to token ids and back by a tokenizer file of the user's, opened once in each worker.

A null text gives null lists, an empty one what the tokenizer makes of it. Nothing is
truncated. Padding to the longest of a batch is functions.sequences.pad_sequences,
whose batches are a column, so a result never depends on how Spark cuts the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomvec.errors import TokenizationError


@lru_cache(4)
def opened(path: str) -> Tokenizer:
    try:
        return Tokenizer.from_file(path)
    except Exception as e:  # the library raises the bare class
        raise TokenizationError(f"Tokenization error: {path}: {e}") from e


def vocab_size(path: str) -> int:
    """With special tokens."""
    return opened(path).get_vocab_size(with_added_tokens=True)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", mask_col: str = "attention_mask", add_special_tokens: bool = True) -> DataFrame:
    """df with token ids and a mask of ones as long."""
    schema = df.withColumn(ids_col, F.lit(None).cast("array<bigint>")).withColumn(mask_col, F.lit(None).cast("array<int>")).schema
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(at).to_pylist()
                found = iter(tokenizer.encode_batch([t for t in texts if t is not None], add_special_tokens=add_special_tokens))
                ids = [None if t is None else next(found).ids for t in texts]
                masks = [None if x is None else [1] * len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(masks, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded", skip_special_tokens: bool = True) -> DataFrame:
    """df with the text that the ids stand for."""
    schema = df.withColumn(out_col, F.lit(None).cast("string")).schema
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(path)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            found = iter(tokenizer.decode_batch([x for x in lists if x is not None], skip_special_tokens=skip_special_tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(found) for x in lists], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
