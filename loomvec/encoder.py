"""Encoders: what turns texts into vectors.

An Encoder is anything with `transform(df, in_col, out_col)`. HashEncoder needs no
weights: each word's value in each dimension is a hash scaled to [-1, 1). Its
vectors are deterministic and carry no meaning beyond words in common.
OnnxEncoder runs a network that the user brings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.functions.vectors import col

#: What a word is: a run of letters of any script.
WORD = r"\p{L}+"
KINDS = ("dense", "multi", "sparse", "patch", "forecast")
#: Words that a Python worker handles at a time (one text may have more), and bytes of what it keeps of words seen.
WORDS_AT_ONCE, KNOWN_BYTES = 1 << 17, 64 << 20


class Encoder(Protocol):
    dimension: int
    kind: str

    def transform(self, df: DataFrame, in_col: str, out_col: str) -> DataFrame: ...


def words(text: Column | str) -> Column:
    """The runs of letters of the text in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"({WORD})"), F.lit(1))


def hash_value(word: Column, dim: int) -> Column:
    """A word's value in one dimension, in [-1, 1)."""
    number = F.conv(F.substring(F.md5(F.concat(word, F.lit(f":{dim}"))), 1, 8), 16, 10).cast("double")
    return number / 2147483648.0 - 1.0


@dataclass(frozen=True)
class HashEncoder:
    """kind "dense": the unit mean of the distinct words' vectors, zeros without words;
    "multi": a vector for each word in order; "sparse": (index, ln(1 + count)) of words hashed to `dimension` places."""

    dimension: int = 64
    kind: str = "dense"

    def token_vectors(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda w: F.array(*(hash_value(w, d) for d in range(self.dimension))))

    def transform(self, df: DataFrame, in_col: str, out_col: str) -> DataFrame:
        found = words(in_col)
        if self.kind == "multi":
            return df.withColumn(out_col, self.token_vectors(found))
        if self.kind == "sparse":
            return _mapped(df, found, out_col, "array<struct<index:bigint,weight:double>>", 32, lambda lists, known: counted_places(lists, self.dimension, known))
        return _mapped(df, F.array_distinct(found), out_col, "array<double>", 40 + 8 * self.dimension, lambda lists, known: mean_vectors(lists, self.dimension, known))


class Known:
    """What was computed of words seen lately, in two generations: frequent words stay, and both take KNOWN_BYTES at most."""

    def __init__(self, value_bytes: int):
        self.most, self.new, self.old = max(1024, KNOWN_BYTES // (2 * (200 + value_bytes))), {}, {}

    def values(self, words: list[str], compute) -> list:
        """Of each word; compute makes a list of them for those that aren't known."""
        out = [self.new.get(w, self.old.get(w)) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(missing, compute([words[i] for i in missing])):
            out[i] = x
        self.new.update(zip(words, out))
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new if len(self.new) <= 2 * self.most else {}
        return out


def _mapped(df: DataFrame, listed: Column, out_col: str, kind: str, value_bytes: int, encode) -> DataFrame:
    """df with encode(word lists, a store of words seen) as out_col. value_bytes: of what is stored of a word."""
    schema = df.drop(out_col).withColumn(out_col, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(value_bytes)
        for batch in batches:
            for part in sliced(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], encode(part.column(part.num_columns - 1), known)], names=schema.names)

    return df.withColumn(f"_{out_col}_words", listed).drop(out_col).mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists in column `at` have WORDS_AT_ONCE words together, or one row."""
    ends = np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS_AT_ONCE, side="right")))
        yield batch.slice(a, b - a)
        a = b


def counted_places(lists: pa.ListArray, dimension: int, known: Known) -> pa.Array:
    """(index, ln(1 + count)) of each list's words hashed to `dimension` places, in order of index."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    own = found.dictionary.to_pylist()
    table = np.array(known.values(own, lambda new: [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimension for w in new]), dtype=np.int64)
    keys, counts = np.unique(np.repeat(np.arange(len(n)), n) * dimension + table[found.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(keys // dimension, minlength=len(n)))]).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(keys % dimension), pa.array(np.log1p(counts))], names=["index", "weight"])
    return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=lists.is_null())


def hashed_rows(words: list[str], dimension: int) -> list[bytes]:
    """hash_value of each word in all dimensions, as bytes of doubles."""
    ends = [f":{d}".encode() for d in range(dimension)]
    digests = b"".join(hashlib.md5(w + e).digest() for w in map(str.encode, words) for e in ends)
    rows = np.frombuffer(digests, ">u4")[::4].astype(np.float64) / 2147483648.0 - 1.0
    return [rows[i : i + dimension].tobytes() for i in range(0, len(rows), dimension)]


def mean_vectors(lists: pa.ListArray, dimension: int, known: Known) -> pa.Array:
    """The unit mean of each list's words, zeros without words. Frequent words
    are hashed once."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    own = found.dictionary.to_pylist()
    table = np.frombuffer(b"".join(known.values(own, lambda new: hashed_rows(new, dimension)))).reshape(-1, dimension)
    sums = np.zeros((len(n), dimension))
    row, word = np.repeat(np.arange(len(n)), n), found.indices.to_numpy(zero_copy_only=False)
    for d in range(dimension):
        sums[:, d] = np.bincount(row, table[word, d], minlength=len(n))
    means = sums / np.maximum(n, 1)[:, None]
    norm = np.sqrt((means * means).sum(1, keepdims=True))
    unit = np.where(norm > 0, means / np.where(norm > 0, norm, 1), means)
    offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * dimension)
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()), mask=lists.is_null())


@dataclass(frozen=True)
class OnnxEncoder:
    """A network in an ONNX file with a tokenizer file beside it, opened once in each worker.

    Inputs are input_ids and attention_mask, the first output the token vectors.
    kind "dense" pools their mean and normalises; "multi" keeps those of true tokens."""

    model_path: str
    tokenizer_path: str
    dimension: int
    kind: str = "dense"

    def transform(self, df: DataFrame, in_col: str, out_col: str) -> DataFrame:
        inner = pa.list_(pa.float32()) if self.kind == "dense" else pa.list_(pa.list_(pa.float32()))
        schema = df.withColumn(out_col, F.lit(None).cast("array<float>" if self.kind == "dense" else "array<array<float>>")).schema
        at = df.columns.index(in_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import onnxruntime
            from tokenizers import Tokenizer

            session = onnxruntime.InferenceSession(self.model_path)
            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_padding()
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                out: list = []
                for i in range(0, len(texts), 32):
                    encoded = tokenizer.encode_batch(texts[i : i + 32])
                    mask = np.array([e.attention_mask for e in encoded], dtype=np.int64)
                    hidden = session.run(None, {"input_ids": np.array([e.ids for e in encoded], dtype=np.int64), "attention_mask": mask})[0]
                    if self.kind == "dense":
                        pooled = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
                        n = np.linalg.norm(pooled, axis=1, keepdims=True)
                        out += list(np.where(n > 0, pooled / np.where(n > 0, n, 1), pooled).astype(np.float32))
                    else:
                        out += [h[m == 1].astype(np.float32).tolist() for h, m in zip(hidden, mask)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, inner)], names=schema.names)

        return df.mapInArrow(run, schema)
