"""Token sequences, masks and sparse vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.functions.vectors import col, doubles


def pad(tokens: Column | str, width: Column | int, value: int = 0) -> Column:
    """The sequence filled with `value` to `width`."""
    tokens = col(tokens)
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(tokens, F.array_repeat(F.lit(value).cast("bigint"), F.greatest(width - F.size(tokens), F.lit(0))))


def pad_sequences(batches: DataFrame, tokens: str, batch: str, value: int = 0) -> DataFrame:
    """Every sequence filled to the longest of its batch."""
    width = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    return batches.withColumn("_width", width).withColumn(tokens, pad(tokens, F.col("_width"), value)).drop("_width")


def attention_mask(tokens: Column | str, value: int = 0) -> Column:
    """1 where a token isn't the padding value, so a true token of that value is masked too."""
    return F.transform(col(tokens), lambda x: (x != value).cast("int"))


def invert_mask(mask: Column | str) -> Column:
    return F.transform(col(mask), lambda x: (x != 1).cast("int"))


def valid_tokens(mask: Column | str) -> Column:
    return F.size(F.filter(col(mask), lambda x: x == 1))


def unpad(rows: Column | str, mask: Column | str) -> Column:
    """As many rows from the start as the mask has ones."""
    return F.slice(col(rows), 1, valid_tokens(mask))


def flatten_rows(rows: Column | str) -> Column:
    """A matrix row by row."""
    return F.flatten(col(rows))


def reshape(v: Column | str, width: int) -> Column:
    """Rows of `width`; an error unless the length divides."""
    v = col(v)
    rows = F.transform(F.sequence(F.lit(0), F.greatest((F.size(v) / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(v, i * width + 1, width))
    return F.when(F.size(v) % width == 0, F.when(F.size(v) == 0, F.slice(rows, 1, 0)).otherwise(rows)).otherwise(F.raise_error(F.format_string(f"length %d isn't a multiple of {width}", F.size(v))))


def tail(v: Column | str, n: int) -> Column:
    """The last n elements, all where there are fewer."""
    v = col(v)
    return F.slice(v, -F.least(F.lit(n), F.greatest(F.size(v), F.lit(1))), n)


def splade(x: Column | str) -> Column:
    """ln(1 + max(0, x))."""
    return F.log1p(F.greatest(col(x).cast("double"), F.lit(0.0)))


def sparse_pairs(v: Column | str, least: float = 1e-6) -> Column:
    """(index, weight) of the elements beyond the threshold in absolute value."""
    pairs = F.transform(doubles(v), lambda x, i: F.struct(i.alias("index"), x.alias("weight")))
    return F.filter(pairs, lambda p: F.abs(p["weight"]) > least)


def dense_vector(pairs: Column | str, vocab_size: int) -> Column:
    """The full vector of (index, weight) pairs; a later pair of an index wins, indices beyond the vocabulary are dropped."""
    own = F.filter(col(pairs), lambda p: (p["index"] >= 0) & (p["index"] < vocab_size))
    last = lambda i: F.element_at(F.concat(F.array(F.lit(0.0)), F.transform(F.filter(own, lambda p: p["index"] == i), lambda p: p["weight"].cast("double"))), -1)
    return F.transform(F.sequence(F.lit(0), F.lit(vocab_size - 1)), last)


def in_vocabulary(pairs: Column | str, vocab_size: int) -> Column:
    return F.forall(col(pairs), lambda p: (p["index"] >= 0) & (p["index"] < vocab_size))


def sparse_dot(a: Column | str, b: Column | str) -> Column:
    """Over the pairs of a, the weight times that of the first pair of b with its index."""
    first = lambda i: F.try_element_at(F.filter(col(b), lambda q: q["index"] == i), F.lit(1))["weight"]
    return F.aggregate(col(a), F.lit(0.0), lambda s, p: s + p["weight"].cast("double") * F.coalesce(first(p["index"]).cast("double"), F.lit(0.0)))


def sparsity(nnz: Column | str, vocab_size: int) -> Column:
    return 1.0 - col(nnz).cast("double") / float(vocab_size)
