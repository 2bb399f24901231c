"""Column expressions on vectors: arrays of numbers, computed in double.

All stay in the JVM. Vectors of different lengths are an error, as is a
truncation beyond the length; a null vector gives null."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomvec.errors import MatryoshkaError


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, where body has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def same_length(a: Column, b: Column, value: Column) -> Column:
    """value, or an error where the lengths differ."""
    message = F.format_string("Dimension mismatch: expected %d, got %d", F.size(a), F.size(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(value)


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = doubles(a), doubles(b)
    return same_length(a, b, total(F.zip_with(a, b, lambda x, y: x * y)))


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column | str, norm: Column | None = None) -> Column:
    """The unit vector; zeros stay zeros. Pass a column of norms to compute them once."""
    v = doubles(v)
    n = l2_norm(v) if norm is None else norm
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / F.nullif(n, F.lit(0.0))).otherwise(dot(a, b))


def euclidean(a: Column | str, b: Column | str) -> Column:
    a, b = doubles(a), doubles(b)
    return same_length(a, b, F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def is_finite(v: Column | str) -> Column:
    """Whether no element is NaN or infinite."""
    return F.forall(doubles(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def require_finite(v: Column | str) -> Column:
    """v, or an error where an element is NaN or infinite."""
    v = col(v)
    return F.when(v.isNull() | is_finite(v), v).otherwise(F.raise_error(F.lit("embedding contains NaN or infinite values")))


class TruncationStage(Enum):
    """When a model shortens its vectors: before projection, after it, or after pooling."""

    HIDDEN = "truncate_hidden"
    OUTPUT = "truncate_output"
    POOLED = "truncate_pooled"

    @classmethod
    def parse(cls, name: str) -> TruncationStage:
        try:
            return cls(name)
        except ValueError:
            raise MatryoshkaError(f"unknown strategy {name!r}") from None


def truncate(v: Column | str, size: int) -> Column:
    """The first `size` elements; an error where there are fewer or size isn't positive."""
    if size < 1:
        raise MatryoshkaError(f"target dimension {size} isn't positive")
    v = col(v)
    message = F.format_string(f"Matryoshka truncation error: target {size} exceeds dimension %d", F.size(v))
    return F.when(v.isNull() | (F.size(v) >= size), F.slice(v, 1, size)).otherwise(F.raise_error(message))


def finish_dense(v: Column | str, size: int | None = None, normalize: bool = True) -> Column:
    """A pooled vector truncated, then normalised."""
    v = doubles(v) if size is None else truncate(doubles(v), size)
    return l2_normalize(v) if normalize else v


def truncate_and_project(v: Column | str, size: int | None, stage: TruncationStage | None, weights: list[list[float]] | None) -> Column:
    """A token vector through an optional projection, shortened before or after it as the stage says.

    weights has a row for each output; with stage HIDDEN its rows are as long as the shortened vector."""
    v = doubles(v)
    if size is not None and stage is TruncationStage.HIDDEN:
        v = truncate(v, size)
    if weights is not None:
        v = linear(v, weights)
    if size is not None and stage in (TruncationStage.OUTPUT, TruncationStage.POOLED):
        v = truncate(v, size)
    return v


def linear(v: Column | str, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """weights @ v + bias for small weights; large ones belong in loomvec.operators.neural."""
    v = doubles(v)
    out = [dot(v, F.array(*map(F.lit, map(float, row)))) + F.lit(float(bias[i]) if bias else 0.0) for i, row in enumerate(weights)]
    return F.array(*out)
