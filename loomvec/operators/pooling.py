"""Pooling of token vectors, nested (an array of vectors a row) and long (a row for each element).

A mask of ones and zeros tells the tokens that count. Nothing that counts gives zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.errors import ConfigError
from loomvec.functions.vectors import col, finish_dense

STRATEGIES = ("cls", "mean", "max", "last_token")


def matrix(tokens: Column | str) -> Column:
    return col(tokens).cast("array<array<double>>")


def zeros_like(tokens: Column) -> Column:
    return F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))


def kept(tokens: Column, mask: Column) -> Column:
    """The vectors whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: p["t"])


def cls(tokens: Column | str, mask: Column | str | None = None) -> Column:
    """The first vector, whatever the mask."""
    return F.element_at(matrix(tokens), 1)


def mean(tokens: Column | str, mask: Column | str) -> Column:
    tokens = matrix(tokens)
    own = kept(tokens, col(mask))
    summed = F.aggregate(own, zeros_like(tokens), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(F.size(own) > 0, F.transform(summed, lambda x: x / F.nullif(F.size(own), F.lit(0)))).otherwise(zeros_like(tokens))


def token_mean(tokens: Column | str) -> Column:
    """The mean of all vectors, whatever the mask."""
    tokens = matrix(tokens)
    return mean(tokens, F.transform(tokens, lambda v: F.lit(1)))


def maximum(tokens: Column | str, mask: Column | str) -> Column:
    tokens = matrix(tokens)
    own = kept(tokens, col(mask))
    most = F.aggregate(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), F.try_element_at(own, F.lit(1)), lambda s, v: F.zip_with(s, v, lambda a, b: F.greatest(a, b)))
    return F.coalesce(most, zeros_like(tokens))


def last_token(tokens: Column | str, mask: Column | str) -> Column:
    """The vector at the last 1 of the mask, the first where there is none."""
    tokens = matrix(tokens)
    places = F.filter(F.transform(col(mask), lambda m, i: F.when(m == 1, i + 1)), lambda i: i.isNotNull())
    return F.element_at(tokens, F.least(F.size(tokens), F.coalesce(F.array_max(places), F.lit(1))))


def pool(tokens: Column | str, mask: Column | str, strategy: str) -> Column:
    chosen = {"cls": cls, "mean": mean, "max": maximum, "last_token": last_token}.get(strategy.lower())
    if chosen is None:
        raise ConfigError(f"pooling strategy {strategy!r} isn't one of {', '.join(STRATEGIES)}")
    return chosen(tokens, mask)


def pool_dense(tokens: Column | str, mask: Column | str, strategy: str, size: int | None = None, normalize: bool = True) -> Column:
    """Pooled, truncated, normalised."""
    return finish_dense(pool(tokens, mask, strategy), size, normalize)


def pool_long(elements: DataFrame, strategy: str, doc: str = "doc_id", token: str = "tok_pos", dim: str = "dim_pos", value: str = "v", mask: str = "mask") -> DataFrame:
    """doc, dim, value out of rows for each element: one hash aggregation with a map-side part."""
    on = F.col(mask) == 1
    if strategy == "mean":
        out = F.coalesce(F.avg(F.when(on, F.col(value))), F.lit(0.0))
    elif strategy == "max":
        out = F.coalesce(F.max(F.when(on, F.col(value))), F.lit(0.0))
    elif strategy == "cls":
        out = F.min_by(value, token)
    elif strategy == "last_token":
        out = F.coalesce(F.max_by(F.when(on, F.col(value)), F.when(on, F.col(token))), F.min_by(value, token))
    else:
        raise ConfigError(f"pooling strategy {strategy!r} isn't one of {', '.join(STRATEGIES)}")
    return elements.groupBy(doc, dim).agg(out.alias(value))


def splade_pool(weights: DataFrame, doc: str = "doc_id", index: str = "index", value: str = "v", mask: str = "mask") -> DataFrame:
    """doc, index, weight: ln(1 + relu) and the greatest over the tokens that count; what stays at 0 is left out."""
    out = F.max(F.log1p(F.greatest(F.when(F.col(mask) != 0, F.col(value).cast("double")), F.lit(0.0))))
    return weights.groupBy(doc, index).agg(out.alias("weight")).where("weight > 1e-6")
