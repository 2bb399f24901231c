"""Quantised vectors as Column expressions.

Binary: one bit for each dimension, set where the value is at least 0, packed
eight to a byte from the lowest bit; bytes are ints from 0 to 255, so that counting bits
needs no care for signs. int8 and int4 are extensions of this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomvec.errors import QuantizationError
from loomvec.functions.vectors import col, doubles, let


def pack_bits(v: Column | str) -> Column:
    """The bytes of a binary-quantised vector; NaN counts as negative."""
    v = doubles(v)
    bits = F.transform(v, lambda x, i: F.when(~F.isnan(x) & (x >= 0), F.call_function("shiftleft", F.lit(1), (i % 8).cast("int"))).otherwise(0))
    count = F.ceil(F.size(v) / 8).cast("int")
    return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.aggregate(F.slice(bits, b * 8 + 1, 8), F.lit(0), lambda s, x: s + x))
    )


def unpack_bits(data: Column | str, dim: Column | int) -> Column:
    """1.0 and -1.0 for each of `dim` bits."""
    data, dim = col(data), F.lit(dim) if isinstance(dim, int) else dim
    at = F.sequence(F.lit(0), F.greatest(dim - 1, F.lit(0)))
    bit = lambda data, i: F.try_element_at(data, (F.floor(i / 8) + 1).cast("int")).bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (i % 8 + 1).cast("int")))
    return F.when(dim > 0, let(data, lambda d: F.transform(at, lambda i: F.when(bit(d, i) > 0, 1.0).otherwise(-1.0)))).otherwise(F.array().cast("array<double>"))


def hamming_similarity(a: Column | str, b: Column | str, dim: Column | int, other_dim: Column | int | None = None) -> Column:
    """Dimensions with equal signs; 0 where the dimensions differ."""
    a, b = col(a), col(b)
    dim = F.lit(dim) if isinstance(dim, int) else dim
    other = dim if other_dim is None else F.lit(other_dim) if isinstance(other_dim, int) else other_dim
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(dim == other, (dim - differing).cast("double")).otherwise(0.0)


def quantize_tokens(tokens: Column | str) -> Column:
    """pack_bits of every token vector."""
    return F.transform(col(tokens), pack_bits)


def quantized_maxsim(query: Column | str, doc: Column | str, dim: int) -> Column:
    """For each query token the best Hamming similarity, summed; -infinity for a document without tokens, 0 for a query without."""
    best = lambda q: F.coalesce(F.array_max(F.transform(col(doc), lambda d: hamming_similarity(q, d, dim))), F.lit(float("-inf")))
    return F.aggregate(F.transform(col(query), best), F.lit(0.0), lambda s, x: s + x)


def memory_bytes(n_vectors: Column | int, dim: Column | int) -> Column:
    """Bytes of so many binary vectors."""
    n, dim = (F.lit(x) if isinstance(x, int) else x for x in (n_vectors, dim))
    return (n * F.ceil(dim / 8)).cast("bigint")


def compression_ratio(n_vectors: Column | int, dim: Column | int) -> Column:
    """Bytes as float32 by bytes as bits; 0 where there are none."""
    n, d = (F.lit(x) if isinstance(x, int) else x for x in (n_vectors, dim))
    held = memory_bytes(n, d)
    return F.coalesce(F.try_divide((n * d * 4).cast("double"), held.cast("double")), F.lit(0.0))


def int8_quantize(v: Column | str, low: Column, high: Column) -> Column:
    """struct(values, scale, offset) from the calibrated range of all dimensions (extension)."""
    scale = F.when(high > low, (high - low) / 255.0).otherwise(1.0)
    values = F.transform(doubles(v), lambda x: (F.least(F.greatest(F.rint((x - low) / scale), F.lit(0.0)), F.lit(255.0)) - 128).cast("tinyint"))
    return F.struct(values.alias("values"), scale.alias("scale"), low.alias("offset"))


def int8_dequantize(q: Column | str) -> Column:
    return let(col(q), lambda q: F.transform(q["values"], lambda x: (x.cast("double") + 128) * q["scale"] + q["offset"]))


def int4_quantize(v: Column | str, group_size: int = 32) -> Column:
    """struct(values, scales, offsets): groups with a range each, two values a byte, the first in the high half (extension)."""
    if group_size < 2 or group_size % 2:
        raise QuantizationError("group_size is even and at least 2")
    v = doubles(v)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / group_size).cast("int") - 1, F.lit(0))), lambda g: F.slice(v, g * group_size + 1, group_size))
    ranges = F.transform(groups, lambda g: F.struct(g.alias("v"), F.array_min(g).alias("low"), F.array_max(g).alias("high")))
    step = lambda g: F.when(g["high"] > g["low"], (g["high"] - g["low"]) / 15.0).otherwise(1.0)
    scaled = F.transform(ranges, lambda g: F.struct(g["v"].alias("v"), g["low"].alias("low"), step(g).alias("step")))
    coded = lambda g: F.transform(g["v"], lambda x: F.rint((x - g["low"]) / g["step"]).cast("int"))
    packed = lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / 2).cast("int") - 1), lambda b: F.element_at(c, b * 2 + 1) * 16 + F.coalesce(F.try_element_at(c, b * 2 + 2), F.lit(0)))
    parts = lambda s: F.struct(let(F.flatten(F.transform(s, coded)), packed).alias("values"), F.transform(s, lambda g: g["step"]).alias("scales"), F.transform(s, lambda g: g["low"]).alias("offsets"))
    return let(scaled, parts)


def int4_dequantize(q: Column | str, dim: int, group_size: int = 32) -> Column:
    byte = lambda q, i: F.element_at(q["values"], (F.floor(i / 2) + 1).cast("int"))
    code = lambda q, i: F.when(i % 2 == 0, F.floor(byte(q, i) / 16)).otherwise(byte(q, i) % 16)
    at = lambda i: (F.floor(i / group_size) + 1).cast("int")
    return let(col(q), lambda q: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: code(q, i) * F.element_at(q["scales"], at(i)) + F.element_at(q["offsets"], at(i))))
