"""Layers for callers who bring weights, a batch of rows at a time in NumPy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pickle import loads

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


@lru_cache(1)
def erf_table() -> tuple[np.ndarray, np.ndarray]:
    """The error function and its slope at steps of 1/512 from 0 to 6."""
    x = np.arange(6 * 512 + 2) / 512
    return np.array([math.erf(v) for v in x]), 2 / math.sqrt(math.pi) * np.exp(-x * x) / 512


def erf(x: np.ndarray) -> np.ndarray:
    """The error function within 1e-12, by cubic interpolation of a table."""
    value, slope = erf_table()
    at = np.minimum(np.abs(x), 6.0) * 512
    i = at.astype(np.int64)
    t = at - i
    a, b, c, d = value[i], slope[i], value[i + 1], slope[i + 1]
    return np.copysign(a + t * (b + t * (3 * (c - a) - 2 * b - d + t * (b + d - 2 * (c - a)))), x)


def gelu(x: np.ndarray) -> np.ndarray:
    """By the error function."""
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * weight + bias


@dataclass(frozen=True)
class Linear:
    weight: np.ndarray
    bias: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.weight.T
        return out if self.bias is None else out + self.bias


@dataclass(frozen=True)
class ResidualMlp:
    """out(relu(hidden(x))) + residual(x)."""

    hidden: Linear
    out: Linear
    residual: Linear

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.out(relu(self.hidden(x))) + self.residual(x)


@dataclass(frozen=True)
class MaskedLanguageHead:
    """Scores over the vocabulary: dense layer, gelu, normalisation, decoder."""

    dense: Linear
    norm_weight: np.ndarray
    norm_bias: np.ndarray
    decoder: Linear

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.decoder(layer_norm(gelu(self.dense(x)), self.norm_weight, self.norm_bias))


def sent(spark: SparkSession, layer: Callable) -> Broadcast:
    """A layer, of whatever kind of function, once to each executor; loads() gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(layer))


def apply_rows(df: DataFrame, vector: str, layer: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """df with the layer's result of every row's vector. The layer is sent once to each
    executor; vectors are of one length, null ones give null."""
    held = sent(df.sparkSession, layer)
    schema = df.withColumn(out, F.lit(None).cast("array<double>")).schema
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_layer = loads(held.value)
        for batch in batches:
            column = batch.column(at)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            result: list = [None] * batch.num_rows
            if valid.any():
                own = column.filter(pa.array(valid))
                rows = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                for i, row in zip(np.flatnonzero(valid), own_layer(rows)):
                    result[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.list_(pa.float64()))], names=schema.names)

    return df.mapInArrow(run, schema)


def forecast_quantiles(series: DataFrame, values: str, config, encode: Callable[[np.ndarray], np.ndarray], out: str = "quantiles") -> DataFrame:
    """df with an array of steps by quantile levels.

    Each series of config.context_length values is scaled by its mean absolute value, cut into
    patches and given, as (rows, patches, patch_size), to `encode`, the caller's
    network, which answers (rows, steps * levels); its answer is scaled back. Another
    length is an error."""
    held = sent(series.sparkSession, encode)
    schema = series.withColumn(out, F.lit(None).cast("array<array<double>>")).schema
    at, levels = series.columns.index(values), len(config.quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = loads(held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(at).to_pylist()
            if any(r is None or len(r) != config.context_length for r in rows):
                raise ValueError(f"series have {config.context_length} values")
            x = np.array(rows, dtype=np.float64)
            scale = np.abs(x).mean(1, keepdims=True) + 1e-10
            answer = network((x / scale).reshape(len(x), -1, config.patch_size)) * scale
            nested = answer.reshape(len(x), config.prediction_length, levels).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nested, pa.list_(pa.list_(pa.float64())))], names=schema.names)

    return series.mapInArrow(run, schema)
