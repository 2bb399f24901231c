"""Embedders: a model of the registry, an encoder and the operators that go with them.

No weights come with this package. An embedder is built with an encoder of the
caller's; without one it takes the HashEncoder of the model's dimension, which tells
words in common and nothing else. Encoding works on DataFrames and is lazy; the
similarities are Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.encoder import Encoder, HashEncoder
from loomvec.errors import ConfigError, DeviceError, QuantizationError, UnsupportedDimension
from loomvec.functions import quantization, sequences, vectors
from loomvec.functions.series import ForecastConfig, median_forecast
from loomvec.operators import late, neural
from loomvec.sources.registry import ModelConfig, ModelInfo, get_model

NO_QUANTIZER = "No quantizer configured; build the embedder with quantization='binary'"


@dataclass(frozen=True)
class Builder:
    """Settings of an embedder, each step a copy."""

    target: type
    model_id: str | None = None
    chosen_dimension: int | None = None
    chosen_quantization: str | None = None
    chosen_encoder: Encoder | None = None
    rows_per_batch: int | None = None

    def model(self, model_id: str) -> Builder:
        return replace(self, model_id=model_id)

    def dimension(self, dim: int) -> Builder:
        return replace(self, chosen_dimension=dim)

    def quantization(self, kind: str | None) -> Builder:
        return replace(self, chosen_quantization=kind)

    def encoder(self, encoder: Encoder) -> Builder:
        return replace(self, chosen_encoder=encoder)

    def device(self, name: str) -> Builder:
        """Executors compute on processors; another device is an error."""
        if name.lower() != "cpu":
            raise DeviceError(f"Device error: {name!r} isn't available; encoders run on the executors' processors")
        return self

    def yield_ms(self, pause: int) -> Builder:
        """Accepted for callers that set it; Spark schedules the batches and no pause is made."""
        if pause < 0:
            raise ConfigError("yield_ms isn't negative")
        return self

    def batch_size(self, rows: int) -> Builder:
        """Rows of an Arrow batch; takes effect on the session that encodes."""
        return replace(self, rows_per_batch=rows)

    def build(self) -> Any:
        if self.model_id is None:
            raise ConfigError(self.target.MISSING)
        info = get_model(self.model_id)
        if self.target.MODEL_TYPES and info.model_type not in self.target.MODEL_TYPES:
            raise ConfigError(f"Model '{info.id}' is a {info.model_type} model, not {' or '.join(self.target.MODEL_TYPES)}")
        dim = self.chosen_dimension
        if dim is not None and not info.supports_dimension(dim):
            raise UnsupportedDimension(info.id, dim, info.supported_dimensions)
        if self.chosen_quantization in ("int8", "int4"):
            raise QuantizationError(f"{self.chosen_quantization} is not yet implemented for embedders")
        if self.chosen_quantization not in (None, "none", "binary"):
            raise ConfigError(f"quantization {self.chosen_quantization!r} is unknown")
        return self.target(info, dim, self.chosen_quantization == "binary", self.chosen_encoder, self.rows_per_batch)


class Embedder:
    MODEL_TYPES: tuple[str, ...] = ()
    MISSING = "Model ID must be specified"
    KIND = "dense"

    def __init__(self, info: ModelInfo, dim: int | None = None, binary: bool = False, encoder: Encoder | None = None, rows_per_batch: int | None = None):
        self.info, self.target_dimension, self.binary, self.rows_per_batch = info, dim, binary, rows_per_batch
        self.config = ModelConfig.from_registry(info.id, dim)
        self.network = encoder or HashEncoder(self.native_dimension(), self.KIND)

    @classmethod
    def new(cls, model_id: str):
        return cls.builder().model(model_id).build()

    @classmethod
    def builder(cls) -> Builder:
        return Builder(cls)

    def native_dimension(self) -> int:
        return self.info.default_dim

    def dimension(self) -> int:
        return self.target_dimension or self.info.default_dim

    def model(self) -> str:
        return self.info.id

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """df with the vectors of a text column; a null text gives null."""
        if self.rows_per_batch:
            df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(self.rows_per_batch))
        return self.network.transform(df, text_col, out_col).withColumn(out_col, F.when(F.col(text_col).isNotNull(), self.finish(F.col(out_col))))

    encode_batch = encode

    def finish(self, v: Column) -> Column:
        return v


class DenseEmbedder(Embedder):
    MODEL_TYPES = ("Dense",)

    def finish(self, v: Column) -> Column:
        return vectors.finish_dense(v, self.target_dimension, self.config.normalize_embeddings)

    def similarity(self, a: Column | str, b: Column | str) -> Column:
        """The inner product, which for unit vectors is the cosine."""
        return vectors.dot(a, b)


class MultiVectorEmbedder(Embedder):
    """Any model type, as late interaction needs token vectors alone."""

    KIND = "multi"

    def finish(self, v: Column) -> Column:
        size = self.target_dimension
        return v if size is None else F.transform(v, lambda t: vectors.truncate(t, size))

    def similarity(self, query: Column | str, doc: Column | str) -> Column:
        return late.maxsim(query, doc)

    def quantize(self, tokens: Column | str) -> Column:
        """struct(quantized, original_dim, num_tokens)."""
        if not self.binary:
            raise QuantizationError(NO_QUANTIZER)
        tokens = vectors.col(tokens)
        dim = F.coalesce(F.size(F.try_element_at(tokens, F.lit(1))), F.lit(0))
        return F.struct(quantization.quantize_tokens(tokens).alias("quantized"), dim.alias("original_dim"), F.size(tokens).alias("num_tokens"))

    def encode_quantized(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        return self.encode(df, text_col, out_col).withColumn(out_col, self.quantize(out_col))

    def similarity_quantized(self, query: Column | str, doc: Column | str) -> Column:
        if not self.binary:
            raise QuantizationError(NO_QUANTIZER)
        query, doc = vectors.col(query), vectors.col(doc)
        return quantization.quantized_maxsim(query["quantized"], doc["quantized"], self.dimension())


class SparseEmbedder(Embedder):
    MODEL_TYPES = ("Sparse",)
    KIND = "sparse"

    def native_dimension(self) -> int:
        return self.info.vocab_size

    def vocab_size(self) -> int:
        return self.info.vocab_size

    def similarity(self, a: Column | str, b: Column | str) -> Column:
        return sequences.sparse_dot(a, b)


class VisionEmbedder(Embedder):
    """Pages are patch vectors, queries token vectors; an image encoder is the caller's to bring."""

    MODEL_TYPES = ("VisionLanguage",)
    MISSING = "Model ID is required"
    KIND = "multi"
    IMAGE, PATCH = 448, 14

    def num_patches(self) -> int:
        return (self.IMAGE // self.PATCH) ** 2

    def encode_document(self, images: DataFrame, image_encoder: Encoder, in_col: str = "pixels", out_col: str = "embedding") -> DataFrame:
        """df with the first num_patches vectors of each image, unit length."""
        found = image_encoder.transform(images, in_col, out_col)
        return found.withColumn(out_col, F.transform(F.slice(out_col, 1, self.num_patches()), lambda t: vectors.l2_normalize(t)))

    def encode_query(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        return self.encode(df, text_col, out_col).withColumn(out_col, F.transform(out_col, lambda t: vectors.l2_normalize(t)))

    def search(self, query: Column | str, document: Column | str) -> Column:
        return late.maxsim(query, document)

    search_document = search

    def embedding_dim(self) -> int:
        return self.dimension()


class TimeSeriesEmbedder(Embedder):
    MODEL_TYPES = ("Timeseries",)
    MISSING = "Model ID is required"
    SUPPORTED = ("chronos-bolt-small",)

    def __init__(self, info: ModelInfo, *settings):
        if info.id not in self.SUPPORTED:
            raise ConfigError(f"Model '{info.id}' isn't one of {', '.join(self.SUPPORTED)}")
        super().__init__(info, *settings)
        self.forecasting = ForecastConfig.for_model(info.id).validate()

    def prediction_length(self) -> int:
        return self.forecasting.prediction_length

    def context_length(self) -> int:
        return self.forecasting.context_length

    def quantiles(self) -> tuple[float, ...]:
        return self.forecasting.quantiles

    def forecast_quantiles(self, series: DataFrame, network, values: str = "values", out_col: str = "quantiles") -> DataFrame:
        """Steps by quantile levels of each series; `network` maps patches to scaled answers."""
        return neural.forecast_quantiles(series, values, self.forecasting, network, out_col)

    def forecast(self, series: DataFrame, network, values: str = "values", out_col: str = "forecast") -> DataFrame:
        """The median of each step."""
        found = self.forecast_quantiles(series, network, values, "_quantiles")
        return found.withColumn(out_col, F.transform("_quantiles", lambda q: median_forecast(q, self.forecasting.quantiles))).drop("_quantiles")


def embedder(model_id: str) -> Embedder:
    """The embedder of a model's type."""
    info = get_model(model_id)
    kinds = {"Dense": DenseEmbedder, "Colbert": MultiVectorEmbedder, "Sparse": SparseEmbedder, "VisionLanguage": VisionEmbedder, "Timeseries": TimeSeriesEmbedder}
    if info.model_type not in kinds:
        raise ConfigError(f"{info.model_type} models have no embedder")
    return kinds[info.model_type].new(model_id)
