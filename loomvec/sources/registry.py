"""The model registry as a DataFrame, its look-ups and its checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.errors import ConfigError, ModelNotFound, UnsupportedDimension
from loomvec.sources.registry_rows import LANGUAGES, ROWS

SCHEMA = (
    "registry_pos int, id string, model_type string, name string, huggingface_id string, organization string, release_date string, architecture_type string, architecture_variant string, "
    "has_projection boolean, projection_dims int, pooling struct<strategy:string,normalize:boolean>, parameters string, "
    "embedding_dim struct<default:int,min:int,max:int,supported:array<int>,strategy:string>, hidden_dim int, context_length int, max_position_embeddings int, vocab_size int, "
    "languages array<string>, modalities array<string>, multi_vector boolean, quantization array<string>, beir_avg double, ms_marco_mrr10 double, license string, description string"
)


@dataclass(frozen=True)
class ModelInfo:
    """One row; dimensions are (default, min, max, supported, strategy), min, max and strategy None where the dimension is fixed."""

    registry_pos: int
    id: str
    model_type: str
    name: str
    huggingface_id: str
    organization: str
    release_date: str
    architecture_type: str
    architecture_variant: str
    has_projection: bool
    projection_dims: int | None
    pooling: tuple[str, bool] | None
    parameters: str
    embedding_dim: tuple[int, int | None, int | None, list[int], str | None]
    hidden_dim: int
    context_length: int
    max_position_embeddings: int
    vocab_size: int
    languages: list[str]
    modalities: list[str]
    multi_vector: bool
    quantization: list[str]
    beir_avg: float
    ms_marco_mrr10: float
    license: str
    description: str

    @property
    def default_dim(self) -> int:
        return self.embedding_dim[0]

    @property
    def supported_dimensions(self) -> list[int]:
        return self.embedding_dim[3]

    @property
    def strategy(self) -> str | None:
        return self.embedding_dim[4]

    def supports_dimension(self, dim: int) -> bool:
        """Exact membership; a value in the range alone doesn't count."""
        return dim in self.supported_dimensions

    def dimension_text(self) -> str:
        if self.embedding_dim[1] is None:
            return str(self.default_dim)
        return f"{self.default_dim} (Matryoshka: {self.embedding_dim[1]}-{self.embedding_dim[2]})"


@lru_cache(1)
def rows() -> tuple[ModelInfo, ...]:
    out = []
    for pos, line in enumerate(ROWS.splitlines()):
        (id_, kind, name, hf, org, date, arch, variant, projection, pooling, size, dim, low, high, supported, strategy, hidden, context, positions, vocab, langs, modes, multi, quant, beir, mrr, license_) = line.split("|")
        number = lambda x: int(x) if x else None
        dims = (int(dim), number(low), number(high), [int(x) for x in supported.split()] or [int(dim)], strategy or None)
        about = f"{name}: {kind.lower()} model of {org}, {dim} dimensions"
        out.append(ModelInfo(pos, id_, kind, name, hf, org, date, arch, variant, bool(projection), number(projection), (pooling, True) if pooling else None, size, dims, int(hidden), int(context), int(positions), int(vocab), LANGUAGES.get(langs, langs).split(), modes.split(), bool(multi), quant.split(), float(beir), float(mrr), license_, about))
    return tuple(out)


def registry(spark: SparkSession) -> DataFrame:
    """All rows, in registry order by registry_pos."""
    return spark.createDataFrame([tuple(vars(r).values()) for r in rows()], SCHEMA)


def get_model(model_id: str) -> ModelInfo:
    """By id, letter case counting."""
    for r in rows():
        if r.id == model_id:
            return r
    raise ModelNotFound(model_id)


def model_by_huggingface_id(spark: SparkSession, hf_id: str) -> DataFrame:
    """The first row with that id; several share one."""
    return registry(spark).where(F.col("huggingface_id") == hf_id).orderBy("registry_pos").limit(1)


def models_by_type(models: DataFrame, kind: str) -> DataFrame:
    return models.where(F.col("model_type") == kind)


def models_by_organization(models: DataFrame, organization: str) -> DataFrame:
    """In any letter case."""
    return models.where(F.lower("organization") == organization.lower())


def models_by_language(models: DataFrame, language: str) -> DataFrame:
    return models.where(F.array_contains("languages", language))


def models_by_max_dim(models: DataFrame, most: int) -> DataFrame:
    return models.where(F.col("embedding_dim.default") <= most)


def matryoshka_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("embedding_dim.min").isNotNull())


def violations(models: DataFrame) -> DataFrame:
    """id, rule: every rule that a row breaks, none for a sound registry."""
    d = F.col("embedding_dim")
    flexible = d["min"].isNotNull()
    rules = {
        "embedding dimension is positive": d["default"] > 0,
        "minimum is below maximum": ~flexible | (d["min"] < d["max"]),
        "default lies in range": ~flexible | d["default"].between(d["min"], d["max"]),
        "supported dimensions lie in range": ~flexible | F.forall(d["supported"], lambda x: x.between(d["min"], d["max"])),
        "supported dimensions ascend": F.array_sort(d["supported"]) == d["supported"],
        "strategy is known": d["strategy"].isNull() | d["strategy"].isin("truncate_hidden", "truncate_output", "truncate_pooled"),
        "context length is positive": F.col("context_length") > 0,
        "repository id has a slash": F.col("huggingface_id").contains("/"),
        "projection has dimensions": ~F.col("has_projection") | F.col("projection_dims").isNotNull(),
        "projection gives the default dimension": F.col("projection_dims").isNull() | (F.col("projection_dims") == d["default"]),
        "pooling strategy is known": F.col("pooling").isNull() | F.lower("pooling.strategy").isin("mean", "cls", "max", "last_token"),
    }
    broken = F.filter(F.array(*(F.when(~ok, F.lit(rule)) for rule, ok in rules.items())), lambda x: x.isNotNull())
    repeated = models.groupBy("id").count().where("count > 1").select("id", F.lit("id is unique").alias("rule"))
    return models.select("id", F.explode(broken).alias("rule")).unionByName(repeated)


@dataclass(frozen=True)
class ModelConfig:
    """What a loaded model needs to know."""

    model_name: str
    embedding_dim: int
    max_seq_length: int
    target_dimension: int | None = None
    pooling_strategy: str | None = None
    normalize_embeddings: bool = False

    @classmethod
    def from_registry(cls, model_id: str, dimension: int | None = None) -> ModelConfig:
        info = get_model(model_id)
        if dimension is not None and not info.supports_dimension(dimension):
            raise UnsupportedDimension(model_id, dimension, info.supported_dimensions)
        if dimension is not None and dimension < 1:
            raise ConfigError("dimension is positive")
        pooling, normalize = info.pooling or (None, False)
        return cls(info.huggingface_id, dimension or info.default_dim, info.context_length, dimension, pooling, normalize)
