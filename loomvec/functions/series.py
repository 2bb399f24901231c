"""Time series of numbers as Column expressions, and the forecast's configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.errors import ConfigError
from loomvec.functions.sequences import reshape
from loomvec.functions.vectors import col, doubles

LOW, HIGH = -10.0, 10.0


def series_scale(v: Column | str) -> Column:
    """Mean absolute value and a little, so that it is never 0."""
    v = doubles(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.nullif(F.size(v), F.lit(0)) + 1e-10


def scale_by_mean(v: Column | str) -> Column:
    """struct(scaled, scale)."""
    scale = series_scale(v)
    return F.struct(F.transform(doubles(v), lambda x: x / scale).alias("scaled"), scale.alias("scale"))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with pos, from 0 in order, and n, the length of their series."""
    own = Window.partitionBy(key)
    return rows.withColumn("pos", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count("*").over(own).cast("int"))


def scaled_rows(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """The rows of series with scaled: each value by the mean absolute value of its series, and a little."""
    return rows.withColumn("scaled", F.col(value) / (F.avg(F.abs(value)).over(Window.partitionBy(key)) + 1e-10))


def patch_rows(rows: DataFrame, size: int) -> DataFrame:
    """Numbered rows with patch and pos in the patch; the last n % size of a series are left out."""
    whole = rows.where(F.col("pos") < F.col("n") - F.col("n") % size)
    return whole.withColumn("patch", F.expr(f"cast(pos div {size} as int)")).withColumn("pos", F.col("pos") % size)


def tail_rows(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The last n rows of every series with so many, with pos from 0. Spark cuts each partition to n a series before the shuffle."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    last = rows.withColumn("_back", back).where(F.col("_back") <= n)
    whole = last.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") == n)
    return whole.withColumn("pos", F.lit(n) - F.col("_back")).drop("_back", "_n")


def patches(v: Column | str, size: int) -> Column:
    """Consecutive pieces of `size`; an error unless the length divides."""
    return reshape(v, size)


def to_bin(x: Column | str, n: int) -> Column:
    """The bin of a value among n over [-10, 10], outliers in the outermost."""
    clamped = F.least(F.greatest(col(x).cast("double"), F.lit(LOW)), F.lit(HIGH))
    return F.least(F.greatest(F.floor((clamped - LOW) / F.lit((HIGH - LOW) / n)), F.lit(0)), F.lit(n - 1)).cast("bigint")


def from_bin(b: Column | str, n: int) -> Column:
    """The middle of a bin."""
    width = (HIGH - LOW) / n
    return col(b).cast("double") * F.lit(width) + F.lit(LOW + width / 2)


def median_place(levels: tuple[float, ...]) -> int:
    """Which level is the median, else the middle one."""
    return next((i for i, q in enumerate(levels) if abs(q - 0.5) < 1e-6), len(levels) // 2)


def median_forecast(quantiles: Column | str, levels: tuple[float, ...]) -> Column:
    return F.element_at(col(quantiles), median_place(levels) + 1)


def quantile_statistics(q10: Column, q20: Column, q30: Column, q70: Column, q80: Column, q90: Column) -> list[Column]:
    """q25, q75, iqr and the width of the 80 % interval."""
    q25, q75 = (q20 + q30) / 2, (q70 + q80) / 2
    return [q25.alias("q25"), q75.alias("q75"), (q75 - q25).alias("iqr"), (q90 - q10).alias("pi80")]


def forecast_steps(forecast: Column | str, context: Column | str | int) -> Column:
    """array of (step, at, value): steps from 0, and their places on the axis, which go on after the context."""
    begin = F.lit(context) if isinstance(context, int) else col(context)
    return F.transform(col(forecast), lambda x, i: F.struct(i.alias("step"), (begin + i).alias("at"), x.alias("value")))


def key_steps(horizon: int) -> list[int]:
    """Start, quarters and end of a forecast."""
    return sorted({0, horizon // 4, horizon // 2, 3 * horizon // 4, horizon - 1})


@dataclass(frozen=True)
class ForecastConfig:
    """Sizes of a patch-based forecaster."""

    d_model: int = 512
    d_ff: int = 2048
    num_heads: int = 8
    layers: int = 6
    d_kv: int = 64
    vocab_size: int = 2
    dropout: float = 0.1
    context_length: int = 2048
    prediction_length: int = 64
    patch_size: int = 32
    num_bins: int = 4096
    quantiles: tuple[float, ...] = tuple(i / 10 for i in range(1, 10))

    @classmethod
    def small(cls) -> ForecastConfig:
        return cls()

    @classmethod
    def base(cls) -> ForecastConfig:
        return cls(d_model=768, d_ff=3072, num_heads=12, layers=12)

    @classmethod
    def custom(cls, context_length: int, prediction_length: int) -> ForecastConfig:
        return replace(cls.small(), context_length=context_length, prediction_length=prediction_length)

    @classmethod
    def for_model(cls, model_id: str) -> ForecastConfig:
        return cls.base() if "base" in model_id else cls.small()

    def validate(self) -> ForecastConfig:
        for name in ("d_model", "d_ff", "num_heads", "layers", "context_length", "prediction_length", "patch_size", "num_bins"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} is positive")
        if self.context_length < self.patch_size or self.context_length % self.patch_size:
            raise ConfigError(f"context_length {self.context_length} is a multiple of patch_size {self.patch_size}")
        if not self.quantiles or not all(0 < q < 1 for q in self.quantiles):
            raise ConfigError("quantiles lie between 0 and 1")
        return self
