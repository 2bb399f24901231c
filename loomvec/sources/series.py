"""Series and corpora made up for demonstrations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("sales", "stock", "temperature", "energy")


def synthetic(spark: SparkSession, kind: str, n: int = 2048, seed: int = 42) -> DataFrame:
    """t and value of n steps: seasonal sales, a stock's random walk, daily temperature, two cycles of energy use."""
    steps = spark.range(0, n, 1, 1).select(F.col("id").alias("t"))
    noise = F.randn(seed)
    wave = lambda period: F.sin(F.lit(2 * math.pi / period) * F.col("t"))
    if kind == "sales":
        value = 100 + 0.05 * F.col("t") + 20 * wave(365) + 5 * noise
    elif kind == "stock":
        walk = steps.withColumn("r", 0.0005 + 0.02 * noise)
        total = F.sum("r").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return walk.select("t", (100 * F.exp(total)).alias("value"))
    elif kind == "temperature":
        value = 15 + 10 * wave(365) + 3 * wave(24) + noise
    elif kind == "energy":
        value = 500 + 100 * wave(24) + 50 * wave(168) + 20 * noise
    else:
        raise ValueError(f"kind {kind!r} isn't one of {', '.join(KINDS)}")
    return steps.select("t", value.alias("value"))


def labelled(spark: SparkSession, by_category: dict[str, list[str]]) -> DataFrame:
    """doc_id, text, category of lists of sentences, numbered in order."""
    rows = [(text, category) for category, texts in by_category.items() for text in texts]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, category string")
