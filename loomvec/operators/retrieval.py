"""Corpus search: score, sort, top-k, compare.

Ties go to the smaller id, on scores that aren't rounded. The side meant to be
small is broadcast only where its bytes are counted and few; beyond, Spark
chooses the join. Scores that NumPy computes go block by block (operators.blocks) and
keep k candidates for each query and task before any shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.errors import ConfigError
from loomvec.operators import blocks
from loomvec.operators.blocks import Kind

#: Bytes of a broadcast side at most.
BROADCAST_BYTES = 256 << 20
#: Bytes that a row of a query counts as.
ROW_BYTES = 64 << 10
METRICS = ("dot", "cosine", "euclidean", "hamming")


def top_k(scored: DataFrame, k: int, query: str = "qid", doc: str = "did", score: str = "score", descending: bool = True) -> DataFrame:
    """The k best rows of each query with their rank. Spark cuts each partition to k before the shuffle."""
    by = F.col(score).desc() if descending else F.col(score).asc()
    rank = F.row_number().over(Window.partitionBy(query).orderBy(by, F.col(doc).asc()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs(queries: DataFrame, corpus: DataFrame, score: Column) -> DataFrame:
    """Every query with every document and its score, where all pairs are the result; for the best of them there is knn.

    The queries are sent to every task where their number times ROW_BYTES is at most BROADCAST_BYTES; beyond, partitions are joined with partitions."""
    small = queries.limit(BROADCAST_BYTES // ROW_BYTES + 1).count() * ROW_BYTES <= BROADCAST_BYTES
    return corpus.crossJoin(F.broadcast(queries) if small else queries.hint("shuffle_replicate_nl")).withColumn("score", score)


def similarity(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs, greater is closer."""
    if metric == "dot":
        return queries @ docs.T
    if metric == "cosine":
        n = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((docs**2).sum(1))[None, :]
        return np.where(n > 0, queries @ docs.T / np.where(n > 0, n, 1), 0.0)
    if metric == "euclidean":
        return -np.sqrt(np.maximum(((queries[:, None, :] - docs[None, :, :]) ** 2).sum(2), 0))
    if metric == "hamming":
        a, b = np.packbits(queries >= 0, axis=1), np.packbits(docs >= 0, axis=1)
        differing = sum(np.bitwise_count(a[:, i, None] ^ b[None, :, i]).astype(np.int32) for i in range(a.shape[1]))
        return (queries.shape[1] - differing).astype(np.float64)
    raise ConfigError(f"metric {metric!r} isn't one of {', '.join(METRICS)}")


def _sides(queries: DataFrame, corpus: DataFrame, vector: str, query: str, doc: str) -> list[DataFrame]:
    """id and vector of the rows that have both."""
    return [df.where(F.col(i).isNotNull() & F.col(vector).isNotNull()).select(F.col(i).cast("bigint").alias(i), F.col(vector).cast("array<double>").alias(vector)) for df, i in ((queries, query), (corpus, doc))]


def _kind(metric: str) -> Kind:
    if metric not in METRICS:
        raise ConfigError(f"metric {metric!r} isn't one of {', '.join(METRICS)}")
    return Kind({"cosine": "unit", "hamming": "bits"}.get(metric, metric))


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", vector: str = "embedding", query: str = "qid", doc: str = "did", exclude_same: bool = False, digits: int | None = None) -> DataFrame:
    """query, doc, score, rank: the k best documents of each query, by scores rounded to `digits` where given.

    Few queries are sent to every task; more meet the corpus block by block (operators.blocks). Rows with a null id or vector are left out."""
    found = blocks.nearest(*_sides(queries, corpus, vector, query, doc), _kind(metric), k, [query, doc, "score"], BROADCAST_BYTES, exclude_same, digits)
    return top_k(found, k, query, doc)


def all_scores(queries: DataFrame, corpus: DataFrame, metric: str = "dot", vector: str = "embedding", query: str = "qid", doc: str = "did", digits: int | None = None) -> DataFrame:
    """query, doc, score of all pairs, by matrix products, rounded to `digits` where given (Hamming scores are whole). For all pairs as a result; for the best of them
    there is knn. Any number of queries, in the same memory. Rows with a null id or vector are left out; euclidean scores are distances here."""
    return blocks.every(*_sides(queries, corpus, vector, query, doc), _kind(metric), [query, doc, "score"], BROADCAST_BYTES, digits)


def scores(queries: DataFrame, corpus: DataFrame, metric: str = "dot", vector: str = "embedding", query: str = "qid", doc: str = "did") -> DataFrame:
    """all_scores, but for Hamming scores of more than BROADCAST_BYTES of queries, which it refuses as it always did."""
    if metric == "hamming":
        n, width = _sides(queries, corpus, vector, query, doc)[0].agg(F.count("*"), F.max(F.size(vector))).first()
        if n and n * width * 8 > BROADCAST_BYTES:
            raise ConfigError(f"all pairs of more than {BROADCAST_BYTES} bytes of queries have no Hamming scores here; use knn or all_scores")
    return all_scores(queries, corpus, metric, vector, query, doc)


def rerank(queries: DataFrame, corpus: DataFrame, k: int, candidates: int, vector: str = "embedding", query: str = "qid", doc: str = "did") -> DataFrame:
    """Two stages: the best by Hamming similarity of signs, of these the k best by inner product (extension)."""
    found = blocks.nearest(*_sides(queries, corpus, vector, query, doc), _kind("hamming"), candidates, [query, doc, "score", "_dot"], BROADCAST_BYTES, then=True)
    first = top_k(found, candidates, query, doc).select(query, doc, F.col("_dot").alias("score"))
    return top_k(first, k, query, doc)


def overlap(a: DataFrame, b: DataFrame, query: str = "qid", doc: str = "did") -> DataFrame:
    """query, n_common, n_a: how many of a's answers b has too."""
    flagged = a.select(query, doc).join(b.select(query, doc).withColumn("_in", F.lit(1)), [query, doc], "left")
    return flagged.groupBy(query).agg(F.count("_in").alias("n_common"), F.count("*").alias("n_a"))


def same_answers(a: DataFrame, b: DataFrame, query: str = "qid", doc: str = "did") -> bool:
    """Whether both have the same documents for each query."""
    a, b = a.select(query, doc), b.select(query, doc)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def side_by_side(rankings: dict[str, DataFrame], query: str = "qid", doc: str = "did", score: str = "score") -> DataFrame:
    """A row for each query and rank with each ranking's document and score."""
    out = None
    for name, ranked in rankings.items():
        own = ranked.select(query, "rank", F.col(doc).alias(f"{name}_doc"), F.col(score).alias(f"{name}_score"))
        out = own if out is None else out.join(own, [query, "rank"], "full")
    if out is None:
        raise ConfigError("no rankings to compare")
    return out


def shortened(text: Column | str, n: int = 100, always: bool = False) -> Column:
    """The text's first n characters and three dots; without `always` a text that short stays."""
    text = F.col(text) if isinstance(text, str) else text
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)
