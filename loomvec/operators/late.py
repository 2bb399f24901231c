"""Late interaction: scores of documents by their token vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.functions.vectors import cosine, dot, total
from loomvec.operators import blocks
from loomvec.operators.blocks import Kind
from loomvec.operators.pooling import matrix
from loomvec.operators.retrieval import top_k

#: Bytes of queries that are sent to every task at most.
BLOCK_BYTES = 64 << 20


def maxsim(query: Column | str, doc: Column | str) -> Column:
    """For each query token the best inner product, summed. Empty sides are for the caller to leave out."""
    best = lambda q: F.array_max(F.transform(matrix(doc), lambda d: dot(q, d)))
    return total(F.transform(matrix(query), best))


def maxpair_cosine(query: Column | str, doc: Column | str) -> Column:
    """The one best cosine of any two tokens."""
    best = lambda q: F.array_max(F.transform(matrix(doc), lambda d: cosine(q, d)))
    return F.array_max(F.transform(matrix(query), best))


def maxsim_long(scores: DataFrame, query: str = "qid", doc: str = "did", token: str = "q_pos", score: str = "score") -> DataFrame:
    """The same from a row for each pair of tokens: a maximum, then a sum."""
    best = scores.groupBy(query, doc, token).agg(F.max(score).alias("best"))
    return best.groupBy(query, doc).agg(F.sum("best").alias(score))


def _sides(queries: DataFrame, corpus: DataFrame, query: str, doc: str, q_tokens: str, d_tokens: str) -> tuple[DataFrame, DataFrame]:
    """id and tokens of the rows that have some."""
    own = lambda df, i, t: df.where(F.col(i).isNotNull() & (F.size(t) > 0)).select(F.col(i).cast("bigint").alias(i), matrix(t).alias("tokens"))
    return own(queries, query, q_tokens), own(corpus, doc, d_tokens)


def maxsim_knn(queries: DataFrame, corpus: DataFrame, k: int, binary: bool = False, pair: bool = False, exclude_same: bool = False, query: str = "qid", doc: str = "did", q_tokens: str = "q", d_tokens: str = "d") -> DataFrame:
    """query, doc, score, rank: the k best documents of every query by maxsim, by its
    quantised form on sign bits (binary), or by maxpair_cosine (pair).

    Few queries are sent to every task; more meet the corpus block by block (operators.blocks), and a task
    keeps k documents a query. Empty and null token lists are left out."""
    kind = Kind("bits" if binary else "unit" if pair else "dot", pair)
    found = blocks.nearest(*_sides(queries, corpus, query, doc, q_tokens, d_tokens), kind, k, [query, doc, "score"], BLOCK_BYTES, exclude_same)
    return top_k(found, k, query, doc)


def maxsim_scores(queries: DataFrame, corpus: DataFrame, query: str = "qid", doc: str = "did", q_tokens: str = "q", d_tokens: str = "d", digits: int | None = None) -> DataFrame:
    """query, doc, score of all pairs by maxsim, as matrix products, rounded to `digits` where given. For all pairs as a result; for the best of them there is maxsim_knn."""
    return blocks.every(*_sides(queries, corpus, query, doc, q_tokens, d_tokens), Kind("dot"), [query, doc, "score"], BLOCK_BYTES, digits)
