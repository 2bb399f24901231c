"""Exact top-k search by tiled matrix products.

Queries and vectors are dealt into about equal tiles, each packed into one row. Every
task holds tiles of queries and shards, multiplies them, keeps each query's best
k of the product and folds them into what it has; the lists of different tasks
are merged in a tree of groupings, so no step ever holds more than
`fan` lists of a query tile.

Scores are inner products in double precision, rounded to `digits`; ties go to
the smaller id. Defined results: rows with a null id, a null or empty vector or one
with a null, NaN or infinity are no candidates and no queries; repeated rows are candidates
and queries each; a vector of another length is an error, as is an id column that holds no
integers; fewer than k candidates give shorter lists; an empty table or query set gives no rows. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from loomvec.llm.tiles import best, packed, searched, unfolded, usable


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = 2048, digits: int = 6, fan: int = 8) -> DataFrame:
    """query_id, rank, neighbor_id, score: the k nearest others in `vectors` of every row of `queries`,
    of every vector where none are given. A row is not its own neighbour, nor is any row with its id."""
    shards = packed(usable(vectors, id_col, vector_col), tile_rows)
    asked = shards if queries is None else packed(usable(queries, id_col, vector_col), tile_rows)

    def product(q_id: np.ndarray, q: np.ndarray, s_id: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = np.round(q @ s.T, digits) + 0.0
        scores[q_id[:, None] == s_id[None, :]] = -np.inf
        return best(np.broadcast_to(s_id, scores.shape), scores, k)

    return unfolded(searched(asked, shards, product, k, fan))


ORACLE = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id,
         round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) + 0.0 AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) + 0.0 DESC, d.vec_id) AS rank
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
WHERE rank <= 10"""
