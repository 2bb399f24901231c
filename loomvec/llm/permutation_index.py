"""Approximate nearest neighbours by permutation index.

A vector is represented by the order in which it meets the pivots, nearest first.
The index is dealt into shards; in each, a vector is posted in the inverted files of its first POSTED
pivots. A query opens the files of its first PROBED pivots, ranks what is posted there by footrule
distance of the two orders (the sum of the differences of all pivots' places), and reranks
the best of them, one in SHARE of the shard's rows and at least LEAST, by their vectors.
Lists of shards are merged in a tree. Only blocks of queries travel to shards; no vector is sent more
than once however many files it is posted in.

All that tie with the last candidate reranked are reranked too: copies have equal orders, however many they
are. Pivots are the vectors of the smallest hashes among those whose hash lies in a
part of its range that holds about SAMPLE times PIVOTS of them: a bounded sample.

Similarity is the cosine, rounded to 6 digits; ties go to the smaller id. Defined
results: rows with a null id, a null or empty vector or one with a null, NaN or
infinity are left out; a zero vector has similarity 0 to all; a vector of another
length is an error, as is an id column that holds no integers; an id isn't its own neighbour, nor are rows that repeat it; rows that
share an id count as one neighbour, by the nearest, and answer as one query; fewer than k candidates give shorter lists; an
empty table or query set gives no rows. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm.tiles import best_by_id, packed, searched, unfolded, usable

PIVOTS, POSTED, PROBED, SHARE, LEAST = 256, 24, 10, 24, 40
SHARD_ROWS, SAMPLE = 4096, 16


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit rows of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column) or set(column.value_lengths().to_pylist()) - {width}:
        raise ValueError("vectors differ in length")
    return units(flat.reshape(-1, width))


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-300)


def places(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each pivot in the order of each row; of equally near pivots the first."""
    order = np.argsort(-np.round(rows @ centres.T, 12), axis=1, kind="stable")
    place = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int16), order.shape), 1)
    return place


def footrule(query: np.ndarray, posted: np.ndarray) -> np.ndarray:
    """The footrule distances of one row of places and many."""
    return np.abs(posted - query).sum(1, dtype=np.int32)


class Shard:
    """A shard's vectors with their places and inverted files."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, centres: np.ndarray, posted: int):
        self.ids, self.rows = ids, units(rows)
        self.place = places(self.rows, centres)
        pivot, row = np.nonzero(self.place.T < posted)
        self.files = np.split(row, np.searchsorted(pivot, np.arange(1, len(centres))))

    def candidates(self, place: np.ndarray, probed: int, compared: int, but: int) -> np.ndarray:
        """Rows of other ids in the files a query opens, the nearest `compared` by footrule and all that tie with the last."""
        opened = np.zeros(len(self.ids), dtype=bool)
        for pivot in np.flatnonzero(place < probed):
            opened[self.files[pivot]] = True
        own = np.flatnonzero(opened & (self.ids != but))
        first = np.flatnonzero(np.diff(self.ids[own], prepend=but))  # ids ascend, and one of many rows counts once
        if len(first) <= compared:
            return own
        far = footrule(place, self.place[own])
        by_id = far if len(first) == len(own) else np.minimum.reduceat(far, first)
        return own[far <= np.partition(by_id, compared - 1)[compared - 1]]


def chosen_pivots(table: DataFrame, n: int, pivots: int) -> list:
    """At most so many different vectors, from a bounded sample by hash."""
    part = max(1, n // (SAMPLE * pivots))
    for parts in dict.fromkeys((part, 1)):  # 1 where a table of copies has none in that part
        sample = table.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == 0).select("v").dropDuplicates()
        if heads := sample.orderBy(F.xxhash64("v"), "v").limit(pivots).collect():
            return [r.v for r in heads]
    return []


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, posted: int = POSTED, probed: int = PROBED, share: int = SHARE, shard_rows: int = SHARD_ROWS, fan: int = 8) -> DataFrame:
    """query_id, rank, neighbor_id, score: about the k most similar others in `vectors` of every row of
    `queries`, of every vector where none are given."""
    table = usable(vectors, id_col, vector_col)
    n = table.count()
    heads = chosen_pivots(table, n, pivots)
    if not heads:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, neighbor_id bigint, score double")
    centres = matrix(pa.array(heads, pa.list_(pa.float64())), len(heads[0]))
    posted, probed = min(posted, len(centres)), min(probed, len(centres))
    shards = packed(table, shard_rows, n)
    asked = shards if queries is None else packed(usable(queries, id_col, vector_col), shard_rows)

    def product(q_id: np.ndarray, q: np.ndarray, s_id: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if q.shape[1] != centres.shape[1]:
            raise ValueError("vectors differ in length")
        shard, q = Shard(s_id, s, centres, posted), units(q)
        compared = max(LEAST, 4 * k, -(-len(s_id) // share))
        ids, scores = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
        for i, place in enumerate(places(q, centres)):
            own = shard.candidates(place, probed, compared, q_id[i])
            if len(own):
                score = np.round(shard.rows[own] @ q[i], 6) + 0.0
                top_id, top = best_by_id(shard.ids[own][None], score[None], k)
                ids[i, : top.shape[1]], scores[i, : top.shape[1]] = top_id[0], top[0]
        return ids, scores

    rows = unfolded(searched(asked, shards, product, k, fan, best_by_id))
    once = rows.groupBy("query_id", "neighbor_id").agg(F.max("score").alias("score"))  # rows that share an id answer as one
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "score")
