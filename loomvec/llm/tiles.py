"""Blocks of vectors: packing, block by block scoring, merging of per-query lists in a tree.

A tile is one row that holds some thousand vectors. Query tiles meet all shard tiles; a task
folds what it finds for a query tile into one list of k a query, and the lists of
different tasks are merged `fan` at a time, so no step holds more than `fan` of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomvec.session import stored

PACKED = "tile int, ids binary, vectors binary"
LISTS = "tile int, part int, n int, ids binary, best_id binary, best_score binary"
#: By (query ids, query vectors, shard ids, shard vectors): ids and scores, a row for each query, -inf for none.
Product = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part; ids that aren't integers are an error."""
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} holds no integers")
    chosen = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def packed(chosen: DataFrame, tile_rows: int, n: int | None = None) -> DataFrame:
    """PACKED rows of about tile_rows vectors of id and v. Their number follows from the table's
    size, a row's tile from its id and vector, so a rerun deals alike; copies under one id are dealt by row."""
    tiles = max(1, math.ceil((chosen.count() if n is None else n) / tile_rows))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        column = table["v"].combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) % table.num_rows or len(set(column.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors differ in length")
        return pa.table({"tile": pa.array([table["tile"][0].as_py()], pa.int32()), "ids": [table["id"].to_numpy().astype(np.int64).tobytes()], "vectors": [flat.astype(np.float64).tobytes()]})

    tiled = chosen.withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int"))
    return stored(tiled.groupBy("tile").applyInArrow(pack, PACKED), "tiles")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then id; scores of -inf stand for none."""
    if scores.shape[1] > k:
        # all that tie with the k-th stay until ids have decided
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        most = int((scores >= kth[:, None]).sum(1).max())
        keep = np.argpartition(-scores, min(most, scores.shape[1]) - 1, axis=1)[:, :most]
        ids = np.take_along_axis(ids, keep, 1)
        scores = np.take_along_axis(scores, keep, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def best_by_id(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where an id counts once, at its best."""
    order = np.lexsort((-scores, ids), axis=1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    return best(ids, scores, k)


def searched(queries: DataFrame, shards: DataFrame, product: Product, k: int, fan: int, fold=best) -> DataFrame:
    """LISTS, one for each query tile: every query tile with every shard, folded and merged."""
    renamed = shards.select(F.col("tile").alias("shard"), F.col("ids").alias("s_ids"), F.col("vectors").alias("s_vectors"))
    blocks = queries.select("tile", "ids", "vectors").crossJoin(renamed.hint("shuffle_replicate_nl"))

    def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return fold(np.concatenate([a for a, _ in lists], 1), np.concatenate([b for _, b in lists], 1), k)

    def rows(tile: int, shard: int, ids: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        i, s = found
        return pa.RecordBatch.from_pydict({"tile": pa.array([tile], pa.int32()), "part": pa.array([shard], pa.int32()), "n": pa.array([i.shape[1]], pa.int32()), "ids": [ids.tobytes()], "best_id": [np.ascontiguousarray(i).tobytes()], "best_score": [np.ascontiguousarray(s).tobytes()]})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                tile, shard = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                q, s = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (1, 4))
                a, b = (np.frombuffer(batch.column(c)[row].as_buffer()).reshape(len(x), -1) for c, x in ((2, q), (5, s)))
                if a.shape[1] != b.shape[1]:
                    raise ValueError("vectors differ in length")
                found = product(q, a, s, b)
                before = held.get(tile)
                held[tile] = (shard, before[1], merged([before[2], found])) if before else (shard, q.copy(), found)
                if len(held) > fan:
                    oldest = next(iter(held))
                    yield rows(oldest, *held.pop(oldest))
        for tile, item in held.items():
            yield rows(tile, *item)

    def merge(table: pa.Table) -> pa.Table:
        lists = []
        for row in table.to_pylist():
            shape = (len(row["ids"]) // 8, row["n"])
            lists.append((np.frombuffer(row["best_id"], np.int64).reshape(shape), np.frombuffer(row["best_score"]).reshape(shape)))
        first = table.slice(0, 1).to_pylist()[0]
        return pa.Table.from_batches([rows(first["tile"], first["part"], np.frombuffer(first["ids"], np.int64), merged(lists))])

    lists = blocks.mapInArrow(products, LISTS)
    spread = max(1, math.ceil(shards.count() / fan))
    while spread > 1:
        lists = lists.groupBy("tile", F.expr(f"pmod(part, {spread})").alias("group")).applyInArrow(merge, LISTS)
        spread = math.ceil(spread / fan)
    return lists.groupBy("tile").applyInArrow(merge, LISTS)


def unfolded(lists: DataFrame) -> DataFrame:
    """query_id, rank, neighbor_id, score of LISTS."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["ids"], np.int64)
                i, s = np.frombuffer(row["best_id"], np.int64), np.frombuffer(row["best_score"])
                keep = np.isfinite(s)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q, row["n"])[keep], "rank": np.tile(np.arange(1, row["n"] + 1, dtype=np.int32), len(q))[keep], "neighbor_id": i[keep], "score": s[keep]})

    return lists.mapInArrow(unfold, "query_id bigint, rank int, neighbor_id bigint, score double")
