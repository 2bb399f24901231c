"""Sparse retrieval on posting lists: rows (doc, index, weight)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from loomvec.encoder import WORD, sliced
from loomvec.functions.sequences import sparsity
from loomvec.operators import retrieval
from loomvec.operators.blocks import half_up

#: Bytes of a matrix of queries that is sent to every task, and documents scored at once.
MATRIX_BYTES, DOCS = 128 << 20, 512
#: Bytes of the matrix of the documents that are scored at once.
ROWS_BYTES = 16 << 20
#: Stands for a null id inside.
NO_ID = -(1 << 63)


def term_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD) -> DataFrame:
    """doc, term, weight: ln(1 + count) of the words of a text.

    Words are counted a text at a time, so they aren't shuffled and a task holds those of a slice of texts. Rows that share an
    id (looked for among the ids, at once) count as one document; theirs alone are summed up by a shuffle."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    counts = _counts(own, pattern)
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        rest = _counts(own.join(again, same, "left_semi"), pattern).groupBy("doc_id", "term").agg(F.sum("n").alias("n"))
        counts = _counts(own.join(again, same, "left_anti"), pattern).unionByName(rest)
    return counts.select("doc_id", "term", F.log1p(F.col("n").cast("double")).alias("weight"))


def _counts(texts: DataFrame, pattern: str) -> DataFrame:
    """doc_id, term, n of each row's text."""
    lists = texts.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(f"({pattern})"), F.lit(1)).alias("words"))
    schema = StructType([texts.schema["doc_id"], StructField("term", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                sizes = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = part.column(1).flatten().dictionary_encode()
                v = max(1, len(found.dictionary))
                keys, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * v + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys // v)), found.dictionary.take(pa.array(keys % v)), pa.array(n.astype(np.int64))], names=["doc_id", "term", "n"])

    return lists.mapInArrow(run, schema)


def postings(pairs: DataFrame, doc: str = "doc_id", column: str = "weights", vocab_size: int | None = None) -> DataFrame:
    """Rows of an array of (index, weight); of several pairs with one index the first counts. An index outside the vocabulary is an error."""
    rows = pairs.select(doc, F.posexplode(column).alias("pos", "p")).select(doc, F.col("p.index").alias("index"), F.struct("pos", F.col("p.weight").alias("weight")).alias("x"))
    out = rows.groupBy(doc, "index").agg(F.min("x").alias("x")).select(doc, "index", F.col("x.weight").cast("double").alias("weight"))
    if vocab_size is not None:
        out = out.where(F.when((F.col("index") >= 0) & (F.col("index") < vocab_size), True).otherwise(F.raise_error(F.format_string(f"index %d outside the vocabulary of {vocab_size}", F.col("index"))).cast("boolean")))
    return out


def dot_pairs(queries: DataFrame, docs: DataFrame, key: str = "term", digits: int | None = None) -> DataFrame:
    """qid, did, score of every pair that shares an index, rounded to `digits` where given.

    As in knn the queries go to every task as a matrix where that is at most MATRIX_BYTES, so what is shuffled is the documents' weights, once;
    more are joined by index with partial sums, where a shuffle has a row for each pair and index."""
    q = queries.select(F.col("doc_id").alias("qid"), key, F.col("weight").cast("double").alias("w")).where(F.col(key).isNotNull())
    held = _matrix(q, key)
    if held is not None:
        kinds = [queries.schema["doc_id"].dataType, docs.schema["doc_id"].dataType]
        if all(isinstance(t, IntegralType) for t in kinds):
            found = _products(held, docs, key, None, digits)
            return found.select(*(F.col(c).cast(t) for c, t in zip(("qid", "did"), kinds)), "score")
    d = docs.select(F.col("doc_id").alias("did"), key, F.col("weight").alias("dw"))
    scored = q.join(d, key).groupBy("qid", "did").agg(F.sum(F.col("w") * F.col("dw")).alias("score"))
    return scored if digits is None else scored.withColumn("score", F.round("score", digits))


def knn(queries: DataFrame, docs: DataFrame, k: int, digits: int | None = None, key: str = "term") -> DataFrame:
    """qid, did, score, rank: the k best documents of every query among those that share an index with it,
    by scores rounded to `digits` where given.

    The queries' weights, as a matrix of their indices, are sent to every task where that is at most MATRIX_BYTES;
    the documents' weights of these indices are brought together by document, and products of matrices keep k
    documents a query before any shuffle, so a frequent word is no hot key. More queries are joined by index."""
    q = queries.select(F.col("doc_id").alias("qid"), key, F.col("weight").cast("double").alias("w")).where(F.col(key).isNotNull())
    held = _matrix(q, key)
    if held is None:
        scored = dot_pairs(queries, docs, key)
        return retrieval.top_k(scored if digits is None else scored.withColumn("score", F.round("score", digits)), k)
    return retrieval.top_k(_products(held, docs, key, k, digits), k)


def _matrix(q: DataFrame, key: str) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None:
    """The queries' ids, their indices, weights by index and query, and ones where there is one; None beyond MATRIX_BYTES."""
    n, terms = q.agg(F.count_distinct("qid"), F.count_distinct(key)).first()
    if n * terms * 8 > MATRIX_BYTES:
        return None
    table = q.groupBy(F.coalesce("qid", F.lit(NO_ID)).alias("qid"), key).agg(F.sum("w").alias("w")).toArrow()
    ids, row = np.unique(table["qid"].to_numpy(), return_inverse=True)
    words = table[key].combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    weights = np.zeros((len(words.dictionary), len(ids)))
    weights[words.indices.to_numpy(), row] = table["w"].to_numpy()
    present = np.zeros(weights.shape, np.float32)  # a weight of 0 is an index too
    present[words.indices.to_numpy(), row] = 1
    return ids, words.dictionary, weights, present


def _products(held: tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray], docs: DataFrame, key: str, k: int | None, digits: int | None) -> DataFrame:
    """qid, did, score of every query with the documents that share an index, the k best of a few documents where k is given."""
    spark, schema = docs.sparkSession, "qid bigint, did bigint, score double"
    if not len(held[0]):
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame(pa.table({key: held[1], "place": pa.array(np.arange(len(held[1]), dtype=np.int32))}))
    own = docs.join(F.broadcast(known), key).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), "place", F.col("weight").cast("double").alias("w"))
    sent, most = spark.sparkContext.broadcast((held[0], *held[2:])), max(1, min(DOCS, ROWS_BYTES // (8 * len(held[1]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_id, matrix, shared = sent.value
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not rest.num_rows:
                continue
            did = rest["did"].to_numpy()
            end = len(did) if batch is None else int(np.searchsorted(did, did[-1]))  # the last document may go on
            docs_at = np.flatnonzero(np.concatenate([[True], did[1:end] != did[: end - 1]])) if end else np.zeros(0, np.int64)
            for a in range(0, len(docs_at), most):
                stop = int(docs_at[a + most]) if a + most < len(docs_at) else end
                part = rest.slice(int(docs_at[a]), stop - int(docs_at[a]))
                d_id, at = np.unique(part["did"].to_numpy(), return_inverse=True)
                rows, own_places, place = np.zeros((len(d_id), len(matrix))), np.zeros((len(d_id), len(matrix)), np.float32), part["place"].to_numpy()
                np.add.at(rows, (at, place), part["w"].to_numpy())
                own_places[at, place] = 1
                scores, meet = (rows @ matrix).T, (own_places @ shared).T > 0
                if k is None:
                    q, d = np.nonzero(meet)
                    best = scores[q, d]
                    yield pa.RecordBatch.from_pydict({"qid": q_id[q], "did": d_id[d], "score": best if digits is None else half_up(best, digits)})
                    continue
                if digits is not None:
                    scores = np.round(scores, digits) + 0.0
                scores[~meet] = -np.inf
                order = np.lexsort((np.broadcast_to(d_id, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                keep = best > -np.inf
                yield pa.RecordBatch.from_pydict({"qid": np.repeat(q_id, keep.sum(1)), "did": d_id[order][keep], "score": best[keep]})
            rest = rest.slice(end)

    # a number of its own, as Spark would merge partitions by their bytes in files, which are few for so many rows to sort
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    found = own.repartition(parts, "did").sortWithinPartitions("did").mapInArrow(run, schema)
    return found.select(*(F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("qid", "did")), "score")


def statistics(weights: DataFrame, vocab_size: int, doc: str = "doc_id") -> DataFrame:
    """doc, nnz, sparsity, density, least and greatest weight."""
    out = weights.groupBy(doc).agg(F.count("*").alias("nnz"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    return out.withColumn("sparsity", sparsity("nnz", vocab_size)).withColumn("density", F.col("nnz") / float(vocab_size))


def write_postings(weights: DataFrame, path: str, buckets: int = 64, key: str = "term") -> None:
    """The inverted index as Parquet: partitioned by a hash of the key and sorted in it, so a term is found in one folder by its row groups' ranges."""
    parted = weights.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    parted.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)
