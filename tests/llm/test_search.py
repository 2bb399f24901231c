"""Exact and approximate vector search beside brute force over all pairs."""

import numpy as np
import pytest
from compare import spark_rows, sql_rows

from loomvec.llm import catalogue, exact_topk, permutation_index


def brute(rows, k, cosine):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    if cosine:
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    scores = np.round(v @ v.T, 6) + 0.0
    out = []
    for i, q in enumerate(ids):
        best = sorted((-scores[i, j], int(ids[j])) for j in range(len(ids)) if ids[j] != q)[:k]
        out += [(int(q), r, n, -s + 0.0) for r, (s, n) in enumerate(best, 1)]
    return out


def rows_of(df):
    return [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]


def as_set(df):
    return sorted((r.query_id, r.rank, r.neighbor_id, r.score) for r in df.collect())


@pytest.mark.parametrize("tile_rows", [2048, 40])
def test_exact_equals_brute_force(small, tile_rows):
    """Also with tiles so small that the merging tree has several levels."""
    vectors = small("embeddings")
    assert as_set(exact_topk.top_k(vectors, k=7, tile_rows=tile_rows, fan=2)) == sorted(brute(rows_of(vectors), 7, False))


def test_exact_ties_and_repeats(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(30)] + [(3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert as_set(exact_topk.top_k(df, k=5, tile_rows=4)) == sorted(brute(rows, 5, False))


def test_exact_defined_results(odd_vectors, spark):
    usable = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [0.0, 0.0]), (10, [float(np.float32(0.6)), float(np.float32(0.8))])]
    assert as_set(exact_topk.top_k(odd_vectors, k=10)) == sorted(brute(usable, 10, False))
    assert exact_topk.top_k(odd_vectors.where("false")).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        exact_topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")).collect()


def test_queries_by_id_equal_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(catalogue.QUERIES["op10_exact_topk"](spark, sf)) == sql_rows(catalogue.ORACLES["op10_exact_topk"], sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = as_set(catalogue.QUERIES["op6_permutation_index"](spark, sf))
    expected = [r for r in brute(rows_of(vectors), 10, True) if r[0] % 100 == 0]
    assert len(found) == len(expected) and len({r[::2] for r in found} & {r[::2] for r in expected}) >= 0.5 * len(expected)
    assert len({r[:1] + r[2:3] for r in found} & {r[:1] + r[2:3] for r in expected}) >= 0.9 * len(expected)


def test_ids_that_are_no_integers_are_an_error(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<double>")
    for search in (exact_topk.top_k, permutation_index.search):
        with pytest.raises(TypeError, match="no integers"):
            search(df)


def test_vectors_of_another_length_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        permutation_index.search(df).collect()


def test_permutation_index_recall(spark):
    """Every row is a query: at least nine in ten of the true neighbours."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = as_set(permutation_index.search(vectors, k=10))
    expected = {(q, n) for q, _, n, _ in brute(rows_of(vectors), 10, True)}
    assert len({q for q, *_ in found}) == vectors.count()
    assert len(expected & {(q, n) for q, _, n, _ in found}) >= 0.9 * len(expected)
    exact = {(q, n): s for q, _, n, s in brute(rows_of(vectors.limit(50)), 49, True)}
    assert all(abs(exact[q, n] - s) < 1e-9 for q, _, n, s in found if (q, n) in exact)


def test_footrule():
    rng = np.random.default_rng(2)
    a, b = rng.permuted(np.tile(np.arange(20, dtype=np.int16), (6, 1)), axis=1), rng.permuted(np.tile(np.arange(20, dtype=np.int16), (9, 1)), axis=1)
    assert np.array_equal([permutation_index.footrule(x, b) for x in a], np.abs(a[:, None, :].astype(int) - b[None]).sum(2))


def test_permutation_index_with_all_files_is_exact(small):
    vectors = small("embeddings")
    found = permutation_index.search(vectors, k=5, pivots=8, posted=8, probed=8, share=1, shard_rows=70, fan=2)
    assert as_set(found) == sorted(brute(rows_of(vectors), 5, True))


def test_permutation_index_finds_the_smallest_of_many_copies(spark):
    """600 copies where about 100 a file are compared: all of them are looked at."""
    rng = np.random.default_rng(6)
    vs = rng.normal(size=(2000, 16)).round(3)
    copies = np.sort(rng.permutation(2000)[:600])
    vs[copies] = vs[copies[0]]
    rows = [(i, v.tolist()) for i, v in enumerate(vs)]
    found = as_set(permutation_index.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=10, shard_rows=500))
    lists = {}
    for q, _, n, s in found:
        lists.setdefault(q, []).append((n, s))
    for q in copies.tolist():
        assert lists[q] == [(n, 1.0) for n in copies.tolist() if n != q][:10]


def test_permutation_index_counts_an_id_once(spark):
    """An id of many rows, alike or not, is one neighbour, at its best."""
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, x / 1000]) for x in range(40) for _ in (0, 1)] + [(i, [1.0, float(i)]) for i in range(2, 8)]
    found = as_set(permutation_index.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3, pivots=8, posted=8, probed=8))
    assert [(r, n) for q, r, n, _ in found if q == 0] == [(1, 1), (2, 2), (3, 3)]
    assert all(sum(x == q for x, *_ in found) == 3 for q in range(8))


def test_permutation_defined_results(odd_vectors, spark):
    usable = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [0.0, 0.0]), (10, [float(np.float32(0.6)), float(np.float32(0.8))])]
    assert as_set(permutation_index.search(odd_vectors, k=10)) == sorted(brute(usable, 10, True))
    assert permutation_index.search(odd_vectors.where("false")).count() == 0
