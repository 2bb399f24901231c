"""Search and all pairs block by block, beside brute force: memory, ties, lengths, and no size from which results differ."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.operators import blocks, late, retrieval
from loomvec.operators.blocks import Best, Kind, Side
from loomvec.plans import catalogue, more  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def side(kind, vectors, sizes=None, first=0):
    sizes = np.ones(len(vectors), np.int64) if sizes is None else np.array(sizes)
    return Side(kind, np.arange(first, first + len(sizes)), sizes, vectors)


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "did", F.round("score", 9), *(["rank"] if "rank" in df.columns else [])).collect())


@pytest.fixture
def in_blocks(monkeypatch):
    """Even few queries meet the corpus in blocks."""
    monkeypatch.setattr(blocks, "SENT_BYTES", 0)


@pytest.mark.parametrize("product", ["dot", "unit", "euclidean", "bits"])
@pytest.mark.parametrize("tokens", [1, 4])
def test_memory_of_search(product, tokens):
    """12,000 queries (or 3,000 of four tokens) by 4,096 vectors: all scores at once would be 393 MB and more."""
    if product == "euclidean" and tokens > 1:
        return
    rng, kind = np.random.default_rng(1), Kind(product)
    q, d = (side(kind, rng.normal(size=(n, 64)), [tokens] * (n // tokens)) for n in (12_000, 4_096))
    tracemalloc.start()
    best = Best(kind, q, 5)
    best.add(d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    assert (best.score > -np.inf).all()


@pytest.mark.parametrize("pair", [False, True])
def test_lists_longer_than_what_is_scored_at_once(monkeypatch, pair):
    rng, kind = np.random.default_rng(2), Kind("dot", pair)
    lengths = [30, 1, 7, 7, 2]
    q = side(kind, rng.normal(size=(sum(lengths), 5)), lengths)
    d = side(kind, rng.normal(size=(sum(lengths), 5)), lengths[::-1])
    monkeypatch.setattr(blocks, "CELLS", 12)
    monkeypatch.setattr(blocks, "SINGLE", 3)
    best = Best(kind, q, 3)
    best.add(d)
    cut = lambda s, i: s.raw[s.starts[i] : s.starts[i] + s.sizes[i]]
    for i in range(5):
        each = [(cut(q, i) @ cut(d, j).T).max(1) for j in range(5)]
        expected = sorted(((x.max() if pair else x.sum()), d.ids[j]) for j, x in enumerate(each))[::-1][:3]
        assert np.allclose(best.score[i], [s for s, _ in expected]) and best.ids[i].tolist() == [j for _, j in expected]


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_equal_vectors_tie_by_id(spark, in_blocks, metric):
    """Copies of thirty vectors in many blocks: the least ids of the copies, whatever block they lie in."""
    v = np.random.default_rng(3).normal(size=(30, 19))
    df = spark.createDataFrame([(i, v[i * 7 % 30].tolist()) for i in range(1500)], "id bigint, embedding array<double>").repartition(7)
    found = retrieval.knn(df.where("id < 30").withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "did"), 8, metric).collect()
    assert len(found) == 240
    mine = {(r.qid, r["rank"]): r.did for r in found}
    if metric != "dot":
        for i in range(30):
            assert [mine[i, r] for r in range(1, 9)] == [i % 30 + 30 * n for n in range(8)]


def test_a_vector_of_nan_is_no_candidate_and_hides_none(spark, in_blocks):
    v = np.random.default_rng(5).normal(size=(40, 6))
    v[7] = np.nan
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>").coalesce(1)
    found = retrieval.knn(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "did"), 4, "dot", exclude_same=True).collect()
    good = np.delete(np.arange(40), 7)
    for i in good:
        best = sorted((-(v[i] @ v[j]), j) for j in good if j != i)[:4]
        assert [r.did for r in sorted((r for r in found if r.qid == i), key=lambda r: r["rank"])] == [j for _, j in best]
    assert len(found) == 39 * 4


@pytest.mark.parametrize("name", ["binary_maxsim_topk", "binary_vs_float_overlap", "dense_topk", "hamming_topk", "matryoshka_overlap", "maxpair_cosine_topk", "maxsim_topk", "ranking_equality", "rerank_two_stage", "maxsim_pairs", "hamming_pairs", "vec_cosine_pairs", "vec_dot_pairs", "vec_euclid_pairs"])
def test_queries_in_blocks(spark, in_blocks, name):
    """Beside their SQL where no query is sent to every task."""
    from compare import spark_rows, sql_rows

    assert spark_rows(catalogue.QUERIES[name](spark, SMALL)) == sql_rows(catalogue.ORACLES[name], SMALL)


def test_all_late_pairs_are_products_of_matrices(spark):
    """Not a function of arrays for each pair (F1)."""
    plan = catalogue.QUERIES["maxsim_pairs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_hamming_pairs_of_any_size(spark, monkeypatch):
    """The query has no size from which it is refused (F15)."""
    whole = rows(catalogue.QUERIES["hamming_pairs"](spark, SMALL))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 16)
    assert rows(catalogue.QUERIES["hamming_pairs"](spark, SMALL)) == whole and len(whole) == 250_000


def test_near_vectors_keep_their_distance(spark, in_blocks):
    """Distances of long vectors that hardly differ, where squares would lose their digits."""
    v = 1e4 + np.random.default_rng(6).normal(size=(20, 8)) * 1e-3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>")
    for r in retrieval.all_scores(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "did"), "euclidean").collect():
        assert r.score == pytest.approx(np.sqrt(((v[r.qid] - v[r.did]) ** 2).sum()), abs=1e-15)


def test_rounding_as_sql():
    assert blocks.half_up(np.array([0.5, 1.5, -0.5, 2.4999, -2.6, -0.2]), 0).tolist() == [1, 2, -1, 2, -3, 0]
    assert not np.signbit(blocks.half_up(np.array([-2e-8, -1e-9]), 6)).any()
