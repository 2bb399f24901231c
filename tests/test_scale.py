"""The ways taken beyond what is sent to every task, and the shared folder."""

import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec import session
from loomvec.errors import ConfigError
from loomvec.operators import late, neural, retrieval, sparse


@pytest.fixture(scope="module")
def weights(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), f"w{t}", float(1 + rng.integers(0, 3))) for d in range(60) for t in rng.choice(40, 8, replace=False)]
    return spark.createDataFrame(rows, "doc_id bigint, term string, weight double")


def listed(df):
    return sorted((r.qid, r["rank"], r.did, round(r.score, 9)) for r in df.collect())


def test_sparse_search_by_matrix_and_by_join(weights, monkeypatch):
    queries = weights.where("doc_id < 7")
    monkeypatch.setattr(sparse, "DOCS", 16)
    found = listed(sparse.knn(queries, weights, 4, digits=9))
    terms = {}
    for r in weights.collect():
        terms.setdefault(r.doc_id, {})[r.term] = r.weight
    expected = []
    for q in range(7):
        scored = sorted((-round(sum(w * terms[d].get(t, 0) for t, w in terms[q].items()), 9), d) for d in terms if set(terms[d]) & set(terms[q]))
        expected += [(q, i + 1, d, -s) for i, (s, d) in enumerate(scored[:4])]
    assert found == expected
    monkeypatch.setattr(sparse, "MATRIX_BYTES", 0)
    assert listed(sparse.knn(queries, weights, 4, digits=9)) == expected
    assert sparse.knn(queries.where("false"), weights, 4).count() == 0 and sparse.knn(queries, weights.where("false"), 4).count() == 0


def test_late_interaction_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(int(rng.integers(1, 5)), 6)).round(2).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, t array<array<double>>")
    q, d = df.select(F.col("id").alias("qid"), F.col("t").alias("q")), df.select(F.col("id").alias("did"), F.col("t").alias("d"))
    for settings in ({}, {"binary": True}, {"pair": True, "exclude_same": True}):
        whole = listed(late.maxsim_knn(q, d, 3, **settings))
        with monkeypatch.context() as m:
            m.setattr(late, "BLOCK_BYTES", 2000)
            assert listed(late.maxsim_knn(q, d, 3, **settings)) == whole
    assert len(whole) == 150


def test_all_pairs_beyond_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0, -float(i % 3)]) for i in range(12)], "id bigint, embedding array<double>")
    q, d = df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "did")
    rows = lambda m: sorted((r.qid, r.did, round(r.score, 9)) for r in retrieval.scores(q, d, m).collect())
    whole = {m: rows(m) for m in ("dot", "cosine", "euclidean", "hamming")}
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 16)
    assert all(rows(m) == whole[m] for m in ("dot", "cosine", "euclidean"))
    with pytest.raises(ConfigError, match="use knn"):
        rows("hamming")


def test_the_error_function():
    import math

    x = np.linspace(-8, 8, 4001)
    assert np.abs(neural.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12


def test_the_shared_folder(spark, monkeypatch):
    on = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ConfigError, match="spark.checkpoint.dir"):
            session.shared_dir(on(master))
        assert session.shared_dir(on(master, "hdfs://host/shared/")) == "hdfs://host/shared"
    assert session.shared_dir(on("local[4]")).startswith("file:///")
    with session.scratch(spark):
        kept = session.stored(spark.range(3), "test")
        path = session._written[-1].removeprefix("file://")
        assert kept.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
