"""Worked examples of the vector, sequence, quantisation and series functions, with nulls and mistakes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.errors import ConfigError, MatryoshkaError, QuantizationError
from loomvec.functions import quantization as qz
from loomvec.functions import sequences as sq
from loomvec.functions import series as ts
from loomvec.functions import vectors as vx
from loomvec.operators import late, neural, pooling, retrieval, sparse


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over literals."""
    row = spark.range(1)

    def value(expression):
        return row.select(expression.alias("x")).first().x

    return value


def arr(*xs, kind="double"):
    return F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>") if xs else F.array().cast(f"array<{kind}>")


def mat(*rows):
    return F.array(*(arr(*r) for r in rows)) if rows else F.array().cast("array<array<double>>")




def test_vectors(one):
    assert one(vx.dot(arr(1, 2, 3), arr(4, 5, 6))) == 32
    assert one(vx.euclidean(arr(0, 0), arr(3, 4))) == 5
    assert one(vx.l2_norm(arr(3, 4))) == 5
    assert one(vx.l2_normalize(arr(3, 4))) == [0.6, 0.8] and one(vx.l2_normalize(arr(-3, -4))) == [-0.6, -0.8]
    assert one(vx.l2_normalize(arr(0, 0))) == [0, 0]
    assert [one(vx.cosine(arr(1, 0), arr(*b))) for b in ((1, 0), (0, 1), (-1, 0), (0, 0))] == [1, 0, -1, 0]
    null = F.lit(None).cast("array<double>")
    assert one(vx.dot(null, arr(1))) is None and one(vx.l2_norm(null)) is None
    assert one(vx.dot(arr(), arr())) == 0
    for f in (vx.dot, vx.cosine, vx.euclidean):
        with pytest.raises(Exception, match="Dimension mismatch: expected 2, got 3"):
            one(f(arr(1, 2), arr(1, 2, 3)))
    assert [one(vx.is_finite(arr(1.0, x))) for x in (2.0, math.nan, math.inf, -math.inf)] == [True, False, False, False]
    with pytest.raises(Exception, match="NaN or infinite"):
        one(vx.require_finite(arr(math.nan)))


def test_truncation(one):
    assert one(vx.truncate(arr(*range(10)), 5)) == [0, 1, 2, 3, 4]
    assert one(vx.truncate(arr(1, 2), 2)) == [1, 2]
    with pytest.raises(Exception, match="exceeds dimension 2"):
        one(vx.truncate(arr(1, 2), 3))
    with pytest.raises(MatryoshkaError):
        vx.truncate(arr(1), 0)
    assert one(vx.finish_dense(arr(3, 4, 5), 2)) == [0.6, 0.8] and one(vx.finish_dense(arr(3, 4, 5), 2, False)) == [3, 4]
    assert vx.TruncationStage.parse("truncate_output") is vx.TruncationStage.OUTPUT
    with pytest.raises(MatryoshkaError):
        vx.TruncationStage.parse("elsewhere")
    w = [[1.0, 0.0, 0.0], [0.0, 1.0, 1.0]]
    assert one(vx.truncate_and_project(arr(1, 2, 3), 1, vx.TruncationStage.OUTPUT, w)) == [1]
    assert one(vx.truncate_and_project(arr(1, 2, 3, 9), 3, vx.TruncationStage.HIDDEN, w)) == [1, 5]
    assert one(vx.truncate_and_project(arr(1, 2, 3), None, None, w)) == [1, 5]


def test_pooling(one):
    rows, mask, none = mat((1, 2), (3, 4), (5, 6)), arr(1, 1, 0, kind="int"), arr(0, 0, 0, kind="int")
    assert one(pooling.pool(rows, mask, "cls")) == [1, 2] and one(pooling.pool(rows, none, "CLS")) == [1, 2]
    assert one(pooling.pool(rows, mask, "mean")) == [2, 3] and one(pooling.pool(rows, none, "mean")) == [0, 0]
    assert one(pooling.pool(mat((1, 5), (3, 2), (9, 9)), mask, "max")) == [3, 5] and one(pooling.pool(rows, none, "max")) == [0, 0]
    assert one(pooling.pool(mat((-1, -5), (-3, -2)), arr(1, 1, kind="int"), "max")) == [-1, -2]
    assert one(pooling.pool(rows, mask, "last_token")) == [3, 4] and one(pooling.pool(rows, none, "last_token")) == [1, 2]
    assert one(pooling.pool_dense(mat((6, 8, 1), (0, 0, 1)), arr(1, 1, kind="int"), "mean", 2)) == [0.6, 0.8]
    with pytest.raises(ConfigError):
        pooling.pool(rows, mask, "sum")


def test_late_interaction(one, spark):
    q, d = mat((1, 0, 0), (0, 1, 0)), mat((1, 0, 0), (0, 0.5, 0), (0, 1, 0))
    assert one(late.maxsim(q, d)) == 2 and one(late.maxpair_cosine(q, d)) == 1
    with pytest.raises(Exception, match="Dimension mismatch"):
        one(late.maxsim(mat((1, 0)), d))
    scores = spark.createDataFrame([(1, 1, 0, 0.2), (1, 1, 0, 0.9), (1, 1, 1, 0.5)], "qid int, did int, q_pos int, score double")
    assert late.maxsim_long(scores).first().score == pytest.approx(1.4)
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(-3, 4, (1 + i % 4, 3)).astype(float).tolist()) for i in range(25)] + [(25, []), (26, None)]
    df = spark.createDataFrame(docs, "did bigint, d array<array<double>>")
    found = {(r.qid, r["rank"]): (r.did, r.score) for r in late.maxsim_knn(df.selectExpr("did as qid", "d as q"), df, 3).collect()}
    for i, t in docs[:25]:
        best = sorted((-sum(max(np.dot(a, b) for b in e) for a in t), j) for j, e in docs[:25])[:3]
        assert [found[i, r] for r in (1, 2, 3)] == [(j, -s) for s, j in best]
    assert len(found) == 75
    pairs = late.maxsim_knn(df.selectExpr("did as qid", "d as q"), df, 3, pair=True, exclude_same=True).collect()
    cosine = lambda a, b: 0.0 if not (n := np.linalg.norm(a) * np.linalg.norm(b)) else np.dot(a, b) / n
    for r in pairs:
        assert r.qid != r.did and r.score == pytest.approx(max(cosine(a, b) for a in docs[r.qid][1] for b in docs[r.did][1]))
    assert len(pairs) == 75


def test_quantization(one, spark):
    assert one(qz.unpack_bits(qz.pack_bits(arr(0.5, -0.3, 0.8, -0.1)), 4)) == [1, -1, 1, -1]
    assert one(qz.pack_bits(arr(0.0, -0.0, math.nan, 1))) == [0b1011]
    sim = lambda a, b: one(qz.hamming_similarity(qz.pack_bits(arr(*a)), qz.pack_bits(arr(*b)), len(a), len(b)))
    assert sim((1, 1, -1, -1), (1, -1, -1, 1)) == 2 and sim((1,) * 5, (1,) * 5) == 5 and sim((1, 1), (-1, -1)) == 0 and sim((1, 1), (1, 1, 1)) == 0
    assert one(F.size(qz.pack_bits(arr(*range(128))))) == 16 and one(F.size(qz.pack_bits(arr(1, 2, 3)))) == 1 and one(qz.pack_bits(arr())) == []
    packed = lambda m: F.transform(m, qz.pack_bits)
    assert one(qz.quantized_maxsim(packed(mat((1, 1), (-1, 1))), packed(mat((1, -1), (-1, 1))), 2)) == 3
    assert one(qz.quantized_maxsim(packed(mat()), packed(mat((1, 1))), 2)) == 0 and one(qz.quantized_maxsim(packed(mat((1, 1))), packed(mat()), 2)) == -math.inf
    assert 30 < one(qz.compression_ratio(7, 128)) < 34 and one(qz.compression_ratio(0, 128)) == 0
    v = [0.1 * i - 1.3 for i in range(40)]
    back = one(qz.int8_dequantize(qz.int8_quantize(arr(*v), F.lit(-1.3), F.lit(2.6))))
    assert np.allclose(back, v, atol=0.01)
    assert np.allclose(one(qz.int4_dequantize(qz.int4_quantize(arr(*v)), 40)), v, atol=0.11)
    with pytest.raises(QuantizationError):
        qz.int4_quantize(arr(1), 3)


def test_sequences(one, spark):
    batches = spark.createDataFrame([(0, [1, 2, 3]), (0, [4, 5]), (0, [6, 7, 8, 9]), (1, [])], "b int, ids array<bigint>")
    padded = [r.ids for r in sq.pad_sequences(batches, "ids", "b").collect()]
    assert sorted(padded) == sorted([[1, 2, 3, 0], [4, 5, 0, 0], [6, 7, 8, 9], []])
    assert [4, 5, 999, 999] in [r.ids for r in sq.pad_sequences(batches, "ids", "b", 999).collect()]
    ids = arr(5, 0, 7, 0, kind="bigint")
    assert one(sq.attention_mask(ids)) == [1, 0, 1, 0] and one(sq.invert_mask(sq.attention_mask(ids))) == [0, 1, 0, 1]
    assert one(sq.unpad(mat((1,), (2,), (3,)), arr(1, 1, 0, kind="int"))) == [[1], [2]]
    assert one(sq.reshape(arr(1, 2, 3, 4), 2)) == [[1, 2], [3, 4]] and one(sq.reshape(arr(), 2)) == []
    with pytest.raises(Exception, match="multiple of 2"):
        one(sq.reshape(arr(1, 2, 3), 2))
    assert one(sq.tail(arr(1, 2, 3), 2)) == [2, 3] and one(sq.tail(arr(1), 2)) == [1] and one(sq.tail(arr(), 2)) == []
    assert one(sq.splade(F.lit(-3.0))) == 0 and one(sq.splade(F.lit(math.e - 1))) == pytest.approx(1)


def test_sparse(one, spark):
    pairs = sq.sparse_pairs(arr(0, 0.5, 0, -2))
    assert [tuple(p) for p in one(pairs)] == [(1, 0.5), (3, -2)]
    assert one(sq.dense_vector(pairs, 5)) == [0, 0.5, 0, -2, 0]
    assert one(sq.sparse_dot(pairs, sq.sparse_pairs(arr(1, 2, 3, 4)))) == 1 - 8 and one(sq.sparse_dot(pairs, sq.sparse_pairs(arr(1, 0, 3)))) == 0
    assert one(sq.in_vocabulary(pairs, 3)) is False and one(sq.in_vocabulary(pairs, 4)) is True
    rows = spark.createDataFrame([(1, [(0, 2.0), (3, 1.0), (0, 9.0)])], "doc_id int, weights array<struct<index:int,weight:double>>")
    assert {(r["index"], r.weight) for r in sparse.postings(rows).collect()} == {(0, 2.0), (3, 1.0)}
    with pytest.raises(Exception, match="outside the vocabulary"):
        sparse.postings(rows, vocab_size=3).collect()
    s = sparse.statistics(sparse.postings(rows), 100).first()
    assert s.nnz == 2 and abs(s.sparsity - 0.98) < 1e-6 and abs(s.density - 0.02) < 1e-6


def test_posting_lists_on_disk(spark, tmp_path):
    weights = spark.createDataFrame([(i, f"t{i % 7}", 1.0) for i in range(50)], "doc_id int, term string, weight double")
    sparse.write_postings(weights, str(tmp_path / "p"), 4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(map(tuple, back.select("doc_id", "term", "weight").collect())) == sorted(map(tuple, weights.collect()))
    assert back.groupBy("term").agg(F.count_distinct("bucket").alias("n")).where("n > 1").count() == 0


def test_series(one):
    assert one(ts.scale_by_mean(arr(1, 2, 3)))["scaled"][0] == pytest.approx(0.5)
    assert one(ts.scale_by_mean(arr(0, 0)))["scaled"] == [0, 0]
    scaled = one(ts.scale_by_mean(arr(1, -5, 9)))
    assert np.allclose(np.array(scaled["scaled"]) * scaled["scale"], [1, -5, 9], atol=1e-5)
    assert np.array(one(ts.patches(arr(*range(64)), 16))).shape == (4, 16)
    with pytest.raises(Exception, match="multiple of 16"):
        one(ts.patches(arr(*range(65)), 16))
    assert [one(ts.to_bin(F.lit(float(x)), 4096)) for x in (-10, 0, 10, -99, 99)] == [0, 2048, 4095, 0, 4095]
    low, middle, high = (one(ts.from_bin(F.lit(b), 4096)) for b in (0, 2048, 4095))
    assert low < -9 and abs(middle) < 0.1 and high > 9
    assert ts.key_steps(64) == [0, 16, 32, 48, 63]
    assert one(ts.median_forecast(arr(1, 2, 3), (0.1, 0.5, 0.9))) == 2 and one(ts.median_forecast(arr(1, 2, 3), (0.1, 0.2, 0.9))) == 2


def test_forecast_configuration():
    for c in (ts.ForecastConfig.small(), ts.ForecastConfig.base(), ts.ForecastConfig.custom(1024, 32), ts.ForecastConfig.for_model("x-base")):
        assert c.validate() is c
    assert ts.ForecastConfig.for_model("x-base").d_model == 768
    for bad in (dict(context_length=100), dict(quantiles=()), dict(quantiles=(1.0,)), dict(num_heads=0), dict(context_length=16)):
        with pytest.raises(ConfigError):
            ts.ForecastConfig(**bad).validate()


def test_layers(spark):
    x = np.array([[1.0, -2.0], [0.5, 3.0]])
    assert np.allclose(neural.gelu(np.array([0.0, 1.0, -1.0])), [0, 0.841345, -0.158655], atol=1e-6)
    n = neural.layer_norm(x, np.ones(2), np.zeros(2))
    assert np.allclose(n.mean(1), 0) and np.allclose(n.std(1), 1, atol=1e-5)
    eye = neural.Linear(np.eye(2))
    assert np.allclose(neural.ResidualMlp(eye, eye, eye)(x), np.maximum(x, 0) + x)
    head = neural.MaskedLanguageHead(eye, np.ones(2), np.zeros(2), neural.Linear(np.ones((3, 2)), np.arange(3.0)))
    assert head(x).shape == (2, 3)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>")
    assert {r.id: r.w for r in neural.apply_rows(df, "v", neural.Linear(np.array([[1.0, 1.0]])), "w").collect()} == {1: [3.0], 2: None}
    c = ts.ForecastConfig(context_length=4, patch_size=2, prediction_length=3, quantiles=(0.1, 0.5))
    series = spark.createDataFrame([(1, [2.0, -2.0, 2.0, 2.0])], "id int, values array<double>")
    out = neural.forecast_quantiles(series, "values", c, lambda p: np.tile(np.arange(6.0), (len(p), 1))).first().quantiles
    assert np.allclose(out, 2 * np.arange(6).reshape(3, 2))
    with pytest.raises(Exception, match="series have 4 values"):
        neural.forecast_quantiles(spark.createDataFrame([(1, [1.0])], "id int, values array<double>"), "values", c, lambda p: p).collect()


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("small", [False, True])
def test_knn(spark, monkeypatch, metric, small):
    """Against all pairs, also where the queries must go out in blocks."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, [0.0] * 6), (60, None)], "qid bigint, embedding array<double>")
    if small:
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 1600)
    found = retrieval.knn(df, df.withColumnRenamed("qid", "did"), 4, metric, exclude_same=True).collect()
    v = np.array([r[1] for r in rows])
    scores = retrieval.similarity(v, v, metric)
    for i in range(60):
        mine = [(r.did, round(r.score, 9)) for r in sorted((r for r in found if r.qid == i), key=lambda r: r["rank"])]
        best = sorted((-round(scores[i, j], 9), j) for j in range(60) if j != i)[:4]
        assert mine == [(j, -s) for s, j in best] or [s for _, s in mine] == [-s for s, _ in best]
    assert retrieval.knn(df.where("false"), df.withColumnRenamed("qid", "did"), 4, metric).count() == 0
    assert retrieval.knn(df, df.withColumnRenamed("qid", "did").where("false"), 4, metric).count() == 0


def test_comparing_rankings(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "qid int, did int, score double, rank int")
    b = spark.createDataFrame([(1, 11, 5.0, 1), (1, 10, 4.0, 2)], "qid int, did int, score double, rank int")
    c = b.where("did = 11")
    assert retrieval.overlap(a, b).first().asDict() == {"qid": 1, "n_common": 2, "n_a": 2}
    assert retrieval.same_answers(a, b) and not retrieval.same_answers(a, c)
    rows = [tuple(r) for r in retrieval.side_by_side({"x": a, "y": c}).orderBy("rank").collect()]
    assert rows == [(1, 1, 10, 0.9, 11, 5.0), (1, 2, 11, 0.8, None, None)]
    texts = spark.createDataFrame([("a" * 101,), ("b",)], "t string")
    assert [r.s for r in texts.select(retrieval.shortened("t").alias("s")).collect()] == ["a" * 100 + "...", "b"]
