"""Registry, embedders and their errors, encoders, files, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec import api
from loomvec.encoder import HashEncoder
from loomvec.errors import ConfigError, DeviceError, ModelLoadError, ModelNotFound, QuantizationError, SourceError, UnsupportedDimension
from loomvec.sources import files, registry, series
from loomvec.streaming.windows import windowed


def test_registry(spark):
    models = registry.registry(spark)
    assert models.count() == 22 and registry.violations(models).count() == 0
    m = registry.get_model("colbert-v2")
    assert (m.default_dim, m.context_length) == (128, 512) and m.supports_dimension(128) and not m.supports_dimension(64)
    jina = registry.get_model("jina-colbert-v2")
    assert jina.supports_dimension(64) and jina.supports_dimension(768) and not jina.supports_dimension(100)
    assert registry.model_by_huggingface_id(spark, "jinaai/jina-colbert-v2").first().id == "jina-colbert-v2-64"
    for name in ("nope", "ColBERT-v2"):
        with pytest.raises(ModelNotFound, match=name):
            registry.get_model(name)
    assert registry.models_by_type(models, "Dense").count() == 7 and registry.models_by_organization(models, "jina AI").count() == 7
    broken = models.withColumn("context_length", F.lit(0)).unionAll(models.where("id = 'colbert-v2'"))
    assert {r.rule for r in registry.violations(broken).collect()} == {"context length is positive", "id is unique"}
    c = registry.ModelConfig.from_registry("jina-embeddings-v3", 256)
    assert (c.target_dimension, c.embedding_dim, c.pooling_strategy.lower(), c.normalize_embeddings) == (256, 256, "mean", True)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "machine learning models learn"), (2, "learning machines"), (3, ""), (4, None), (1, "machine learning models learn")], "doc_id int, text string")


def test_dense(texts):
    e = api.DenseEmbedder.builder().model("nomic-embed-v1.5").dimension(64).encoder(HashEncoder(768)).build()
    assert (e.dimension(), e.model()) == (64, "nomic-embed-v1.5")
    small = api.DenseEmbedder.builder().model("nomic-embed-v1.5").dimension(64).encoder(HashEncoder(96)).build()
    rows = small.encode(texts).collect()
    assert len(rows) == 5
    by_id = {r.doc_id: r.embedding for r in rows}
    assert len(by_id[1]) == 64 and abs(np.linalg.norm(by_id[1]) - 1) < 1e-9 and set(by_id[3]) == {0.0} and by_id[4] is None
    pair = small.encode(texts.where("doc_id < 3")).select(small.similarity("embedding", "embedding").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in pair)


def test_multi_vector(texts):
    e = api.MultiVectorEmbedder.builder().model("colbert-v2").quantization("binary").encoder(HashEncoder(16, "multi")).build()
    r = e.encode_quantized(texts.where("doc_id = 2")).first().embedding
    assert (r.original_dim, r.num_tokens, len(r.quantized), len(r.quantized[0])) == (16, 2, 2, 2)
    plain = api.MultiVectorEmbedder.new("colbert-small")
    for f in (plain.quantize, lambda x: plain.similarity_quantized(x, x)):
        with pytest.raises(QuantizationError, match="No quantizer"):
            f("embedding")
    scored = api.MultiVectorEmbedder.builder().model("colbert-v2").encoder(HashEncoder(8, "multi")).build()
    both = scored.encode(texts.where("doc_id < 3").dropDuplicates(["doc_id"]))
    pairs = both.select(F.col("doc_id").alias("a"), F.col("embedding").alias("q")).crossJoin(both.select(F.col("doc_id").alias("b"), F.col("embedding").alias("d")))
    s = {(r.a, r.b): r.s for r in pairs.select("a", "b", scored.similarity("q", "d").alias("s")).collect()}
    assert s[1, 1] > s[1, 2] and s[2, 2] > s[2, 1]


def test_sparse(texts):
    e = api.SparseEmbedder.new("splade-v3")
    assert e.vocab_size() == 30522
    rows = {r.doc_id: r.embedding for r in e.encode(texts).collect()}
    assert len(rows[1]) == 4 and all(0 <= p["index"] < 30522 and p.weight > 0 for p in rows[1]) and rows[3] == [] and rows[4] is None


def test_vision_and_series(spark):
    v = api.VisionEmbedder.new("colpali-v1.3-hf")
    assert v.num_patches() == 1024
    with pytest.raises(ConfigError, match="Model ID is required"):
        api.VisionEmbedder.builder().build()
    t = api.TimeSeriesEmbedder.new("chronos-bolt-small")
    assert (t.context_length(), t.prediction_length(), len(t.quantiles())) == (2048, 64, 9)
    df = spark.createDataFrame([(1, [1.0, -1.0] * 1024)], "id int, values array<double>")
    out = t.forecast(df, lambda p: np.tile(np.arange(9.0), (len(p), 64))).first().forecast
    assert len(out) == 64 and np.allclose(out, 4)
    with pytest.raises(ConfigError):
        api.TimeSeriesEmbedder.new("timesfm-1.0-200m")


def test_builder_errors():
    with pytest.raises(ConfigError, match="Model ID must be specified"):
        api.DenseEmbedder.builder().build()
    with pytest.raises(ModelNotFound):
        api.DenseEmbedder.new("nope")
    with pytest.raises(ConfigError, match="is a Sparse model"):
        api.DenseEmbedder.new("splade-v3")
    with pytest.raises(UnsupportedDimension, match="100"):
        api.DenseEmbedder.builder().model("nomic-embed-v1.5").dimension(100).build()
    for kind in ("int8", "int4"):
        with pytest.raises(QuantizationError, match="not yet implemented"):
            api.MultiVectorEmbedder.builder().model("colbert-v2").quantization(kind).build()
    with pytest.raises(ConfigError):
        api.embedder("bge-m3-multi")
    with pytest.raises(DeviceError):
        api.DenseEmbedder.builder().device("cuda")
    assert api.DenseEmbedder.builder().device("cpu").yield_ms(5).model("bge-base-en-v1.5").build().dimension() == 768
    assert type(api.embedder("colbert-v2")) is api.MultiVectorEmbedder and type(api.embedder("splade-v3")) is api.SparseEmbedder
    assert issubclass(UnsupportedDimension, ValueError) and issubclass(ModelNotFound, RuntimeError) and issubclass(SourceError, OSError)


def test_numpy_both_ways(spark):
    m = np.random.default_rng(1).random((5, 3)).astype(np.float32)
    assert np.array_equal(files.to_numpy(files.from_numpy(spark, m).orderBy("vec_id")), m)


def test_files(spark, tmp_path):
    header = json.dumps({"w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "__metadata__": {}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + np.arange(4, dtype="<f4").tobytes())
    assert np.array_equal(files.read_safetensors(str(tmp_path / "m.safetensors"))["w"], [[0, 1], [2, 3]])
    (tmp_path / "bad").write_bytes(b"\x01\0\0\0\0\0\0\0{")
    with pytest.raises(ModelLoadError):
        files.read_safetensors(str(tmp_path / "bad"))
    with pytest.raises(SourceError):
        files.local_file(str(tmp_path), "none")
    index = spark.createDataFrame([(json.dumps({"weight_map": {"a": "2.bin", "b": "1.bin", "c": "2.bin"}}),)], "j string")
    assert index.select(files.shard_names("j").alias("n")).first().n == ["1.bin", "2.bin"]
    config = spark.createDataFrame([('{"model_type": "distilbert"}',), ('{"architectures": ["JinaBertModel"]}',), ("{}",)], "c string")
    assert [r.f for r in config.select(files.model_family("c").alias("f")).collect()] == ["distilbert", "jinabert", None]
    half = np.array([1.5, -2.0], dtype="<f4").view("<u4") >> 16
    header = json.dumps({"w": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "half.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + half.astype("<u2").tobytes())
    assert files.read_safetensors(str(tmp_path / "half.safetensors"))["w"].tolist() == [1.5, -2.0]


def test_images(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (10, 10, 3), dtype=np.uint8)
    (tmp_path / "a.raw").write_bytes(image.tobytes())
    decode = lambda b: np.frombuffer(b, np.uint8).reshape(10, 10, 3)
    raw = files.read_images(spark, str(tmp_path))
    out = np.array(files.preprocess(raw, decode, 10).first().pixels).reshape(3, 10, 10)
    expected = ((image / 255 - np.array(files.MEAN)) / np.array(files.DEVIATION)).transpose(2, 0, 1)
    assert np.allclose(out, expected)
    assert files.resize(np.full((7, 5, 3), 9, np.uint8), 14, 10).tolist() == np.full((14, 10, 3), 9).tolist()
    pages = files.read_pages(spark, str(tmp_path), lambda b: iter([b[:3], b[3:6]])).collect()
    assert [(r.page, bytes(r.image)) for r in pages] == [(0, image.tobytes()[:3]), (1, image.tobytes()[3:6])]
    assert files.patch_count(448, 14) == 1024 and files.patch_count(224, 14) == 256


def test_made_up_series(spark):
    for kind in series.KINDS:
        rows = series.synthetic(spark, kind, 100).collect()
        assert [r.t for r in rows] == list(range(100)) and all(np.isfinite(r.value) for r in rows)
        assert rows == series.synthetic(spark, kind, 100).collect()
    with pytest.raises(ValueError):
        series.synthetic(spark, "other")
    assert series.labelled(spark, {"a": ["x", "y"], "b": ["z"]}).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    """Windows over a stream of files: those that the watermark closes equal the batch's."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).select("window_start", "event_type", "n").collect()}
    expected = {tuple(r) for r in windowed(events).select("window_start", "event_type", "n").collect()}
    assert found and found <= expected and len(found) >= len(expected) - 60
