"""Further named queries: facades, layers with made-up weights, byte kernels, sparse vectors with repeated
indices, configuration and files. They join catalogue.QUERIES when this module is read."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec import api
from loomvec.encoder import HashEncoder
from loomvec.functions import quantization as qz
from loomvec.functions import sequences as sq
from loomvec.functions import series as ts
from loomvec.functions import tokenizer
from loomvec.functions import vectors as vx
from loomvec.operators import neural, pooling, retrieval, sparse
from loomvec.plans.catalogue import ELEMENTS, MODELS, POOL, SIGN_EQUAL, TAIL, TOP5, TOKENS, VALID, PAIRS, V, both_sides, documents_of_tokens, hash_sql, long_form, query, rounded, token_sides, vectors
from loomvec.session import scratch, stored, table
from loomvec.sources import files, registry

# Sparse vectors with repeated indices: sixteen elements under eight indices

PAIR_ARRAY = "transform(slice(v, 1, 16), (x, i) -> named_struct('index', i % 8, 'weight', x))"


def pair_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.expr(PAIR_ARRAY).alias("pairs"))


@query(f"SELECT a.vec_id AS vec_id, round(list_sum(list_transform(range(16), lambda i: a.v[i + 1] * b.v[i % 8 + 1])), 6) + 0.0 AS score FROM ({V}) a JOIN ({V}) b ON b.vec_id = a.vec_id + 1")
def sparse_dot_first_wins(spark, sf_dir):
    """Every vector with the next one: of several weights of an index in the second the first counts."""
    a = pair_arrays(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pairs").alias("other"))
    return rounded(a.join(b, "vec_id").select("vec_id", sq.sparse_dot("pairs", "other").alias("score")))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS index, round(v[i + 1], 6) + 0.0 AS weight FROM (SELECT vec_id, v, unnest(range(8)) AS i FROM ({V}))")
def sparse_postings(spark, sf_dir):
    """Posting rows of arrays of pairs; of several with one index the first counts."""
    return rounded(sparse.postings(pair_arrays(spark, sf_dir), "vec_id", "pairs", vocab_size=8), "weight")


@query(f"SELECT vec_id, vec_id % 9 + 7 < 12 AS ok FROM ({V})")
def sparse_bounds(spark, sf_dir):
    """Whether all indices lie in a vocabulary of twelve."""
    moved = pair_arrays(spark, sf_dir).withColumn("pairs", F.expr("transform(pairs, p -> named_struct('index', p.index + vec_id % 9, 'weight', p.weight))"))
    return moved.select("vec_id", sq.in_vocabulary("pairs", 12).alias("ok"))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS pos, round(v[i + 9], 6) + 0.0 AS x FROM (SELECT vec_id, v, unnest(range(6)) AS i FROM ({V}))")
def sparse_to_dense(spark, sf_dir):
    """The full vector over six indices: a later weight of an index wins, indices beyond are dropped."""
    return long_form(pair_arrays(spark, sf_dir).withColumn("w", sq.dense_vector("pairs", 6)), "w", "x", "vec_id")


# Shapes and pooling


@query(f"SELECT vec_id, CAST((i - 1) // 16 AS INTEGER) AS row, CAST((i - 1) % 16 AS INTEGER) AS pos, round(v[i], 6) + 0.0 AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM ({V}))")
def reshape_rows(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(sq.reshape("v", 16)).alias("row", "r"))
    return long_form(rows, "r", "x", "vec_id", "row")


@query(f"SELECT vec_id, true AS same FROM ({V})")
def flatten_round_trip(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", (sq.flatten_rows(sq.reshape("v", 8)) == F.col("v")).alias("same"))


@query(POOL.format("avg(x)"))
def pool_token_mean(spark, sf_dir):
    """The mean of all tokens, masked or not."""
    return long_form(documents_of_tokens(spark, sf_dir).withColumn("p", pooling.token_mean("t")), "p", "x", "doc_id")


# Placement of truncation, and layers

STAGES = ("truncate_hidden", "truncate_output", "truncate_pooled")
WEIGHT = "((o * 7 + i * 3) % 5 - 2) / 4.0::DOUBLE"


def weight_rows(outputs: int, inputs: int) -> list[list[float]]:
    return [[((o * 7 + i * 3) % 5 - 2) / 4 for i in range(inputs)] for o in range(outputs)]


def projected(v: str, width: int) -> str:
    return f"list_sum(list_transform(range({width}), lambda i: {v}[i + 1] * {WEIGHT}))"


@query(f"""SELECT vec_id, s.stage AS stage, CAST(o AS INTEGER) AS pos, round(CASE WHEN s.stage = 'truncate_hidden' THEN {projected("v", 8)} ELSE {projected("v", 64)} END, 6) + 0.0 AS x
FROM ({V}), range(12) t(o), (VALUES ('truncate_hidden'), ('truncate_output'), ('truncate_pooled')) s(stage) WHERE s.stage = 'truncate_hidden' OR o < 8""")
def truncation_stages(spark, sf_dir):
    """Twelve outputs of a projection of vectors shortened to eight before it, or after it."""
    out = None
    for name in STAGES:
        stage = vx.TruncationStage.parse(name)
        weights = weight_rows(12, 8 if stage is vx.TruncationStage.HIDDEN else 64)
        own = long_form(vectors(spark, sf_dir).withColumn("w", vx.truncate_and_project("v", 8, stage, weights)), "w", "x", "vec_id").withColumn("stage", F.lit(stage.value))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""SELECT vec_id, CAST(o AS INTEGER) AS pos, round(list_sum(list_transform(range(6), lambda h: greatest(hidden[h + 1], 0.0) * ((o * 7 + h * 3) % 5 - 2) / 4.0::DOUBLE)) + {projected("v", 64)}, 6) + 0.0 AS x
FROM (SELECT vec_id, v, list_transform(range(6), lambda o: {projected("v", 64)}) AS hidden FROM ({V})), range(3) t(o)""")
def residual_mlp(spark, sf_dir):
    layer = neural.ResidualMlp(*(neural.Linear(np.array(weight_rows(*shape))) for shape in ((6, 64), (3, 6), (3, 64))))
    return long_form(neural.apply_rows(vectors(spark, sf_dir), "v", layer, "w"), "w", "x", "vec_id")


ERF = "(2 / sqrt(pi()) * list_sum(list_transform(range(0, 40), lambda n: pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))"


@query(f"""WITH h AS (SELECT vec_id, list_transform(list_transform(range(8), lambda o: {projected("v", 64)} + o / 8.0::DOUBLE), lambda x: x * 0.5 * (1 + {ERF.format(x="(x / sqrt(2.0::DOUBLE))")})) AS g FROM ({V})),
n AS (SELECT vec_id, list_transform(g, lambda x: (x - list_avg(g)) / sqrt(list_avg(list_transform(g, lambda y: (y - list_avg(g)) * (y - list_avg(g)))) + 1e-12)) AS z FROM h)
SELECT vec_id, CAST(o AS INTEGER) AS pos, round(list_sum(list_transform(range(8), lambda i: (z[i + 1] * (i + 1) / 4.0::DOUBLE + 0.1::DOUBLE) * {WEIGHT})), 6) + 0.0 AS x FROM n, range(5) t(o)""")
def mlm_head(spark, sf_dir):
    """Vocabulary scores: dense layer, gelu, normalisation, decoder."""
    head = neural.MaskedLanguageHead(neural.Linear(np.array(weight_rows(8, 64)), np.arange(8) / 8), np.arange(1, 9) / 4, np.full(8, 0.1), neural.Linear(np.array(weight_rows(5, 8))))
    return long_form(neural.apply_rows(vectors(spark, sf_dir), "v", head, "w"), "w", "x", "vec_id")


# Quantisation: bytes, the way back, the facade

NEXT = f"({VALID}) q JOIN ({VALID}) d ON d.doc_id = q.doc_id + 1"
NEXT_BYTES = "SELECT doc_id, round(sum(m), 6) AS score FROM (SELECT q.doc_id AS doc_id, q.tok_pos, max({}) AS m FROM " + NEXT + " GROUP BY ALL) GROUP BY doc_id"


def with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of tokens beside the next one."""
    q, d = token_sides(spark, sf_dir)
    return q.select(F.col("qid").alias("doc_id"), "q").join(d.select((F.col("did") - 1).alias("doc_id"), "d"), "doc_id")


@query(NEXT_BYTES.format(SIGN_EQUAL))
def quantized_maxsim_next(spark, sf_dir):
    """Late interaction on packed bytes."""
    score = qz.quantized_maxsim(qz.quantize_tokens("q"), qz.quantize_tokens("d"), 64)
    return with_next(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"))


@query(NEXT_BYTES.format(f"{SIGN_EQUAL} + 64").replace("SELECT doc_id, round", "SELECT doc_id, CAST(64 AS INTEGER) AS original_dim, CAST(count(*) AS INTEGER) AS num_tokens, round"))
def facade_quantized(spark, sf_dir):
    """The multi-vector embedder's quantize and similarity_quantized, of a model of 128 dimensions on vectors of 64."""
    e = api.MultiVectorEmbedder.builder().model("colbert-v2").quantization("binary").build()
    both = with_next(spark, sf_dir).select("doc_id", e.quantize("q").alias("q"), e.quantize("d").alias("d"))
    return both.select("doc_id", F.col("q.original_dim").alias("original_dim"), F.col("q.num_tokens").alias("num_tokens"), F.round(e.similarity_quantized("q", "d"), 6).alias("score"))


@query(f"SELECT doc_id, round(sum(m), 6) + 0.0 AS score FROM (SELECT q.doc_id AS doc_id, q.tok_pos, max(list_dot_product(q.v, d.v)) AS m FROM {NEXT} GROUP BY ALL) GROUP BY doc_id")
def facade_multi(spark, sf_dir):
    """The multi-vector embedder's similarity."""
    e = api.MultiVectorEmbedder.new("colbert-v2")
    return rounded(with_next(spark, sf_dir).select("doc_id", e.similarity("q", "d").alias("score")))


@query(f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(round_even((v[i] - lo) / scale, 0) * scale + lo, 6) + 0.0 AS x
FROM (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 15.0::DOUBLE ELSE 1.0 END AS scale FROM (SELECT vec_id, v, g, list_min(v[g * 32 + 1 : g * 32 + 32]) AS lo, list_max(v[g * 32 + 1 : g * 32 + 32]) AS hi, unnest(range(g * 32 + 1, g * 32 + 33)) AS i FROM ({V}), range(2) t(g)))""")
def int4_round_trip(spark, sf_dir):
    """Extension: to four bits in groups of 32 and back."""
    packed = vectors(spark, sf_dir).select("vec_id", qz.int4_quantize("v").alias("q"))
    return long_form(packed.withColumn("w", qz.int4_dequantize("q", 64)), "w", "x", "vec_id")


@query(f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((least(greatest(round_even((v[i] - lo) / scale, 0), 0), 255)) * scale + lo, 6) + 0.0 AS x
FROM (SELECT vec_id, v, lo, (hi - lo) / 255.0::DOUBLE AS scale, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM ({V})))""")
def int8_round_trip(spark, sf_dir):
    """Extension: to eight bits by each vector's own range and back."""
    coded = vectors(spark, sf_dir).select("vec_id", qz.int8_quantize("v", F.array_min("v"), F.array_max("v")).alias("q"))
    return long_form(coded.withColumn("w", qz.int8_dequantize("q")), "w", "x", "vec_id")


@query(f"SELECT a.vec_id AS vec_id, 0.0::DOUBLE AS score FROM ({V}) a JOIN ({V}) b ON b.vec_id = a.vec_id + 1")
def hamming_other_dimension(spark, sf_dir):
    """Vectors of different dimensions have similarity 0."""
    b = vectors(spark, sf_dir).select("vec_id", qz.pack_bits("v").alias("a"))
    other = vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), qz.pack_bits(F.slice("v", 1, 32)).alias("b"))
    return b.join(other, "vec_id").select("vec_id", qz.hamming_similarity("a", "b", 64, 32).alias("score"))


# Embedders over texts

ITEMS = f"SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM ({hash_sql('item_id', 'benchmark')})"


@query(f"SELECT a.doc_id AS item_id, round(list_dot_product(a.u, b.u), 6) + 0.0 AS score FROM ({ITEMS}) a JOIN ({ITEMS}) b ON b.doc_id = a.doc_id + 1")
def facade_dense(spark, sf_dir):
    """The dense embedder: every benchmark item with the next one."""
    e = api.DenseEmbedder.builder().model(next(r.id for r in registry.rows() if r.model_type == "Dense")).encoder(HashEncoder(8)).build()
    a = e.encode(table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", "embedding")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("other"))
    return rounded(a.join(b, "item_id").select("item_id", e.similarity("embedding", "other").alias("score")))


PLACES = r"SELECT item_id, i, ln(1 + count(*)) AS w FROM (SELECT item_id, CAST(('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '\p{L}+'))), 1, 8)) AS BIGINT) % {n} AS i FROM benchmark) GROUP BY ALL"
SPARSE_MODEL = next(r for r in registry.rows() if r.model_type == "Sparse")


@query(f"SELECT item_id, round(coalesce(s, 0), 6) AS score FROM (SELECT a.item_id AS item_id, sum(a.w * b.w) AS s FROM ({{0}}) a LEFT JOIN ({{0}}) b ON b.item_id = a.item_id + 1 AND b.i = a.i GROUP BY a.item_id) WHERE item_id + 1 IN (SELECT item_id FROM benchmark)".format(PLACES.replace("{n}", str(SPARSE_MODEL.vocab_size))))
def facade_sparse(spark, sf_dir):
    """The sparse embedder: every benchmark item with the next one."""
    e = api.SparseEmbedder.new(SPARSE_MODEL.id)
    a = e.encode(table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", "embedding")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("other"))
    return rounded(a.join(b, "item_id").select("item_id", e.similarity("embedding", "other").alias("score")))


@dataclass(frozen=True)
class Given:
    """Stands for an image encoder: the vectors are in the input already."""

    dimension: int
    kind: str = "patch"

    def transform(self, df: DataFrame, in_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, F.col(in_col).cast("array<array<double>>"))


@query(f"SELECT doc_id, tok_pos, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, tok_pos)), 6) + 0.0 AS x FROM ({ELEMENTS}) WHERE tok_pos < 4")
def facade_vision(spark, sf_dir):
    """The vision embedder: the first patches of every page, here four, of unit length."""

    class Small(api.VisionEmbedder):
        IMAGE, PATCH = 28, 14

    e = Small.new(next(r.id for r in registry.rows() if r.model_type == "VisionLanguage"))
    pages = e.encode_document(documents_of_tokens(spark, sf_dir), Given(64), "t").select("doc_id", F.posexplode("embedding").alias("tok_pos", "v"))
    return long_form(pages, "v", "x", "doc_id", "tok_pos")


@query(f"SELECT id, CASE model_type WHEN 'Dense' THEN 'DenseEmbedder' WHEN 'Colbert' THEN 'MultiVectorEmbedder' WHEN 'Sparse' THEN 'SparseEmbedder' WHEN 'VisionLanguage' THEN 'VisionEmbedder' ELSE 'TimeSeriesEmbedder' END AS kind, dim FROM {MODELS} WHERE model_type <> 'Unified' AND (model_type <> 'Timeseries' OR id = 'chronos-bolt-small')")
def embedder_kinds(spark, sf_dir):
    """What the factory builds for each model that has an embedder."""
    able = [r for r in registry.rows() if r.model_type != "Unified" and r.model_type != "Timeseries" or r.id in api.TimeSeriesEmbedder.SUPPORTED]
    built = [(r.id, type(e).__name__, e.dimension()) for r in able for e in [api.embedder(r.id)]]
    return spark.createDataFrame(built, "id string, kind string, dim int")


@query("SELECT item_id, text AS decoded, true AS whole FROM benchmark")
def tokenizer_round_trip(spark, sf_dir):
    """Ids by a tokenizer's file, their mask as long, and the text again."""
    path = "/opt/tokenizers/byte_bpe_50k.json"
    ids = tokenizer.encode(table(spark, sf_dir, "benchmark").select("item_id", "text"), path)
    back = tokenizer.decode(ids, path)
    return back.select("item_id", "decoded", (F.size("token_ids") == sq.valid_tokens("attention_mask")).alias("whole"))


# Comparison of rankings


@query(f"""WITH f AS ({TOP5.format(PAIRS.format("list_cosine_similarity(q.v, d.v)") + " WHERE q.vec_id <> d.vec_id")}), s AS ({TOP5.format(PAIRS.format("list_cosine_similarity(q.v[1:16], d.v[1:16])") + " WHERE q.vec_id <> d.vec_id")})
SELECT 'itself' AS other, true AS same UNION ALL SELECT 'short', NOT EXISTS (SELECT qid, did FROM f EXCEPT SELECT qid, did FROM s) AND NOT EXISTS (SELECT qid, did FROM s EXCEPT SELECT qid, did FROM f)""")
def ranking_equality(spark, sf_dir):
    """Whether rankings have the same documents: of whole vectors, and of shortened ones."""
    with scratch(spark):
        full, short = (stored(retrieval.knn(*both_sides(spark, sf_dir, dims), 5, "cosine", exclude_same=True).select("qid", "did"), "ranking") for dims in (None, 16))
        return spark.createDataFrame([("itself", retrieval.same_answers(full, full)), ("short", retrieval.same_answers(full, short))], "other string, same boolean")


# Forecasts

CONFIG = replace(ts.ForecastConfig.custom(32, 4), patch_size=8, quantiles=(0.1, 0.5, 0.9))
FORECAST = f"SELECT user_id, t.step AS step, l.level AS level, avg(value) FILTER (pos % 8 = t.step) + (l.level - 1) * (avg(abs(value)) + 1e-10) AS x FROM ({TAIL}), range(4) t(step), range(3) l(level) GROUP BY user_id, t.step, l.level"


def mean_patch(patches: np.ndarray) -> np.ndarray:
    """A made-up network: the mean patch's first steps, with levels one apart."""
    steps = patches.mean(1)[:, : CONFIG.prediction_length]
    return (steps[:, :, None] + np.arange(3)[None, None, :] - 1).reshape(len(patches), -1)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and the last 32 values of users with so many."""
    last = ts.tail_rows(table(spark, sf_dir, "events"), "user_id", 32, "ts", "event_id")
    return last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.forecast_quantiles(contexts(spark, sf_dir), "values", CONFIG, mean_patch)


@query(f"SELECT user_id, CAST(step AS INTEGER) AS step, CAST(level AS INTEGER) AS level, round(x, 6) + 0.0 AS x FROM ({FORECAST})")
def forecast_quantiles(spark, sf_dir):
    """Scaled, cut into patches, through a network, scaled back."""
    steps = forecasts(spark, sf_dir).select("user_id", F.posexplode("quantiles").alias("step", "q"))
    return rounded(steps.select("user_id", "step", F.posexplode("q").alias("level", "x")), "x")


@query(f"SELECT user_id, CAST(step AS INTEGER) AS step, CAST(32 + step AS INTEGER) AS at, round(x, 6) + 0.0 AS value, step < 2 AS first FROM ({FORECAST}) WHERE level = 1 AND step IN ({', '.join(map(str, ts.key_steps(4)))})")
def forecast_axis(spark, sf_dir):
    """The median at the key steps, placed on the axis after its context; and which are among the first two."""
    median = F.transform("quantiles", lambda q: ts.median_forecast(q, CONFIG.quantiles))
    rows = forecasts(spark, sf_dir).select("user_id", F.explode(ts.forecast_steps(median, F.size("values"))).alias("s")).select("user_id", "s.step", "s.at", "s.value")
    return rounded(rows.where(F.col("step").isin(ts.key_steps(4))), "value").withColumn("first", F.col("step") < 2)


@query("SELECT * FROM (VALUES ('small', 512, 6, 2048, 64, 64, true), ('base', 768, 12, 2048, 64, 64, true), ('custom', 512, 6, 96, 7, 3, true), ('odd', 512, 6, 100, 7, 3, false), ('chronos-t5-base', 768, 12, 2048, 64, 64, true), ('chronos-bolt-small', 512, 6, 2048, 64, 64, true)) t(name, d_model, layers, context_length, prediction_length, patches, valid)")
def forecast_configs(spark, sf_dir):
    """Presets, the choice by a model's id, and validation."""
    c = ts.ForecastConfig
    made = {"small": c.small(), "base": c.base(), "custom": c.custom(96, 7), "odd": c.custom(100, 7), "chronos-t5-base": c.for_model("chronos-t5-base"), "chronos-bolt-small": c.for_model("chronos-bolt-small")}

    def valid(config: ts.ForecastConfig) -> bool:
        try:
            return config.validate() is config
        except api.ConfigError:
            return False

    rows = [(k, x.d_model, x.layers, x.context_length, x.prediction_length, x.context_length // x.patch_size, valid(x)) for k, x in made.items()]
    return spark.createDataFrame(rows, "name string, d_model int, layers int, context_length int, prediction_length int, patches int, valid boolean")


# Files and images


@query("SELECT CAST(s AS INTEGER) AS size, CAST(p AS INTEGER) AS patch, CAST((s // p) * (s // p) AS BIGINT) AS n FROM range(14, 460, 7) t(s), range(2, 33, 5) u(p)")
def patch_counts(spark, sf_dir):
    sizes, patches = spark.range(14, 460, 7).select(F.col("id").cast("int").alias("size")), spark.range(2, 33, 5).select(F.col("id").cast("int").alias("patch"))
    return sizes.crossJoin(F.broadcast(patches)).withColumn("n", files.patch_count(F.col("size"), F.col("patch")).cast("bigint"))


CUBIC = ", ".join(f"({o}, {i}, {float(w)!r}::DOUBLE)" for o, row in enumerate(files.cubic_weights(8, 5)) for i, w in enumerate(row))
PIXEL = "(image * 192 + c * 64 + y * 8 + x) * 37 % 256"


@query(f"""WITH w(o, i, w) AS (VALUES {CUBIC})
SELECT image, CAST(a.o AS INTEGER) AS row, CAST(b.o AS INTEGER) AS col, CAST(c AS INTEGER) AS channel, CAST(least(greatest(round_even(sum(a.w * b.w * ({PIXEL})), 0), 0), 255) AS INTEGER) AS p
FROM range(10) t(image), range(3) u(c), range(8) r(y), range(8) s(x), w a, w b WHERE a.i = y AND b.i = x GROUP BY ALL""")
def image_resize(spark, sf_dir):
    """Ten made-up images of 8 by 8 in 5 by 5."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for image in batch.column(0).to_pylist():
                y, x, c = np.meshgrid(np.arange(8), np.arange(8), np.arange(3), indexing="ij")
                small = files.resize(((image * 192 + c * 64 + y * 8 + x) * 37 % 256).astype(np.uint8), 5, 5)
                at = np.indices(small.shape).reshape(3, -1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"image": np.full(small.size, image), **dict(zip(("row", "col", "channel"), at)), "p": small.ravel().astype(np.int32)})

    return spark.range(10).mapInArrow(run, "image bigint, row int, col int, channel int, p int")


@query("SELECT CAST(m AS BIGINT) AS model, list_sort(list_distinct(list_transform(range(12), lambda i: 'part-' || (i * m) % 5 || '.safetensors'))) AS names FROM range(1, 20) t(m)")
def shard_index(spark, sf_dir):
    """The distinct file names of made-up weight maps."""
    entries = F.expr("to_json(named_struct('weight_map', map_from_entries(transform(sequence(0, 11), i -> struct(concat('layer.', i), concat('part-', (i * model) % 5, '.safetensors'))))))")
    return spark.range(1, 20).select(F.col("id").alias("model")).withColumn("json", entries).select("model", files.shard_names("json").alias("names"))


CONFIGS = (
    ("BertModel", "bert", "hidden_size"), ("JinaBertModel", "bert", "hidden_size"), ("X", "DistilBERT", "dim"), ("X", "jina_clip", "hidden_size"), ("X", "XLM-RoBERTa", "hidden_size"), ("X", "ModernBERT", "hidden_size"),
    ("X", None, "dim"), ("X", None, "hidden_size"), ("X", "t5", "hidden_size"), ("X", "other", "size"),
)


def like(part: str, family: str) -> str:
    return f"WHEN lower(m) LIKE '%{part}%' THEN '{family}'"


@query("SELECT n, CASE WHEN lower(a) LIKE '%jinabert%' THEN 'jinabert' {} WHEN s = 'dim' THEN 'distilbert' WHEN s = 'hidden_size' THEN 'bert' END AS dense, CASE {} WHEN s = 'dim' THEN 'distilbert' WHEN s = 'hidden_size' THEN 'bert' END AS multi, CASE {} WHEN s = 'dim' THEN 'distilbert' WHEN s = 'hidden_size' THEN 'bert' END AS sparse FROM (VALUES {}) t(n, a, m, s)".format(
    " ".join(like(*x) for x in (("distilbert", "distilbert"), ("jina", "jinabert"), ("xlm%roberta", "xlm-roberta"), ("modernbert", "modernbert"), ("bert", "bert"))),
    " ".join(like(*x) for x in (("distilbert", "distilbert"), ("jina", "jinabert"), ("bert", "bert"))),
    " ".join(like(*x) for x in (("distilbert", "distilbert"), ("bert", "bert"))),
    ", ".join(f"({n}, '{a}', {'NULL' if m is None else repr(m)}, '{s}')" for n, (a, m, s) in enumerate(CONFIGS)),
))
def model_families(spark, sf_dir):
    """The network that a configuration names, by each kind of encoder's rules, with the fallback on its sizes."""
    import json

    rows = [(n, json.dumps({"architectures": [a], s: 768} | ({} if m is None else {"model_type": m}))) for n, (a, m, s) in enumerate(CONFIGS)]
    configs = spark.createDataFrame(rows, "n int, config string")
    return configs.select("n", *(files.model_family("config", kind).alias(kind) for kind in ("dense", "multi", "sparse")))


# Registry look-ups


@query(f"SELECT id, dim FROM {MODELS} WHERE model_type = 'Dense'")
def registry_type(spark, sf_dir):
    return registry.models_by_type(registry.registry(spark), "Dense").select("id", F.col("embedding_dim.default").alias("dim"))


@query(f"SELECT id, hf AS huggingface_id, ctx AS context_length FROM {MODELS}")
def registry_by_id(spark, sf_dir):
    """Every model looked up by its id."""
    found = [registry.get_model(r.id) for r in registry.rows()]
    return spark.createDataFrame([(m.id, m.huggingface_id, m.context_length) for m in found], "id string, huggingface_id string, context_length int")


@query(f"SELECT id, CASE WHEN min_dim IS NULL THEN CAST(dim AS VARCHAR) ELSE dim || ' (Matryoshka: ' || min_dim || '-' || max_dim || ')' END AS shown, list_contains(supported, 100) AS has_100 FROM {MODELS}")
def registry_dimension_text(spark, sf_dir):
    """How a model's dimensions are shown, and that only listed ones are supported."""
    return spark.createDataFrame([(r.id, r.dimension_text(), r.supports_dimension(100)) for r in registry.rows()], "id string, shown string, has_100 boolean")


@query(f"SELECT id, d AS target_dimension, d AS embedding_dim, ctx AS max_seq_length FROM (SELECT id, ctx, unnest(supported) AS d FROM {MODELS})")
def registry_config(spark, sf_dir):
    """A configuration for each model and supported dimension."""
    made = [(r.id, registry.ModelConfig.from_registry(r.id, d)) for r in registry.rows() for d in r.supported_dimensions]
    return spark.createDataFrame([(i, c.target_dimension, c.embedding_dim, c.max_seq_length) for i, c in made], "id string, target_dimension int, embedding_dim int, max_seq_length int")


@query(f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n_vectors, CAST(64 AS INTEGER) AS dim, format('{{:.4f}}', round(list_sum(arg_min(v, tok_pos)), 4) + 0.0) AS shown FROM ({TOKENS}) GROUP BY doc_id")
def accessors(spark, sf_dir):
    """Number of vectors, dimension, and a score as it is shown."""
    d = documents_of_tokens(spark, sf_dir)
    first = vx.total(vx.doubles(F.element_at("t", 1)))
    return d.select("doc_id", F.size("t").alias("n_vectors"), F.size(F.element_at("t", 1)).alias("dim"), F.format_string("%.4f", F.round(first, 4) + F.lit(0.0)).alias("shown"))
