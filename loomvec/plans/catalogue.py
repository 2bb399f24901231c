"""Every named query of the engine with its DuckDB counterpart. Each runs over its whole tables.

Token matrices are made of `embeddings`: eight consecutive vectors are a document, and of
odd documents the tokens from the seventh on are padding. Series are the values of a
user's events in order of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomvec.encoder import WORD, HashEncoder, words
from loomvec.functions import quantization as qz
from loomvec.functions import sequences as sq
from loomvec.functions import series as ts
from loomvec.functions import vectors as vx
from loomvec.operators import late, neural, pooling, retrieval, sparse
from loomvec.session import table
from loomvec.sources import files, registry
from loomvec.streaming.windows import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# dense vectors

V = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
PAIRS = f"SELECT q.vec_id AS qid, d.vec_id AS did, {{}} AS score FROM ({V}) q, ({V}) d"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def all_pairs(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return retrieval.all_scores(v.withColumnRenamed("vec_id", "qid"), v.withColumnRenamed("vec_id", "did"), metric, "v", digits=6)


@query(PAIRS.format("round(list_dot_product(q.v, d.v), 6) + 0.0"))
def vec_dot_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "dot")


@query(PAIRS.format("round(list_cosine_similarity(q.v, d.v), 6) + 0.0"))
def vec_cosine_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "cosine")


@query(PAIRS.format("round(list_distance(q.v, d.v), 6) + 0.0"))
def vec_euclid_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "euclidean")


@query(f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM ({V})")
def vec_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(vx.l2_norm("v"), 6).alias("norm"))


def long_form(df: DataFrame, column: str, out: str, *keys: str) -> DataFrame:
    """A row for each element, places from 0."""
    return df.select(*keys, F.posexplode(column).alias("pos", "x")).select(*keys, "pos", (F.round("x", 6) + F.lit(0.0)).alias(out))


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / n, 6) + 0.0 AS x FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(1, len(v) + 1)) AS i FROM ({V}))")
def vec_normalize_long(spark, sf_dir):
    unit = vectors(spark, sf_dir).withColumn("n", vx.l2_norm("v")).withColumn("u", vx.l2_normalize("v", F.col("n")))
    return long_form(unit, "u", "x", "vec_id")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (len(list_filter(v, lambda x: NOT isfinite(x))) = 0) AS BIGINT) AS n_finite FROM ({V})")
def vec_finite_check(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(vx.is_finite("v")).alias("n_finite"))


TOP5 = "SELECT qid, did, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM ({})) WHERE rank <= 5"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names or ("score",)})


def both_sides(spark: SparkSession, sf_dir: str, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    v = v.withColumn("embedding", F.col("v") if dims is None else vx.finish_dense("v", dims))
    return v.select(F.col("vec_id").alias("qid"), "embedding"), v.select(F.col("vec_id").alias("did"), "embedding")


@query(TOP5.format(PAIRS.format("list_cosine_similarity(q.v, d.v)") + " WHERE q.vec_id <> d.vec_id"))
def dense_topk(spark, sf_dir):
    """The five nearest others of every vector."""
    return rounded(retrieval.knn(*both_sides(spark, sf_dir), 5, "cosine", exclude_same=True))


@query(f"""WITH c AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM ({V})) GROUP BY i))
SELECT vec_id, round(list_cosine_similarity(v, q), 6) + 0.0 AS score FROM ({V}), c ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 5""")
def dense_search_single(spark, sf_dir):
    """One query, the mean of all vectors: the five nearest, sorted and cut."""
    v = vectors(spark, sf_dir)
    means = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))
    return rounded(v.crossJoin(F.broadcast(centre)).select("vec_id", vx.cosine("v", "q").alias("score")).orderBy(F.desc("score"), "vec_id").limit(5))


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(w[i] / sqrt(list_dot_product(w, w)), 6) + 0.0 AS x FROM (SELECT vec_id, v[1:16] AS w, unnest(range(1, 17)) AS i FROM ({V}))")
def matryoshka_16(spark, sf_dir):
    return long_form(vectors(spark, sf_dir).withColumn("w", vx.finish_dense("v", 16)), "w", "x", "vec_id")


@query(f"""WITH f AS ({TOP5.format(PAIRS.format("list_cosine_similarity(q.v, d.v)") + " WHERE q.vec_id <> d.vec_id")}),
s AS ({TOP5.format(PAIRS.format("list_cosine_similarity(q.v[1:16], d.v[1:16])") + " WHERE q.vec_id <> d.vec_id")})
SELECT f.qid, CAST(count(s.did) AS BIGINT) AS n_common, CAST(count(*) AS BIGINT) AS n_a FROM f LEFT JOIN s ON f.qid = s.qid AND f.did = s.did GROUP BY f.qid""")
def matryoshka_overlap(spark, sf_dir):
    full = retrieval.knn(*both_sides(spark, sf_dir), 5, "cosine", exclude_same=True)
    short = retrieval.knn(*both_sides(spark, sf_dir, 16), 5, "cosine", exclude_same=True)
    return retrieval.overlap(full, short)


@query(f"SELECT label, CAST(i AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM ({V})) GROUP BY label, i")
def category_centroids(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("mean")), "mean")


@query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


WEIGHTS = [[((i * 7 + j * 3) % 5 - 2) / 4 for j in range(64)] for i in range(4)]


@query(f"""SELECT vec_id, CAST(o AS INTEGER) AS pos, round(sum(x * (((o * 7 + i * 3) % 5) - 2) / 4.0), 6) + 0.0 AS x
FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM ({V})), range(4) t(o) GROUP BY vec_id, o""")
def linear_projection(spark, sf_dir):
    """Every vector through a fixed matrix of four rows."""
    import numpy as np

    return long_form(neural.apply_rows(vectors(spark, sf_dir), "v", neural.Linear(np.array(WEIGHTS)), "w"), "w", "x", "vec_id")


# token matrices

TOKENS = "SELECT vec_id // 8 AS doc_id, CAST(vec_id % 8 AS INTEGER) AS tok_pos, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN (vec_id // 8) % 2 = 1 AND vec_id % 8 >= 6 THEN 0 ELSE 1 END AS mask FROM embeddings"
ELEMENTS = f"SELECT doc_id, tok_pos, mask, unnest(v) AS x, CAST(unnest(range(len(v))) AS INTEGER) AS pos FROM ({TOKENS})"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, tok = F.expr("vec_id div 8"), F.expr("cast(vec_id % 8 as int)")
    mask = F.when((doc % 2 == 1) & (tok >= 6), 0).otherwise(1)
    return vectors(spark, sf_dir).select(doc.alias("doc_id"), tok.alias("tok_pos"), "v", mask.alias("mask"))


def documents_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: the token vectors in order, m: their mask."""
    s = tokens(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_pos", "v", "mask"))).alias("s"))
    return s.select("doc_id", F.transform("s", lambda x: x["v"]).alias("t"), F.transform("s", lambda x: x["mask"]).alias("m"))


def pooled(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return long_form(documents_of_tokens(spark, sf_dir).withColumn("p", pooling.pool("t", "m", strategy)), "p", "x", "doc_id")


POOL = f"SELECT doc_id, pos, round({{}}, 6) + 0.0 AS x FROM ({ELEMENTS}) GROUP BY doc_id, pos"


@query(POOL.format("arg_min(x, tok_pos)"))
def pool_cls(spark, sf_dir):
    return pooled(spark, sf_dir, "cls")


@query(POOL.format("coalesce(avg(x) FILTER (mask = 1), 0.0)"))
def pool_mean(spark, sf_dir):
    return pooled(spark, sf_dir, "mean")


@query(POOL.format("coalesce(max(x) FILTER (mask = 1), 0.0)"))
def pool_max(spark, sf_dir):
    return pooled(spark, sf_dir, "max")


@query(POOL.format("coalesce(arg_max(x, tok_pos) FILTER (mask = 1), arg_min(x, tok_pos))"))
def pool_last(spark, sf_dir):
    return pooled(spark, sf_dir, "last_token")


@query(f"SELECT doc_id, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY doc_id)), 6) + 0.0 AS x FROM (SELECT doc_id, pos, avg(x) FILTER (mask = 1) AS m FROM ({ELEMENTS}) GROUP BY doc_id, pos)")
def pool_mean_l2(spark, sf_dir):
    d = documents_of_tokens(spark, sf_dir).withColumn("p", pooling.mean("t", "m"))
    return long_form(d.withColumn("n", vx.l2_norm("p")).withColumn("u", vx.l2_normalize("p", F.col("n"))), "u", "x", "doc_id")


@query(POOL.format("coalesce(avg(x) FILTER (mask = 1), 0.0)"))
def pool_mean_long(spark, sf_dir):
    elements = tokens(spark, sf_dir).select("doc_id", "tok_pos", "mask", F.posexplode("v").alias("pos", "x"))
    return rounded(pooling.pool_long(elements, "mean", dim="pos", value="x"), "x")


@query(f"SELECT doc_id, pos AS index, round(w, 6) AS weight FROM (SELECT doc_id, pos, max(ln(1 + greatest(x, 0.0))) FILTER (mask <> 0) AS w FROM ({ELEMENTS}) GROUP BY doc_id, pos) WHERE w > 1e-6")
def splade_weights(spark, sf_dir):
    elements = tokens(spark, sf_dir).select("doc_id", "tok_pos", "mask", F.posexplode("v").alias("index", "v"))
    return rounded(pooling.splade_pool(elements), "weight")


@query(f"SELECT doc_id, CAST(sum(mask) AS INTEGER) AS n_valid, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum(CASE WHEN mask <> 1 THEN 1 ELSE 0 END) AS INTEGER) AS n_masked FROM ({TOKENS}) GROUP BY doc_id")
def mask_counts(spark, sf_dir):
    d = documents_of_tokens(spark, sf_dir)
    inverted = F.aggregate(sq.invert_mask("m"), F.lit(0), lambda s, x: s + x)
    return d.select("doc_id", sq.valid_tokens("m").alias("n_valid"), F.size("t").alias("n_tokens"), inverted.alias("n_masked"))


@query(f"SELECT doc_id, tok_pos, CAST(unnest(range(len(v))) AS INTEGER) AS pos, round(unnest(v), 6) + 0.0 AS x FROM (SELECT *, sum(mask) OVER (PARTITION BY doc_id) AS n FROM ({TOKENS})) WHERE tok_pos < n")
def unpad_tokens(spark, sf_dir):
    d = documents_of_tokens(spark, sf_dir).select("doc_id", F.posexplode(sq.unpad("t", "m")).alias("tok_pos", "v"))
    return long_form(d, "v", "x", "doc_id", "tok_pos")


VALID = f"SELECT doc_id, tok_pos, v FROM ({TOKENS}) WHERE mask = 1"
TOKEN_PAIRS = f"SELECT q.doc_id AS qid, d.doc_id AS did, q.tok_pos, {{}} AS s FROM ({VALID}) q, ({VALID}) d"
MAXSIM = f"SELECT qid, did, sum(m) AS score FROM (SELECT qid, did, tok_pos, max(s) AS m FROM ({TOKEN_PAIRS.format('list_dot_product(q.v, d.v)')}) GROUP BY ALL) GROUP BY qid, did"


def token_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = documents_of_tokens(spark, sf_dir).select("doc_id", sq.unpad("t", "m").alias("t"))
    return d.select(F.col("doc_id").alias("qid"), F.col("t").alias("q")), d.select(F.col("doc_id").alias("did"), F.col("t").alias("d"))


@query(f"SELECT qid, did, round(score, 6) + 0.0 AS score FROM ({MAXSIM})")
def maxsim_pairs(spark, sf_dir):
    q, d = token_sides(spark, sf_dir)
    return late.maxsim_scores(q, d, digits=6)


@query(TOP5.format(MAXSIM))
def maxsim_topk(spark, sf_dir):
    q, d = token_sides(spark, sf_dir)
    return rounded(late.maxsim_knn(q, d, 5))


@query(TOP5.format(f"SELECT qid, did, max(s) AS score FROM ({TOKEN_PAIRS.format('list_cosine_similarity(q.v, d.v)')}) WHERE qid <> did GROUP BY qid, did"))
def maxpair_cosine_topk(spark, sf_dir):
    q, d = token_sides(spark, sf_dir)
    return rounded(late.maxsim_knn(q, d, 5, pair=True, exclude_same=True))


# binary quantisation

BYTES = f"SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS pos, CAST(sum(CASE WHEN v[i] >= 0 THEN 1 << ((i - 1) % 8) ELSE 0 END) AS INTEGER) AS byte FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM ({V})) GROUP BY 1, 2"
SIGN_EQUAL = "CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.v[i] >= 0) = (d.v[i] >= 0) THEN 1 ELSE 0 END)) AS DOUBLE)"


@query(BYTES)
def binary_pack(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(qz.pack_bits("v")).alias("pos", "byte"))


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN v[i] >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM ({V}))")
def binary_unpack(spark, sf_dir):
    packed = vectors(spark, sf_dir).select("vec_id", qz.pack_bits("v").alias("b"), F.size("v").alias("dim"))
    return packed.select("vec_id", F.posexplode(qz.unpack_bits("b", F.col("dim"))).alias("pos", "x"))


@query(f"SELECT doc_id, CAST(n * 8 AS BIGINT) AS memory_bytes, n * 64 * 4.0::DOUBLE / (n * 8) AS ratio FROM (SELECT doc_id, count(*) AS n FROM ({TOKENS}) GROUP BY doc_id)")
def binary_memory(spark, sf_dir):
    d = documents_of_tokens(spark, sf_dir).select("doc_id", F.size("t").alias("n"))
    return d.select("doc_id", qz.memory_bytes(F.col("n"), 64).alias("memory_bytes"), qz.compression_ratio(F.col("n"), 64).alias("ratio"))


@query(PAIRS.format(SIGN_EQUAL))
def hamming_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir, "hamming")


@query(TOP5.format(PAIRS.format(SIGN_EQUAL) + " WHERE q.vec_id <> d.vec_id"))
def hamming_topk(spark, sf_dir):
    return retrieval.knn(*both_sides(spark, sf_dir), 5, "hamming", exclude_same=True)


BINARY_MAXSIM = f"SELECT qid, did, sum(m) AS score FROM (SELECT qid, did, tok_pos, max(s) AS m FROM ({TOKEN_PAIRS.format(SIGN_EQUAL)}) GROUP BY ALL) GROUP BY qid, did"


@query(TOP5.format(BINARY_MAXSIM))
def binary_maxsim_topk(spark, sf_dir):
    q, d = token_sides(spark, sf_dir)
    return late.maxsim_knn(q, d, 5, binary=True)


@query(f"""WITH f AS ({TOP5.format(MAXSIM)}), s AS ({TOP5.format(BINARY_MAXSIM)})
SELECT f.qid, CAST(count(s.did) AS BIGINT) AS n_common, CAST(count(*) AS BIGINT) AS n_a FROM f LEFT JOIN s ON f.qid = s.qid AND f.did = s.did GROUP BY f.qid""")
def binary_vs_float_overlap(spark, sf_dir):
    q, d = token_sides(spark, sf_dir)
    return retrieval.overlap(late.maxsim_knn(q, d, 5), late.maxsim_knn(q, d, 5, binary=True))


@query(f"""WITH h AS (SELECT qid, did FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS r FROM ({PAIRS.format(SIGN_EQUAL)})) WHERE r <= 50)
{TOP5.format(f"SELECT h.qid, h.did, list_dot_product(q.v, d.v) AS score FROM h JOIN ({V}) q ON q.vec_id = h.qid JOIN ({V}) d ON d.vec_id = h.did")}""")
def rerank_two_stage(spark, sf_dir):
    """Extension: 50 candidates by sign bits, the best five of them by inner product."""
    return rounded(retrieval.rerank(*both_sides(spark, sf_dir), 5, 50))


@query(f"""WITH r AS (SELECT CAST(i AS INTEGER) AS pos, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM ({V})) GROUP BY i),
e AS (SELECT vec_id, unnest(v) AS x, CAST(unnest(range(len(v))) AS INTEGER) AS pos FROM ({V}))
SELECT vec_id, pos, CAST(least(greatest(round_even((x - lo) / ((hi - lo) / 255.0::DOUBLE), 0), 0), 255) - 128 AS INTEGER) AS code FROM e JOIN r USING (pos)""")
def int8_codes(spark, sf_dir):
    """Extension: every dimension calibrated to its own range, one byte each."""
    e = vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("pos", "x"))
    ranges = e.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    coded = qz.int8_quantize(F.array("x"), F.col("lo"), F.col("hi"))
    return e.join(ranges, "pos").select("vec_id", "pos", F.element_at(coded["values"], 1).cast("int").alias("code"))


# sparse vectors

VOCABULARY = 30522
TERMS = r"SELECT doc_id, term, ln(1 + count(*)) AS weight FROM (SELECT {id} AS doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM {table}) GROUP BY doc_id, term"
DOC_TERMS, ITEM_TERMS = TERMS.format(id="doc_id", table="documents"), TERMS.format(id="item_id", table="benchmark")


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_weights(table(spark, sf_dir, "documents"))


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_weights(table(spark, sf_dir, "benchmark"), "item_id")


@query(f"SELECT doc_id, term, round(weight, 6) AS weight FROM ({DOC_TERMS})")
def sparse_weights(spark, sf_dir):
    return rounded(doc_terms(spark, sf_dir), "weight")


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS nnz, round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight, round(1 - count(*) / {VOCABULARY}.0::DOUBLE, 9) AS sparsity, round(count(*) / {VOCABULARY}.0::DOUBLE, 9) AS density FROM ({DOC_TERMS}) GROUP BY doc_id")
def sparse_statistics(spark, sf_dir):
    s = sparse.statistics(doc_terms(spark, sf_dir), VOCABULARY)
    return s.withColumns({"min_weight": F.round("min_weight", 6), "max_weight": F.round("max_weight", 6), "sparsity": F.round("sparsity", 9), "density": F.round("density", 9)})


SPARSE_DOT = f"SELECT q.doc_id AS qid, d.doc_id AS did, sum(q.weight * d.weight) AS score FROM ({ITEM_TERMS}) q JOIN ({DOC_TERMS}) d USING (term) GROUP BY ALL"


@query(f"SELECT qid, did, round(score, 4) AS score FROM ({SPARSE_DOT})")
def sparse_dot_pairs(spark, sf_dir):
    return sparse.dot_pairs(item_terms(spark, sf_dir), doc_terms(spark, sf_dir), digits=4)


RANK9 = "SELECT qid, did, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM ({})) WHERE rank <= {}"


def rounded4(ranked: DataFrame) -> DataFrame:
    """Rankings are by scores to nine digits, as sums of many terms depend on their order beyond."""
    return ranked.withColumn("score", F.round("score", 4))


@query(RANK9.format(SPARSE_DOT, 10))
def sparse_topk(spark, sf_dir):
    return rounded4(sparse.knn(item_terms(spark, sf_dir), doc_terms(spark, sf_dir), 10, digits=9))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS n_docs, round(sum(weight), 4) AS total FROM ({DOC_TERMS}) GROUP BY term")
def posting_list_stats(spark, sf_dir):
    return doc_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n_docs"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS index, round(v[i], 6) AS weight FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM ({V})) WHERE abs(v[i]) > 0.1")
def sparse_threshold(spark, sf_dir):
    pairs = vectors(spark, sf_dir).select("vec_id", F.explode(sq.sparse_pairs("v", 0.1)).alias("p"))
    return pairs.select("vec_id", F.col("p.index").alias("index"), F.round("p.weight", 6).alias("weight"))


# hashed encodings and comparison of rankings

DIMS = 8


def hash_sql(id_col: str, source: str) -> str:
    sums = ", ".join(f"sum(CAST(('0x' || substr(md5(term || ':{d}'), 1, 8)) AS BIGINT) / 2147483648.0::DOUBLE - 1.0) / count(*)" for d in range(DIMS))
    return rf"SELECT doc_id, [{sums}] AS v FROM (SELECT DISTINCT {id_col} AS doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM {source}) GROUP BY doc_id"


def hash_vectors(spark: SparkSession, sf_dir: str, name: str, id_col: str) -> DataFrame:
    """doc_id and the hashed unit mean of distinct words, of texts with words."""
    texts = table(spark, sf_dir, name).select(F.col(id_col).alias("doc_id"), "text").where(F.regexp_instr("text", F.lit(WORD)) > 0)
    return HashEncoder(DIMS).transform(texts, "text", "v").select("doc_id", "v")


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS x FROM (SELECT doc_id, v, unnest(range(1, {DIMS + 1})) AS i FROM ({hash_sql('doc_id', 'documents')}))")
def hash_encode_dense(spark, sf_dir):
    return long_form(hash_vectors(spark, sf_dir, "documents", "doc_id"), "v", "x", "doc_id")


HASH_PAIRS = f"SELECT q.doc_id AS qid, d.doc_id AS did, list_cosine_similarity(q.v, d.v) AS score FROM ({hash_sql('item_id', 'benchmark')}) q, ({hash_sql('doc_id', 'documents')}) d"


def hash_ranking(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = hash_vectors(spark, sf_dir, "benchmark", "item_id").select(F.col("doc_id").alias("qid"), "v")
    d = hash_vectors(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("did"), "v")
    return rounded4(retrieval.knn(q, d, k, "cosine", "v", digits=9))


@query(RANK9.format(HASH_PAIRS, 5))
def hash_encode_topk(spark, sf_dir):
    return hash_ranking(spark, sf_dir, 5)


@query(f"""WITH a AS ({RANK9.format(HASH_PAIRS, 5)}), b AS ({RANK9.format(SPARSE_DOT, 5)})
SELECT qid, rank, a.did AS dense_doc, a.score AS dense_score, b.did AS sparse_doc, b.score AS sparse_score FROM a FULL JOIN b USING (qid, rank)""")
def paradigm_compare(spark, sf_dir):
    """The five best documents of each benchmark item by hashed vectors and by words, side by side."""
    by_words = rounded4(sparse.knn(item_terms(spark, sf_dir), doc_terms(spark, sf_dir), 5, digits=9))
    return retrieval.side_by_side({"dense": hash_ranking(spark, sf_dir, 5), "sparse": by_words})


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown FROM documents")
def text_shown(spark, sf_dir):
    """How a result list shows a text."""
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.shortened("text").alias("shown"))


# token sequences

WORD_IDS = r"SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), '\p{L}+'), lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS BIGINT)) AS ids FROM conversations"


def word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("bigint")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(words("text"), number).alias("ids"))


@query(f"""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, coalesce(ids[i], 0) AS token, CAST(CASE WHEN coalesce(ids[i], 0) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS mask
FROM (SELECT conv_id, turn, ids, unnest(range(1, width + 1)) AS i FROM (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM ({WORD_IDS})))""")
def token_pad_mask(spark, sf_dir):
    """The turns of a conversation padded to its longest, with their masks."""
    padded = sq.pad_sequences(word_ids(spark, sf_dir), "ids", "conv_id")
    zipped = padded.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.col("ids").alias("ids"), sq.attention_mask("ids").alias("mask"))).alias("pos", "p"))
    return zipped.select("conv_id", "turn", "pos", F.col("p.ids").alias("token"), F.col("p.mask").alias("mask"))


@query(f"SELECT conv_id, turn, CAST(len(ids) AS INTEGER) AS n_vectors FROM ({WORD_IDS})")
def num_vectors(spark, sf_dir):
    return word_ids(spark, sf_dir).select("conv_id", "turn", F.size("ids").alias("n_vectors"))


# time series

SERIES = "SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n FROM events"
SCALED = f"SELECT *, value / (avg(abs(value)) OVER (PARTITION BY user_id) + 1e-10) AS scaled FROM ({SERIES})"
TAIL = f"SELECT user_id, CAST(pos - n + 32 AS INTEGER) AS pos, value FROM ({SERIES}) WHERE n >= 32 AND pos >= n - 32"
BIN = "CAST(least(greatest(floor((least(greatest({x}, -10.0::DOUBLE), 10.0::DOUBLE) + 10.0::DOUBLE) / (20.0::DOUBLE / 4096)), 0), 4095) AS BIGINT)"


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos from 0 in order of time, n, value: a series stays rows, so one long series is no one row."""
    return ts.numbered(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "pos", "n", "value")


@query(f"SELECT user_id, pos, round(scaled, 6) + 0.0 AS x FROM ({SCALED})")
def ts_scale(spark, sf_dir):
    return rounded(ts.scaled_rows(event_series(spark, sf_dir), "user_id").select("user_id", "pos", F.col("scaled").alias("x")), "x")


@query(f"SELECT user_id, CAST(pos // 8 AS INTEGER) AS patch, CAST(pos % 8 AS INTEGER) AS pos, round(value, 6) + 0.0 AS x FROM ({SERIES}) WHERE pos < n - n % 8")
def ts_patches(spark, sf_dir):
    """Every user's whole series in patches of eight; less than a patch at the end is left out."""
    return rounded(ts.patch_rows(event_series(spark, sf_dir), 8).select("user_id", "patch", "pos", F.col("value").alias("x")), "x")


@query(f"SELECT user_id, pos, {BIN.format(x='scaled')} AS bin FROM ({SCALED})")
def ts_bins(spark, sf_dir):
    return ts.scaled_rows(event_series(spark, sf_dir), "user_id").select("user_id", "pos", ts.to_bin("scaled", 4096).alias("bin"))


@query(f"SELECT user_id, pos, round({BIN.format(x='scaled')} * (20.0::DOUBLE / 4096) + (-10.0::DOUBLE + 20.0::DOUBLE / 4096 / 2), 6) + 0.0 AS x FROM ({SCALED})")
def ts_bins_roundtrip(spark, sf_dir):
    s = ts.scaled_rows(event_series(spark, sf_dir), "user_id")
    return rounded(s.select("user_id", "pos", ts.from_bin(ts.to_bin("scaled", 4096), 4096).alias("x")), "x")


@query(f"SELECT user_id, pos, value FROM ({TAIL})")
def ts_tail_context(spark, sf_dir):
    """The last 32 values of every user with so many."""
    return ts.tail_rows(table(spark, sf_dir, "events"), "user_id", 32, "ts", "event_id").select("user_id", "pos", "value")


@query(f"SELECT user_id, pos, round(exp(sum(value / 1000) OVER (PARTITION BY user_id ORDER BY pos)), 6) AS x FROM ({SERIES})")
def ts_cumsum(spark, sf_dir):
    """A running sum and its exponential."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    running = F.sum(F.col("value") / 1000).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.select("user_id", (F.row_number().over(order) - 1).alias("pos"), F.round(F.exp(running), 6).alias("x"))


LEVELS = tuple(i / 10 for i in range(1, 10))
DECILES = "SELECT user_id, " + ", ".join(f"quantile_cont(value, {q}) AS q{round(q * 100)}" for q in LEVELS) + " FROM events GROUP BY user_id"


def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and the nine empirical deciles of its values, standing in for a forecast's quantiles."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.percentile("value", list(LEVELS)).alias("q"))


@query(f"SELECT user_id, round((q20 + q30) / 2, 6) AS q25, round((q70 + q80) / 2, 6) AS q75, round((q70 + q80) / 2 - (q20 + q30) / 2, 6) AS iqr, round(q90 - q10, 6) AS pi80 FROM ({DECILES})")
def ts_quantile_stats(spark, sf_dir):
    at = lambda i: F.element_at("q", i)
    s = deciles(spark, sf_dir).select("user_id", *ts.quantile_statistics(at(1), at(2), at(3), at(7), at(8), at(9)))
    return rounded(s, "q25", "q75", "iqr", "pi80")


@query("SELECT user_id, " + ", ".join(f"round(q{round(q * 100)}, 6) AS q{round(q * 100)}" for q in LEVELS) + f" FROM ({DECILES})")
def ts_quantile_pivot(spark, sf_dir):
    """A column for each level."""
    rows = deciles(spark, sf_dir).select("user_id", F.posexplode("q").alias("i", "x")).withColumn("level", F.concat(F.lit("q"), ((F.col("i") + 1) * 10).cast("string")))
    wide = rows.groupBy("user_id").pivot("level", [f"q{i}" for i in range(10, 100, 10)]).agg(F.first("x"))
    return rounded(wide, *(f"q{i}" for i in range(10, 100, 10)))


@query(f"SELECT user_id, round(q50, 6) AS median FROM ({DECILES})")
def ts_median_pick(spark, sf_dir):
    return rounded(deciles(spark, sf_dir).select("user_id", ts.median_forecast("q", LEVELS).alias("median")), "median")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(abs(value)) + 1e-10, 6) AS scale FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def events_windowed(spark, sf_dir):
    """The streaming form over a whole table."""
    w = windowed(table(spark, sf_dir, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("scale", 6).alias("scale"))


# images

PIXELS = "SELECT r // 192 AS image_id, CAST(r // 64 % 3 AS INTEGER) AS channel, CAST(r // 8 % 8 AS INTEGER) AS y, CAST(r % 8 AS INTEGER) AS x, CAST((r * 37) % 256 AS INTEGER) AS p FROM range(1920) t(r)"
CASE3 = "CASE channel WHEN 0 THEN {}::DOUBLE WHEN 1 THEN {}::DOUBLE ELSE {}::DOUBLE END"


@query(f"SELECT image_id, channel, y, x, round((p / 255.0::DOUBLE - {CASE3.format(*files.MEAN)}) / {CASE3.format(*files.DEVIATION)}, 6) + 0.0 AS v FROM ({PIXELS})")
def image_normalize(spark, sf_dir):
    """Ten made-up images of 8 by 8."""
    px = spark.range(1920).selectExpr("id div 192 AS image_id", "cast(id div 64 % 3 as int) AS channel", "cast(id div 8 % 8 as int) AS y", "cast(id % 8 as int) AS x", "cast(id * 37 % 256 as int) AS p")
    return rounded(files.normalize_pixels(px).drop("p"), "v")


# registry


def registry_sql() -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    lists = lambda xs: "[" + ", ".join(map(text, xs)) + "]::VARCHAR[]"
    rows = ", ".join(f"({r.registry_pos}, {text(r.id)}, {text(r.model_type)}, {text(r.huggingface_id)}, {text(r.organization)}, {r.default_dim}, {'NULL' if r.embedding_dim[1] is None else r.embedding_dim[1]}, {'NULL' if r.embedding_dim[2] is None else r.embedding_dim[2]}, {r.supported_dimensions}, {lists(r.languages)}, {r.context_length})" for r in registry.rows())
    return f"(VALUES {rows}) m(pos, id, model_type, hf, org, dim, min_dim, max_dim, supported, languages, ctx)"


MODELS = registry_sql()


@query(f"SELECT model_type, CAST(count(*) AS BIGINT) AS n, max(dim) AS max_dim FROM (SELECT model_type, dim FROM {MODELS}) GROUP BY model_type")
def registry_by_type(spark, sf_dir):
    return registry.registry(spark).groupBy("model_type").agg(F.count("*").alias("n"), F.max("embedding_dim.default").alias("max_dim"))


@query(f"SELECT id, dim, CAST(len(supported) AS INTEGER) AS n_supported, list_contains(supported, 128) AS has_128 FROM {MODELS} WHERE min_dim IS NOT NULL")
def registry_matryoshka(spark, sf_dir):
    d = F.col("embedding_dim")
    return registry.matryoshka_models(registry.registry(spark)).select("id", d["default"].alias("dim"), F.size(d["supported"]).alias("n_supported"), F.array_contains(d["supported"], 128).alias("has_128"))


@query(f"SELECT id, dim FROM {MODELS} WHERE dim <= 128")
def registry_small(spark, sf_dir):
    return registry.models_by_max_dim(registry.registry(spark), 128).select("id", F.col("embedding_dim.default").alias("dim"))


@query(f"SELECT id, ctx AS context_length FROM {MODELS} WHERE lower(org) = 'jina ai' AND list_contains(languages, 'de')")
def registry_filters(spark, sf_dir):
    return registry.models_by_language(registry.models_by_organization(registry.registry(spark), "JINA AI"), "de").select("id", "context_length")


@query(f"SELECT hf AS huggingface_id, arg_min(id, pos) AS id FROM {MODELS} GROUP BY hf")
def registry_by_repository(spark, sf_dir):
    """The model that a repository's id stands for: the first of those that share it."""
    return registry.registry(spark).groupBy("huggingface_id").agg(F.min_by("id", "registry_pos").alias("id"))


BROKEN = f"""SELECT pos, id, CASE WHEN pos % 7 = 0 THEN replace(hf, '/', '-') ELSE hf END AS hf, CASE WHEN pos % 5 = 0 THEN 0 ELSE ctx END AS ctx,
CASE WHEN pos % 4 = 1 THEN 100000 WHEN pos % 11 = 3 THEN 0 ELSE dim END AS dim, min_dim, CASE WHEN pos % 3 = 2 THEN min_dim ELSE max_dim END AS max_dim, supported FROM {MODELS}"""
RULES = {
    "embedding dimension is positive": "dim > 0", "minimum is below maximum": "min_dim IS NULL OR min_dim < max_dim", "default lies in range": "min_dim IS NULL OR dim BETWEEN min_dim AND max_dim",
    "supported dimensions lie in range": "min_dim IS NULL OR len(list_filter(supported, lambda x: x < min_dim OR x > max_dim)) = 0", "context length is positive": "ctx > 0", "repository id has a slash": "contains(hf, '/')",
}


@query(" UNION ALL ".join(f"SELECT id, '{rule}' AS rule FROM r WHERE NOT ({ok})" for rule, ok in RULES.items()).join((f"WITH b AS ({BROKEN}), r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE pos % 6 = 0) ", " UNION ALL SELECT id, 'id is unique' AS rule FROM r GROUP BY id HAVING count(*) > 1")))
def registry_violations(spark, sf_dir):
    """What the rules find in a registry with planted faults and repeated rows."""
    d, pos = F.col("embedding_dim"), F.col("registry_pos")
    faults = {
        "huggingface_id": F.when(pos % 7 == 0, F.replace(F.col("huggingface_id"), F.lit("/"), F.lit("-"))).otherwise(F.col("huggingface_id")),
        "context_length": F.when(pos % 5 == 0, 0).otherwise(F.col("context_length")),
        "projection_dims": F.lit(None).cast("int"),
        "has_projection": F.lit(False),
        "embedding_dim": F.struct(F.when(pos % 4 == 1, 100000).when(pos % 11 == 3, 0).otherwise(d["default"]).alias("default"), d["min"].alias("min"), F.when(pos % 3 == 2, d["min"]).otherwise(d["max"]).alias("max"), d["supported"].alias("supported"), d["strategy"].alias("strategy")),
    }
    broken = registry.registry(spark).withColumns(faults)
    return registry.violations(broken.unionAll(broken.where(pos % 6 == 0)))


@query("SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS rule WHERE false")
def registry_sound(spark, sf_dir):
    """No row of the registry itself breaks a rule."""
    return registry.violations(registry.registry(spark))
