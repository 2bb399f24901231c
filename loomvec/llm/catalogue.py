"""The queries of this subpackage with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import bpe, exact_topk, language, licenses, packing, permutation_index, simhash, toxicity, urls, warc
from loomvec.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


QUERIES["op1_byte_bpe"] = op1_byte_bpe


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as records of .warc.gz files, streamed back as chunk rows."""
    chunks = warc.through_files(table(spark, sf_dir, "pages"), "page_id", "html", uri_col="url")
    return chunks.withColumn("payload", F.translate(F.base64("payload"), "\r\n", ""))  # without MIME line ends


QUERIES["op5_warc"] = op5_warc
ORACLES["op5_warc"] = f"""
SELECT page_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * {warc.CHUNK_BYTES} AS BIGINT) AS byte_from,
       CAST(least({warc.CHUNK_BYTES}, n - i * {warc.CHUNK_BYTES}) AS INTEGER) AS n_bytes,
       base64(b[i * {warc.CHUNK_BYTES} + 1 : (i + 1) * {warc.CHUNK_BYTES}]) AS payload,
       sha1(b[1 : (i + 1) * {warc.CHUNK_BYTES}]) AS prefix_sha1,
       i = greatest(n - 1, 0) // {warc.CHUNK_BYTES} AS is_last
FROM (SELECT page_id, b, n, unnest(range(greatest(n - 1, 0) // {warc.CHUNK_BYTES} + 1)) AS i
      FROM (SELECT page_id, encode(html) AS b, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM pages WHERE html IS NOT NULL))"""


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 100, the corpus is every row."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES["op10_exact_topk"] = op10_exact_topk
ORACLES["op10_exact_topk"] = exact_topk.ORACLE


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


QUERIES["op4_language"] = op4_language


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.find(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES["op9_toxicity"] = op9_toxicity


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


QUERIES["op3_simhash"] = op3_simhash


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES["op8_best_fit"] = op8_best_fit


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


QUERIES["op2_licenses"] = op2_licenses
ORACLES["op2_licenses"] = licenses.oracle()


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.score(pages, urls.train(pages))


QUERIES["op7_url_filter"] = op7_url_filter


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 100, every row is indexed."""
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES["op6_permutation_index"] = op6_permutation_index
