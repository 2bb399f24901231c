"""Words of many texts at a time: memory, and the same values however they are cut."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomvec import encoder
from loomvec.encoder import HashEncoder, Known
from loomvec.operators import sparse
from loomvec.plans import catalogue


def worker_function(monkeypatch, df, make):
    """What make(df) gives to mapInArrow."""
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run) or self.sparkSession.createDataFrame([], schema))
    make(df)
    return taken[0]


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_memory_of_hashed_words(spark, monkeypatch, kind):
    """A batch of 3 million words: what a worker holds besides it doesn't grow with it."""
    df = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    run = worker_function(monkeypatch, df, lambda d: HashEncoder(8, kind).transform(d, "text", "v"))
    words = pa.array(np.random.default_rng(1).integers(0, 20_000, 3_000_000).astype(str))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3_000_001, 1000), pa.int32()), words)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(["x"] * 3000), lists], names=["id", "text", "w"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 60e6


def test_values_however_texts_are_cut(monkeypatch):
    """Slices of three words, and a store that forgets nearly all, give what each list gives alone."""
    rng = np.random.default_rng(2)
    lists = pa.array([[f"w{i}" for i in rng.integers(0, 50, n)] for n in (0, 1, 9, 2, 4)] + [None])
    known = Known(104)
    known.most = 2
    monkeypatch.setattr(encoder, "WORDS_AT_ONCE", 3)
    batch = pa.RecordBatch.from_arrays([lists], names=["w"])
    parts = list(encoder.sliced(batch, 0))
    assert [p.num_rows for p in parts] == [2, 1, 1, 1, 1]
    found = [v for p in parts for v in encoder.mean_vectors(p.column(0), 8, known).to_pylist()]
    assert found == encoder.mean_vectors(lists, 8, Known(104)).to_pylist() and found[-1] is None and found[0] == [0.0] * 8
    assert len(known.new) + len(known.old) <= 2 * (known.most + 9)


def test_memory_of_counting_words(spark, monkeypatch):
    """A batch of 3 million words is counted in slices, without a hash table of a partition's words (F22, F23)."""
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    run = worker_function(monkeypatch, df, lambda d: sparse.term_weights(d))
    words = pa.array(np.random.default_rng(1).integers(0, 20_000, 3_000_000).astype(str))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3_000_001, 1000), pa.int32()), words)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), lists], names=["doc_id", "words"])
    tracemalloc.start()
    total = sum(sum(b.column(2).to_pylist()) for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 3_000_000 and peak < 60e6


@pytest.mark.parametrize("name", ["sparse_weights", "sparse_statistics"])
def test_words_are_not_shuffled(spark, name):
    """Only rows a document are (F22, F23)."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "term#" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "HashAggregate" in x)


def test_rows_that_share_an_id_are_one_document(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "A c"), (None, "d"), (None, "d e"), (3, None), (4, "")], "doc_id bigint, text string")
    found = {(r.doc_id, r.term): round(np.expm1(r.weight)) for r in sparse.term_weights(texts).collect()}
    assert found == {(1, "a"): 3, (1, "b"): 1, (1, "c"): 1, (2, "b"): 1, (None, "d"): 2, (None, "e"): 1}
    assert sparse.term_weights(texts).count() == 6


def test_sparse_pairs_by_matrix_and_by_join(spark, monkeypatch):
    """The same pairs either way, with null ids and pairs that share an index but score 0; by matrix no row for each pair and index is shuffled (F17)."""
    rows = [(d % 7 if d % 7 else None, f"w{t}", float(t - 3)) for d in range(30) for t in range(d % 5, 9, 2)]
    q = spark.createDataFrame([(1, "w3", 2.0), (1, "w4", 1.0), (2, "w3", 1.0), (None, "w8", 1.5), (5, None, 1.0)], "doc_id int, term string, weight double")
    d = spark.createDataFrame(rows, "doc_id bigint, term string, weight double").distinct()
    listed = lambda df: sorted(map(tuple, df.select("qid", "did", F.round("score", 9)).collect()), key=repr)
    by_matrix = sparse.dot_pairs(q, d)
    found = listed(by_matrix)
    assert by_matrix.schema["qid"].dataType.simpleString() == "int"
    assert "keys=[qid" not in by_matrix._jdf.queryExecution().executedPlan().toString() and any(s == 0 for *_, s in found) and any(x[1] is None for x in found)
    monkeypatch.setattr(sparse, "MATRIX_BYTES", 0)
    assert listed(sparse.dot_pairs(q, d)) == found
    monkeypatch.undo()
    monkeypatch.setattr(sparse, "DOCS", 2)
    assert listed(sparse.dot_pairs(q, d)) == found
