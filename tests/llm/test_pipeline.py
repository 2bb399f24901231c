"""The pipeline's stages, each on its own input, and the queries' registration."""

import re
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import __spark_entry__
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from tokenizers import Tokenizer

from loomvec.llm import bpe, language, packing, simhash, textarrays, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        ids, before = ({r.doc_id for r in d.select("doc_id").collect()} for d in (after, docs))
        assert ids <= before
        kept.append((docs, ids))
        docs = after
    # the same by each operator's own answer on the stage's input
    model = toxicity.train(kept[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.find(kept[0][0], model).collect()}
    assert kept[0][1] == {r.doc_id for r in start.collect()} - toxic
    own = language.identify(kept[1][0], language.train(kept[1][0])).collect()
    assert kept[1][1] >= {r.doc_id for r in own if r.lang != "und" and r.share >= 0.5}
    gone = {r.doc_id for r in simhash.duplicates(kept[2][0]).collect()}
    assert kept[2][1] == kept[1][1] - gone
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept[2][1]
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert len(kept[2][1]) >= 0.6 * start.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_planted_cases_and_odd_rows(spark, tmp_path):
    """What stays, by what was planted, and its places by the tokenizers library."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    base = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    prose = [t for _, t, _ in base if len(t) > 3000][:6]
    cut = [t[200:1700] for t in prose]
    insult = " You stupid pathetic idiot, worthless moron and disgusting loser. "
    first = 1_000_000
    planted = {
        first: cut[0] + insult + cut[0][::-1],  # toxic
        first + 1: "\u0000 \u2026 123 !!",  # no letters
        first + 2: None,
        first + 3: "",
        first + 4: "xqzv " * 40 + "qqzx kvvw " * 200,  # no language
        first + 5: " ".join(" ".join(cut[1].split()[i % 200 :]) for i in range(0, 600, 3)),  # very long
        first + 6: cut[2],
        first + 7: cut[2],  # an exact copy
        first + 8: cut[2].replace(" the ", " ").replace(".", ""),  # a near copy
    }
    rows = base + [(i, t, "en" if t else None) for i, t in planted.items()] + [(first + 9, cut[3], "en")] * 2 + [(None, cut[4], None)]
    wide = [(i, t, x, "s", len(t or ""), 1, 2, "x", 3, 4) for i, t, x in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, bin_id int, spans string, gone int, uid bigint"
    spark.createDataFrame(wide, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in packed}
    assert kept & set(range(first, first + 10)) == {first + 5, first + 6, first + 9} and None in kept
    library = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    tokens, bins = Counter(), defaultdict(list)
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
        bins[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens))
    text = {i: t for i, t, _ in rows}
    some = [i for i in sorted(kept - {None})[::9]] + [first + 5, first + 6]
    assert all(tokens[i] == len(library.encode(text[i]).ids) for i in some)
    assert tokens[first + 9] == 2 * len(library.encode(cut[3]).ids)
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_eleven_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_worker_gives_memory_back():
    """Nothing is held of what a task frees, nor of a step's vocabulary once the worker gets another step."""

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    def sent(run, keeps=None):  # as workers get it
        return cloudpickle.loads(cloudpickle.dumps(textarrays.lean(run, keeps)))

    def run(batches):
        for batch in batches:
            parts = [np.ones(10_000, np.int64) for _ in range(2_000)]  # 160 MB, each under the size that is mapped by itself
            kept.append(np.ones(10_000, np.int64))  # at the end of the heap
            del parts
            yield batch

    kept, batch = [], pa.RecordBatch.from_pydict({"n": [1]})
    textarrays.release()
    before = held()
    list(textarrays.lean(run)(iter([batch] * 3)))
    assert held() < before + 60

    def counts(batches):
        for batch in batches:
            bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
            yield batch

    for _ in range(2):
        list(sent(counts, bpe.vocabulary)(iter([batch])))
        assert bpe.vocabulary.cache_info().currsize == 1
    list(sent(lambda batches: batches)(iter([batch])))
    assert bpe.vocabulary.cache_info().currsize == 0


def test_every_stage_is_lean(monkeypatch):
    """Each pass over the texts gives its memory back; the language stage's arrays stay below 70 MB for 1 MB of text."""

    class Docs:
        columns, schema = ["text"], None
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def mapInArrow(self, run, schema):
            return run

    released = []
    monkeypatch.setattr(textarrays, "release", lambda: released.append(1))
    texts = [("the quick brown fox said that e\u0301te " * 600)] * 45  # with a mark, which takes its neighbour's script
    batch = pa.RecordBatch.from_pydict({"text": texts})
    counts = np.ones(language.BUCKETS + len(language.script_table()[0]))
    model = language.LanguageModel({x: counts for x in ("de", "en", "fr", "es")})
    for stage in (language.accepted(Docs(), model), toxicity.clean(Docs(), toxicity.ToxicityModel({"fox": 2.0}))):
        released.clear()
        list(stage(iter([batch])))
        assert len(released) == 2
    tracemalloc.start()
    list(language.accepted(Docs(), model)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6)
    assert peak < 70e6


def test_labels_of_slices():
    """Words are scored in smaller slices than paths, with the labels that scoring all at once gives."""
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).slice(0, 300).to_pylist()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        if r["text"] and r["lang"]:
            words = language.ScriptWords([r["text"]])
            own = counts.setdefault(r["lang"], np.zeros(language.BUCKETS + len(language.script_table()[0])))
            own[: language.BUCKETS] += np.bincount(words.buckets, minlength=language.BUCKETS)
            own[language.BUCKETS :] += np.bincount(words.script, words.letters(), len(own) - language.BUCKETS)
    model = language.LanguageModel(counts)
    odd = [None, "", "123 !!", "Привет мир ελληνικά שלום 漢字かな ไทย", "the quick " * 40_000]
    for texts in ([r["text"] for r in rows] + odd, odd[:3]):
        words = language.ScriptWords(texts)
        path, letters, of = language.word_labels(model, pa.array(texts, pa.string()))
        assert (path == language.viterbi(model.scores(words), words.text_words)).all()
        assert (letters == words.char_to - words.char_from).all()
        assert (of == np.repeat(np.arange(len(texts)), np.diff(words.text_words))).all()
