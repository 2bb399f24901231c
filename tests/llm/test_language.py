"""Language spans: the batched Viterbi beside all paths, held-out accuracy, mixed texts."""

import itertools
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import language
from loomvec.llm.textarrays import lower_table


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(-9, 0), min_size=3, max_size=3), max_size=5), min_size=1, max_size=4), st.integers(0, 6))
def test_viterbi_equals_all_paths(texts, switch):
    scores = np.array([w for t in texts for w in t], dtype=np.float32).reshape(-1, 3)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    path = language.viterbi(scores, starts, float(switch))
    for k, t in enumerate(texts):
        value = lambda p: sum(t[i][x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if t:
            assert value(path[starts[k] : starts[k + 1]].tolist()) == max(map(value, itertools.product(range(3), repeat=len(t))))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 32), st.integers(1, 12), st.integers(0, 30))
def test_viterbi_of_few_texts_equals_that_of_many(seed, n, longest):
    """Texts finished one by one, beside a dense pass over each alone."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, longest + 1, n)
    scores = rng.integers(-9, 0, (int(lengths.sum()), 4)).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    path = language.viterbi(scores, starts, 5.0)
    for a, b in zip(starts, starts[1:]):
        best, back = scores[a].astype(float) if b > a else None, []
        for t in range(a + 1, b):
            jump = best.max() - 5
            back.append(np.where(best >= jump, np.arange(4), best.argmax()))
            best = np.maximum(best, jump) + scores[t]
        if b > a:
            expected = [int(best.argmax())]
            for step in reversed(back):
                expected.append(int(step[expected[-1]]))
            assert path[a:b].tolist() == expected[::-1]


def brute_words(text):
    """Words as (from, to, script) by a character at a time."""
    names, table = language.script_table()
    out, i = [], 0
    while i < len(text):
        if not unicodedata.category(text[i])[0] in "LM":
            i += 1
            continue
        j = i
        while j < len(text) and unicodedata.category(text[j])[0] in "LM":
            j += 1
        own = [names[table[ord(c)]] for c in text[i:j]]
        for k in range(len(own)):
            own[k] = own[k] or (own[k - 1] if k else "")
        for k in range(len(own) - 2, -1, -1):
            own[k] = own[k] or own[k + 1]
        wide = ["CJK" if x == "HIRAGANA" else x for x in own]
        a = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or wide[k] != wide[a]:
                out.append((i + a, i + k, "HIRAGANA" if "HIRAGANA" in own[a:k] else own[a]))
                a = k
        i = j
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab É1 .µªпЖ́日本のテーk한ગુαʼ"), max_size=12), min_size=1, max_size=4))
def test_words_and_scores_equal_brute_force(texts):
    """Words of mixed scripts and their trigram scores, one letter at a time."""
    names, _ = language.script_table()
    words = language.ScriptWords(texts)
    rng = np.random.default_rng(1)
    counts = {x: np.concatenate([rng.integers(0, 5, language.BUCKETS), np.zeros(len(names), int)]) for x in ("en", "ja", "gu")}
    for x, script in (("en", "LATIN"), ("gu", "GUJARATI")):
        counts[x][language.BUCKETS + names.index(script)] = 100
    counts["gu"][language.BUCKETS + names.index("GREEK")] = 1
    model = language.LanguageModel(counts)
    scores = model.scores(words)
    for t, text in enumerate(texts):
        a, b = words.text_words[t], words.text_words[t + 1]
        at = int(words.text_at[t])
        expected = brute_words(text)
        assert [(int(x) - at, int(y) - at, names[s]) for x, y, s in zip(words.char_from[a:b], words.char_to[a:b], words.script[a:b])] == expected
        for (i, j, script), got in zip(expected, scores[a:b]):
            able = {"LATIN": {"en"}, "GUJARATI": {"gu"}, "CJK": {"ja"}, "HIRAGANA": {"ja"}}.get(script, set())
            bare = [" ", *(lower_table()[ord(c)].item() for c in text[i:j]), " "]
            padded = [ord(" "), *bare[1:-1], ord(" ")]
            for k, x in enumerate(model.languages):
                total = 0.0
                for m in range(1, len(padded) - 1):
                    h = (padded[m - 1] * 0x9E3779B97F4A7C15 + padded[m] * 0xC2B2AE3D27D4EB4F + padded[m + 1] * 0x165667B19E3779F9) * 0xD6E8FEB86659FD93 % (1 << 64)
                    total += float(model.log_p[k][h >> 48])
                assert abs(total - got[k]) < 1e-3 if x in able else got[k] == -np.inf
            label = {"CYRILLIC": "ru", "GREEK": "el", "HANGUL": "ko"}.get(script)
            assert label is None or got[model.labels.index(label)] == 0


def test_scripts(spark, docs):
    """Words end where the script changes; kana decides for Japanese; scripts are learned from labelled text."""
    model = language.train(docs)
    of = lambda text: [(text[s.char_from : s.char_to], s.lang) for s in language.identify(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first().spans]
    assert of("日本語のテキスト") == [("日本語のテキスト", "ja")] and of("中文文本") == [("中文文本", "zh")]
    assert of("ПриветΚόσμε") == [("Привет", "ru"), ("Κόσμε", "el")] and of("ગુજરાતી") == [("ગુજરાતી", "gu")]
    rows = [(i, f"ꓐꓑꓒ ꓓꓔ ꓕꓖ{'ꓗꓘ' * (i % 3)}", "lis") for i in range(20)] + [(i, "мова беларуская родная", "be") for i in range(20, 40)]
    trained = language.train(docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    asked = spark.createDataFrame([(1, "ꓐꓑꓒ ꓕꓖ"), (2, "родная мова")], "doc_id bigint, text string")
    assert [r.lang for r in language.identify(asked, trained).orderBy("doc_id").collect()] == ["lis", "be"]
    assert language.accepted(asked, trained).count() == 2


def test_stray_labels_are_left_out(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    rows = [(i, "some text of words", f"x{i}") for i in range(50)]
    model = language.train(docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert model.languages == ["de", "en", "fr"]


def test_a_very_long_text(docs):
    """Three million words in seconds."""
    model = language.train(docs)
    began = time.process_time()
    lang, share, spans = language.label_slice(model, ["the and of " * 1_000_000])
    assert lang[0].as_py() == "en" and len(spans[0]) == 1 and time.process_time() - began < 60


def test_held_out_accuracy(docs):
    model = language.train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 and length(text) > 60")
    found = rest.join(language.identify(rest, model).withColumnRenamed("lang", "found"), "doc_id")
    assert found.where("lang = found").count() >= 0.97 * rest.count()


def test_mixed_text_and_scripts(spark, docs):
    model = language.train(docs)
    by_lang = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' and n_chars > 400").orderBy("doc_id").limit(1).collect())[:400] for lang in ("en", "fr", "de")}
    mixed = by_lang["en"] + " . " + by_lang["de"] + " . " + by_lang["fr"] + " Привет мир καλημέρα κόσμε"
    row = language.identify(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), model).first()
    order = [s.lang for s in row.spans]
    assert [x for x, _ in itertools.groupby(x for x in order if x in by_lang)] == ["en", "de", "fr"]
    assert order[-2:] == ["ru", "el"]
    for s in row.spans:
        assert 0 <= s.char_from < s.char_to <= len(mixed)


def test_counts_grow_with_the_documents(docs):
    few, all_rows = (language.trigram_counts(d, ["de", "en"], "text", "lang").groupBy().sum("n").first()[0] for d in (docs.where("doc_id % 2 = 0"), docs))
    assert all_rows > 1.5 * few


def test_defined_results(docs, odd_docs, no_docs):
    model = language.train(docs)
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (3, 4, 6):
            assert (r.lang, r.share, r.spans) == ("und", 0, [])
    kept = language.accepted(odd_docs, model)
    assert kept.schema == odd_docs.schema
    assert {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 6})
    assert language.identify(no_docs, model).count() == 0 and language.accepted(no_docs, model).count() == 0
    untrained = language.train(no_docs)
    assert {r.lang for r in language.identify(odd_docs, untrained).collect()} == {"und"}
