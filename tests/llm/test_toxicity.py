"""Toxic passages: segments beside brute force, held-out precision and recall."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import toxicity


def brute(scores):
    """Maximal scoring segments by their definition: the best segment, then the same left and right of it."""
    if not scores:
        return []
    total = [(sum(scores[a : b + 1]), a, b) for a in range(len(scores)) for b in range(a, len(scores))]
    best = max(s for s, _, _ in total)
    if best <= 0:
        return []
    # of equal sums the shortest, leftmost
    a, b = min(((b - a, a, b) for s, a, b in total if s == best))[1:]
    left, right = brute(scores[:a]), brute(scores[b + 1 :])
    return left + [(a, b, best)] + [(x + b + 1, y + b + 1, s) for x, y, s in right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-0.5, -0.5, -0.5, 1.03, 2.07, 0.51]), max_size=18))
def test_segments_equal_brute_force(scores):
    at = [i for i, s in enumerate(scores) if s > 0]
    found = toxicity.segments(at, [scores[i] for i in at])
    expected = brute(scores)
    assert sorted(round(s, 6) for _, _, s in found) == sorted(round(s, 6) for _, _, s in expected)
    covered = lambda xs: {i for a, b, _ in xs for i in range(a, b + 1) if scores[i] > 0}
    assert covered(found) == covered(expected)


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def test_held_out(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rest = labels.where("doc_id % 2 = 1").join(docs, "doc_id").drop("quality")
    found = {r.doc_id for r in toxicity.find(rest, model).collect()}
    truth = {r.doc_id: r.toxic for r in rest.select("doc_id", "toxic").collect()}
    toxic, clean = (sum(t == x for t in truth.values()) for x in (1, 0))
    assert sum(truth[i] for i in found) >= 0.9 * toxic  # about 1 label in 20 is noise
    assert sum(1 - truth[i] for i in found) <= 0.003 * clean
    for least in (toxicity.LEAST_P, 0.01):  # p-values mean what they say
        share = sum(r.p_value <= least and not truth[r.doc_id] for r in toxicity.find(rest, model, least_p=least).collect()) / clean
        assert share <= 2 * least + 2 / clean, (least, share)
    for lang in ("en", "de", "fr", "es"):
        own = [r.doc_id for r in rest.where(f"lang = '{lang}' and toxic = 1").select("doc_id").collect()]
        assert sum(i in found for i in own) >= 0.75 * len(own), lang
    kept = {r.doc_id for r in toxicity.clean(rest, model).select("doc_id").collect()}
    assert kept == set(truth) - found


def test_passages_are_where_the_words_are(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    clean = next(r.text for r in labels.where("toxic = 0").join(docs, "doc_id").where("lang = 'en' and n_chars between 500 and 900").orderBy("doc_id").collect())
    statistics, parts = toxicity.scan_slice(model, [clean + " such a stupid idiot and moron, you loser. " + clean])[0]
    assert model.p(statistics) < 1e-4 and len(parts) == 1
    a, b = parts[0][:2]
    text = clean + " such a stupid idiot and moron, you loser. " + clean
    assert text[a:b] == "stupid idiot and moron, you loser"


def test_scattered_words_of_a_long_text(tables):
    """No passage is significant, the number of different toxic words is."""
    docs, labels = tables
    model = toxicity.train(docs, labels)
    words = sorted(model.words, key=lambda w: model.score(w))[:8]
    calm = ["quiet"] * 120
    text = " ".join(x for w in words for x in (*calm, w))
    (by_segments, by_count), _ = toxicity.scan_slice(model, [text])[0]
    assert by_segments < 3 < by_count and model.p((by_segments, by_count)) <= toxicity.LEAST_P
    assert model.p(toxicity.scan_slice(model, [" ".join([*calm, words[0], *calm] * 8)])[0][0]) > toxicity.LEAST_P


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.floats(0.001, 20))
def test_the_count_statistic_equals_the_sum_of_the_law(k, mean):
    below = sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k))
    if below < 0.999:
        assert abs(toxicity.count_statistic(k, mean) - -math.log(1 - below)) < 1e-6


def test_tails():
    """An exponential law is found again, wrong labels don't move it."""
    rng = np.random.default_rng(5)
    values = np.ceil(np.concatenate([np.zeros(19_000), rng.exponential(1 / 1.5, 980), np.full(20, 60.0)]) * 100) / 100
    t = toxicity.tail(dict(Counter(values.tolist())))
    for p in (0.01, 0.005, 0.002):
        assert 0.5 < np.mean([t.p(x) <= p for x in values]) / p < 2
    assert toxicity.tail({0.0: 99}) == toxicity.Tail(0.01) and toxicity.tail({}).p(5) < 0.01


def brute_counts(rows):
    """Different contexts of words and prefixes by class and half, from (text, toxic, fold)."""
    seen = defaultdict(set)
    for text, toxic, fold in rows:
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
        for i, w in enumerate(words):
            seen[w, toxic, fold].add((words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None))
    out = Counter()
    for (w, toxic, fold), contexts in seen.items():
        out["w" + w, toxic, fold] += len(contexts)
        out["n", toxic, fold] += len(contexts)
        if len(w) >= toxicity.PREFIX:
            out["p" + w[: toxicity.PREFIX], toxic, fold] += len(contexts)
    return out


def test_features_equal_brute_force(tables):
    """Counts, log-odds, z-scores, lambda and K, from the texts alone."""
    docs, labels = (t.where("doc_id < 1500") for t in tables)
    rows = [tuple(r) for r in toxicity.training_rows(docs, labels).collect()]
    counts = brute_counts(rows)
    assert {(r.feature, r.toxic, r.fold): r.n for r in toxicity.feature_counts(toxicity.training_rows(docs, labels)).collect()} == counts
    model = toxicity.fitted(toxicity.feature_counts(toxicity.training_rows(docs, labels)))
    by = defaultdict(lambda: [0, 0])
    for (f, toxic, _), n in counts.items():
        by[f][toxic] += n
    (n_c, n_t), share = by.pop("n"), toxicity.PRIOR_SHARE
    scores, rates = {}, {}
    for f, (c, t) in by.items():
        a = share * (c + t)
        prior = share * (n_c + n_t)
        delta = math.log((t + a) / (n_t + prior - t - a)) - math.log((c + a) / (n_c + prior - c - a))
        if delta / math.sqrt(1 / (t + a) + 1 / (c + a)) >= toxicity.LEAST_Z and delta > toxicity.DRIFT:
            scores[f], rates[f] = delta, (c + a) / (n_c + prior)
    assert set(scores) == {"w" + w for w in model.words} | {"p" + w for w in model.prefixes}
    assert all(abs(d - (model.words if f[0] == "w" else model.prefixes)[f[1:]]) < 1e-9 for f, d in scores.items())
    counted = {f: r for f, r in rates.items() if f[0] == "p" or "p" + f[1 : 1 + toxicity.PREFIX] not in scores}
    drift = toxicity.DRIFT
    moment = lambda x: sum(r * math.exp(x * (scores[f] - drift)) for f, r in counted.items()) + (1 - sum(counted.values())) * math.exp(-x * drift)
    assert abs(moment(model.decay) - 1) < 1e-6 and moment(model.decay * 1.01) > 1 and abs(model.rate - sum(counted.values())) < 1e-12
    assert abs(model.scale - sum(r * math.exp(model.decay * (scores[f] - drift)) for f, r in counted.items())) < 1e-6


def test_noisy_labels_are_a_defined_case(spark):
    """Texts of toxic words only, in both classes: features go till clean text scores below zero."""
    rows = [(i, " ".join(f"bad{(i * 7 + j) % 11} x{i}y{j}" for j in range(20)), int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "key bigint, body string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "key bigint, toxic int")
    model = toxicity.train(docs, labels, id_col="key", text_col="body")
    assert toxicity.find(docs, model, "key", "body").count() <= 60


def test_defined_results(tables, odd_docs, no_docs):
    model = toxicity.train(*tables)
    assert toxicity.find(odd_docs, model).count() == 0
    assert toxicity.clean(odd_docs, model).schema == odd_docs.schema
    assert toxicity.clean(odd_docs, model).count() == odd_docs.count()
    assert toxicity.find(no_docs, model).count() == 0
    empty = toxicity.train(tables[0], tables[1].where("false"))
    assert toxicity.find(tables[0], empty).count() == 0
    strange = tables[1].selectExpr("cast(null as bigint) as doc_id", "quality", "toxic").unionAll(tables[1].selectExpr("doc_id", "quality", "cast(null as int) as toxic"))
    assert not toxicity.train(tables[0], strange).words
