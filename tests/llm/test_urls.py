"""URL models beside counting in dictionaries, and the calibrated threshold."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomvec.llm import urls


def brute(texts):
    """A function that gives the log-likelihood per byte under interpolated counts, without hashing."""
    seen = defaultdict(Counter)
    for t in texts:
        b = bytes([urls.START]) * urls.ORDER + t.lower().encode()
        for i in range(urls.ORDER, len(b)):
            for k in range(urls.ORDER + 1):
                seen[b[i - k : i]][b[i]] += 1

    def score(t):
        b, total = bytes([urls.START]) * urls.ORDER + t.lower().encode(), 0.0
        for i in range(urls.ORDER, len(b)):
            p = 1 / 256
            for k in range(urls.ORDER + 1):
                c = seen.get(b[i - k : i])
                if c:
                    p = (c[b[i]] + len(c) * p) / (sum(c.values()) + len(c))
            total += math.log(p)
        return total / max(1, len(b) - urls.ORDER)

    return score


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_scores_equal_brute_force(pages):
    model = urls.train(pages)
    found = {r.page_id: r for r in urls.score(pages, model).collect()}
    rows = pages.select("page_id", "url", urls.host(pages["url"]).alias("host")).collect()
    bad = [r.url for r in rows if any(s in r.host for s in urls.SEEDS)]
    good = [r.url for r in rows if not any(s in r.host for s in urls.SEEDS)]
    assert bad and good
    of_bad, of_good = brute(bad), brute(good)
    # what hashing adds is small
    assert all(abs(found[r.page_id].score - (of_bad(r.url) - of_good(r.url))) < 0.1 for r in rows)
    good = set(good)
    kept = [found[r.page_id].accepted for r in rows if r.url in good]
    assert sum(kept) >= (1 - urls.FALSE_REJECTION) * len(kept) - 1
    assert sum(found[r.page_id].accepted for r in rows if r.url not in good) <= 0.1 * len(bad) + 1


def test_counts_are_exact_beyond_a_million(spark, monkeypatch):
    """Grams of all orders without those of others, by brute force over what the asked URLs have."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    tails = ["".join(x) for x in letters[rng.integers(0, 36, (40_000, 30))]]
    texts = [("http://casino.org/" if i % 2 else "http://fine.org/") + t for i, t in enumerate(tails)]
    asked = texts[:40] + ["http://other.org/" + t[::-1] for t in tails[:20]]
    mark = chr(urls.START) * urls.ORDER
    pieces = lambda t: [(mark + t)[i - k : i + 1] for i in range(urls.ORDER, urls.ORDER + len(t)) for k in range(urls.ORDER + 1)]
    contexts = {p[:-1] for t in asked for p in pieces(t)}
    seen = [defaultdict(Counter), defaultdict(Counter)]
    distinct = set()
    for i, t in enumerate(texts):
        for p in pieces(t):
            distinct.add(p)
            if p[:-1] in contexts:
                seen[i % 2][p[:-1]][p[-1]] += 1
    assert len(distinct) > 1.25 * (1 << 20)

    def expected(t):
        total = 0.0
        for c, sign in ((1, 1), (0, -1)):
            for i, p in enumerate(pieces(t)):
                if i % (urls.ORDER + 1) == 0:
                    chance = 1 / 256
                if n := seen[c].get(p[:-1]):
                    chance = (n[p[-1]] + len(n) * chance) / (sum(n.values()) + len(n))
                if i % (urls.ORDER + 1) == urls.ORDER:
                    total += sign * math.log(chance)
        return total / len(t)

    model = urls.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id bigint, url string"))
    truth = [expected(t) for t in asked]
    assert np.allclose(model.scores(asked), truth, rtol=0, atol=1e-8)
    monkeypatch.setattr(urls, "HEAD", 100)
    assert np.allclose(model.scores(asked), truth, rtol=0, atol=1e-8)


def test_held_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = urls.train(pages.where("page_id % 2 = 0"))
    rest = urls.score(pages.where("page_id % 2 = 1"), model).withColumn("host", urls.host("url")).collect()
    bad = [r for r in rest if any(s in r.host for s in urls.SEEDS)]
    good = [r for r in rest if r not in bad]
    assert sum(not r.accepted for r in bad) >= 0.9 * len(bad)
    assert sum(not r.accepted for r in good) <= (urls.FALSE_REJECTION + 0.002) * len(good) + 2


def test_labels_of_a_column(spark):
    """Labels decide, not hosts; null ones aren't learned from."""
    rows = [(i, f"http://site.org/{'alpha' if i % 2 else 'omega'}/{i}", bool(i % 2) if i < 380 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, rejected boolean")
    model = urls.train(df, label_col="rejected")
    found = {r.page_id: r.accepted for r in urls.score(df, model).collect()}
    assert sum(found[i] != bool(i % 2) for i in range(400)) >= 396
    assert model.pairs.sum() == sum(len(u) for _, u, x in rows if x is not None)


def test_threshold_equals_a_quantile(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 2, 4000)
    df = spark.createDataFrame([(float(x),) for x in values], "score double")
    t = urls.cut([df.where("score < 0"), df.where("score >= 0")], 0.01)
    assert (values > t).mean() <= 0.01 < (values > t - 2 * urls.STEP).mean() + 0.001
    assert urls.cut([df.where("false")], 0.01) == float("inf")


def test_a_batch_of_long_urls_stays_small():
    """10 MB of URLs in one batch are counted a slice at a time."""
    import tracemalloc

    import pyarrow as pa

    column = pa.array(["http://a.org/" + "x1y2z3" * 2000] * 850)
    tracemalloc.start()
    for _, _, texts in urls.text_slices(column, urls.SLICE):
        np.unique(urls.grams(texts)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_defined_results(spark, pages):
    model = urls.train(pages)
    long = "http://example.org/" + "a/" * 100_000
    odd = spark.createDataFrame([(1, None, 1, "x"), (2, "", 1, "x"), (None, "http://a.org/", 1, "x"), (4, long, 1, "x"), (5, "HTTP://A.ORG/", 1, "x"), (5, "HTTP://A.ORG/", 1, "x")], "page_id bigint, url string, bad int, host string")
    rows = {r.page_id: r for r in urls.score(odd, model).collect()}
    assert rows[1].score == rows[2].score == 0 and rows[1].accepted and rows[2].accepted
    assert rows[None].score == rows[5].score and math.isfinite(rows[4].score)
    assert urls.score(odd, model).count() == 6 and urls.score(odd.where("false"), model).count() == 0
    untrained = urls.train(odd)
    assert {(r.score, r.accepted) for r in urls.score(pages, untrained).collect()} == {(0.0, True)}
    assert urls.train(odd.where("false")).total is None
    assert np.array_equal(urls.UrlModel().scores([None, "a"]), [0, 0])
