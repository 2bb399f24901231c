"""URL filtering by a ratio of two character language models.

One model is trained on rejected URLs, one on accepted ones: variable-order Markov
models over bytes, of contexts up to ORDER, smoothed by Witten and Bell's
interpolation, so a context counts as far as it has been seen. A URL's score is
the difference of the two log-likelihoods for each byte. The threshold is
calibrated on the accepted URLs, all of them: a set share of them may exceed it.

Training labels are a column of the table, or come from seed words: a URL whose host has one is
rejected, others are accepted. All URLs with a label count. The threshold is taken from scores of URLs
by models that haven't seen them: each half of the URLs, dealt by hash, is scored by the
counts of the other half, and the score that the set share of the accepted ones exceeds is read
from a histogram of fixed bins (STEP wide). Where a half lacks one of the classes the scores of the whole model stand in.

Counts are exact. A byte and the ORDER bytes before it, its gram, fit one number, and decide
what the byte adds to the score; the contexts of lower orders are parts of it. The model is a stored
table of the grams seen. The grams of URLs to be scored meet it by the two
bytes before the last, which all contexts of two bytes and more have in common; contexts of
fewer bytes are counted in a table of 2**16 numbers a class, all there can be. The HEAD most frequent
grams' ratios are sent to the tasks, URLs with others are joined with theirs.

Defined results: a null or empty URL has score 0 and is accepted; a null label isn't learned from; without any
rejected or any accepted URL all are accepted with score 0. Letter case is ignored.
Repeated rows are scored each; extra columns are ignored; a URL at the threshold is
accepted. Long URLs count whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm.textarrays import text_slices
from loomvec.session import stored

SEEDS = ("casino", "pills", "bets", "adult", "spam", "ads-track", "porn", "viagra")
ORDER = 5
#: Share of the accepted URLs that may be rejected.
FALSE_REJECTION = 0.005
SLICE = 2_000_000  # bytes scored at once; changes no result
START = 1  # the sign before a URL

#: Ratios sent to every task; changes no result.
HEAD = 200_000

COUNTED = "fold int, gram bigint, bad bigint, good bigint"
#: Width and range of the bins of scores that the threshold is read from.
STEP, RANGE = 0.001, 30.0


def host(url):
    """The host of a URL column, in lower case; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def seeded(url_col: str, seeds: tuple[str, ...]):
    """Whether the host of a URL column has a seed word."""
    return reduce(lambda a, b: a | b, [host(F.col(url_col)).contains(s) for s in seeds], F.lit(False))


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as a number, the byte last; and which URL it is of."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    pad = bytes([START]) * ORDER
    joined = np.frombuffer(b"".join(pad + r for r in raw), dtype=np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    at = np.arange(len(of)) + (of + 1) * ORDER
    gram = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram << 8 | joined[at - k]
    return gram, of


@dataclass(frozen=True)
class UrlModel:
    """total: gram, bad and good, how often each class has it; pairs: the same by class for
    the last two bytes alone; and the threshold."""

    total: DataFrame | None = None
    pairs: np.ndarray | None = None
    threshold: float = float("inf")

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Per URL the rejected model's log-likelihood less the accepted one's, per byte."""
        if self.total is None:
            return np.zeros(len(urls))
        rows = self.total.sparkSession.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
        return np.array([r.score for r in score(rows, self).orderBy("page_id").collect()])


def labelled(urls: DataFrame, url_col: str, label_col: str | None, seeds: tuple[str, ...]) -> DataFrame:
    """url in lower case, whether it is rejected, and its half, of what is learned from."""
    bad = seeded(url_col, seeds) if label_col is None else F.col(label_col).cast("boolean")
    rows = urls.where(f"length(`{url_col}`) > 0").select(F.lower(url_col).alias("url"), bad.alias("bad")).where("bad is not null")
    return rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int"))


def counts(rows: DataFrame) -> DataFrame:
    """COUNTED: how often each gram occurs in each class of each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, folds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for a, b, texts in text_slices(batch.column(0), SLICE):
                gram, of = grams(texts)
                for fold in (0, 1):
                    own = folds[a:b][of] == fold
                    found, at = np.unique(gram[own], return_inverse=True)
                    bad = np.bincount(at[flags[a:b][of[own]]], minlength=len(found))
                    yield pa.RecordBatch.from_pydict({"fold": np.full(len(found), fold, np.int32), "gram": found, "bad": bad, "good": np.bincount(at, minlength=len(found)) - bad})

    return rows.mapInArrow(run, COUNTED).groupBy("fold", "gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ordered keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_p(asked: np.ndarray, gram: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The log-probability of each asked gram's last byte after the others, by a class's
    counts n of grams, among them all that share two bytes before the last with one asked, and by its pairs."""
    p = np.full(len(asked), 1 / 256)
    last, before = asked & 255, asked >> 8 & 255
    for k in range(ORDER + 1):
        if k == 0:
            seen, total, kinds = pairs.sum(0)[last], pairs.sum(), (pairs.sum(0) > 0).sum()
        elif k == 1:
            seen, total, kinds = pairs[before, last], pairs.sum(1)[before], (pairs > 0).sum(1)[before]
        else:
            part = (1 << 8 * (k + 1)) - 1
            keys, at = np.unique(gram[n > 0] & part, return_inverse=True)
            sums = np.bincount(at, n[n > 0], len(keys))
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            seen = looked_up(keys, sums, asked & part)
            total, kinds = (looked_up(contexts, x, (asked & part) >> 8) for x in (np.bincount(at, sums, len(contexts)), np.bincount(at, minlength=len(contexts))))
        p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p)


def ratios(wanted: DataFrame, model: UrlModel) -> DataFrame:
    """gram, n and ratio of wanted's gram and n: what the gram's last byte adds to a score."""
    both = model.total.select("gram", "bad", "good", F.lit(0).cast("bigint").alias("n")).unionAll(wanted.select("gram", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "n"))
    routed = both.withColumn("route", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))).repartition("route").drop("route")
    pairs = model.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        gram, bad, good, n = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        asked = gram[n > 0]
        ratio = log_p(asked, gram, bad, pairs[0]) - log_p(asked, gram, good, pairs[1])
        yield pa.RecordBatch.from_pydict({"gram": asked, "n": n[n > 0], "ratio": ratio})

    return routed.mapInArrow(run, "gram bigint, n bigint, ratio double")


def model_of(total: DataFrame) -> UrlModel:
    """The model of stored counts, an empty one where a class is missing. The driver gets the counts of pairs of bytes."""
    pairs = np.zeros((2, 256, 256))
    found = total.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    for c, name in enumerate(("bad", "good")):
        pairs[c].reshape(-1)[found["pair"].to_numpy()] = found[name].to_numpy()
    return UrlModel(total, pairs) if pairs.any((1, 2)).all() else UrlModel()


def cut(scored: list[DataFrame], share: float) -> float:
    """The least multiple of STEP that at most so large a share of the scores exceeds; infinite without scores."""
    bins = int(2 * RANGE / STEP)
    place = F.least(F.greatest(F.ceil((F.col("score") + RANGE) / STEP), F.lit(0)), F.lit(bins)).cast("int")
    found = reduce(DataFrame.unionAll, [x.select("score") for x in scored]).groupBy(place.alias("bin")).count().toArrow()
    n = np.bincount(found["bin"].to_numpy(), found["count"].to_numpy(), bins + 1)
    above = n.sum() - np.cumsum(n)
    return float(np.flatnonzero(above <= share * n.sum())[0] * STEP - RANGE) if n.any() else float("inf")


def train(urls: DataFrame, url_col: str = "url", seeds: tuple[str, ...] = SEEDS, false_rejection: float = FALSE_REJECTION, label_col: str | None = None) -> UrlModel:
    """The two models of all labelled URLs and the calibrated threshold. label_col is true or 1 for a
    rejected URL; without it the seed words decide."""
    rows = labelled(urls, url_col, label_col, seeds)
    halves = stored(counts(rows), "url-halves")
    model = model_of(stored(halves.groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url-counts"))
    if model.total is None:
        return model
    half = [model_of(halves.where(F.col("fold") == f).drop("fold")) for f in (0, 1)]
    sound = all(h.total is not None for h in half)
    accepted = rows.where("not bad").select(F.lit(0).alias("id"), "url", "fold")
    scored = [score(accepted.where(F.col("fold") == 1 - f), half[f], "id", "url") for f in (0, 1)] if sound else [score(accepted, model, "id", "url")]
    return UrlModel(model.total, model.pairs, cut(scored, false_rejection))


def score(urls: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, url, score and accepted per row."""
    chosen = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    if model.total is None:
        return chosen.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.lit(0.0).alias("score"), F.lit(True).alias("accepted"))
    rows = stored(chosen.select(F.monotonically_increasing_id().alias("uid"), "id", "url", F.lower("url").alias("small")), "urls")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), SLICE):
                found, n = np.unique(grams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": found, "n": n})

    wanted = rows.select("small").mapInArrow(seen, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = stored(ratios(wanted, model), "url-ratios")
    head = found.orderBy(F.desc("n"), "gram").limit(HEAD).select("gram", "ratio").toArrow().sort_by("gram")
    sent = urls.sparkSession.sparkContext.broadcast((head["gram"].to_numpy(), head["ratio"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = sent.value
        for batch in batches:
            for a, b, texts in text_slices(batch.column(3), SLICE):
                gram, of = grams(texts)
                here = looked_up(known, np.ones(len(known)), gram) > 0
                total = np.bincount(of, looked_up(known, ratio, gram), b - a).astype(np.float64)  # integers where there is no gram
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[~here], minlength=b - a))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram[~here]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(total), pa.array(np.bincount(of, minlength=b - a)), rest], names=["uid", "id", "url", "total", "size", "rest"])

    scored = rows.mapInArrow(run, f"uid bigint, id {dict(chosen.dtypes)['id']}, url string, total double, size bigint, rest array<bigint>")
    sum_ = F.col("total")
    if found.count() > HEAD:
        scored = stored(scored, "url-scores")
        more = scored.select("uid", F.explode("rest").alias("gram")).join(found.select("gram", "ratio"), "gram").groupBy("uid").agg(F.sum("ratio").alias("more"))
        scored = scored.join(more, "uid", "left")
        sum_ = sum_ + F.coalesce("more", F.lit(0.0))
    value = F.round(sum_ / F.greatest("size", F.lit(1)), 9) + F.lit(0.0)
    return scored.select(F.col("id").alias(id_col), F.col("url").alias(url_col), value.alias("score"), (value <= max(model.threshold, 0.0)).alias("accepted"))
