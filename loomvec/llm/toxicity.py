"""Toxic passages as maximum-scoring segments.

Training compares how often words occur in toxic and in clean labelled documents
as log-odds with an informative Dirichlet prior. A word counts once for each
different pair of neighbours, so copies of a document don't add up. Besides the
word itself its first PREFIX letters are a feature, which carries over to forms
not seen. Features whose log-odds aren't significant get none: such a word only
costs DRIFT, as does every word.

Scanning finds all maximal scoring segments of a document in one pass (Ruzzo and
Tompa). Two statistics tell how strange a document is: its best segments joined by Karlin and Altschul's
sum statistics, where lambda solves E[exp(lambda * score)] = 1 over clean text and Lundberg's bound gives the number
of chance segments of a score S in n words as at most K n exp(-lambda S); and, for toxic words scattered over a long text, the
number of different toxic words beside that of a Poisson law of their rate in clean text. Both are calibrated by
extreme-value theory: each half of the clean labelled documents, dealt by a hash of their text, is scanned with the features of the
other half, and an exponential law is fitted to what exceeds a high threshold (the median
excess, so that a few wrong labels don't move it). A document's p-value is twice the smaller of the two, so
among clean documents about a share of LEAST_P lies below LEAST_P.

Defined results: null and empty texts have no segments and are not toxic; labels
that are null, of absent documents or repeated for one document with both values
are left out; without toxic and clean training text no document is toxic.
Where so many features are toxic that clean text would score above zero, those most
frequent in clean text are left out till it doesn't.
Repeated rows are scored each, extra columns are ignored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm.textarrays import Words, lean, mixed, text_slices, word_hashes
from loomvec.session import stored

#: Labelled documents that are learned from at most, chosen by a hash of their ids.
MAX_TRAINING = 20_000
#: Weight of the prior beside the text, least z-score of a feature, cost of every word, letters of a prefix.
PRIOR_SHARE, LEAST_Z, DRIFT, PREFIX = 0.05, 4.0, 0.5, 5
#: Least p-value of a document that isn't toxic; least expected number of chance segments of one that isn't reported.
LEAST_P, LEAST_E = 0.001, 1.0
#: Share of clean documents whose statistic is fitted as a tail; fewer than so many don't tell its slope, and 1, the bound that theory gives, stands in.
TAIL, LEAST_TAIL = 0.02, 10

SEGMENTS = "array<struct<char_from:int,char_to:int,score:double,e_value:double>>"
COUNTED = "feature string, toxic int, fold int, context bigint"


@dataclass(frozen=True)
class Tail:
    """The law of a statistic in clean documents: a share of them exceeds start, by an exponential law of that slope."""

    share: float = 1.0
    start: float = 0.0
    slope: float = 1.0

    def p(self, value: float) -> float:
        return self.share * math.exp(-self.slope * (value - self.start)) if value > self.start else 1.0


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of significant words and prefixes, the constants of their chance
    distribution, their rate in clean text, and the tails of the two statistics."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    rate: float = 0.0
    tails: tuple[Tail, Tail] = (Tail(), Tail())

    def p(self, statistics: tuple[float, float]) -> float:
        return min(1.0, 2 * min(tail.p(x) for tail, x in zip(self.tails, statistics)))

    def score(self, word: str) -> float:
        return max(self.words.get(word, 0.0), self.prefixes.get(word[:PREFIX], 0.0)) - DRIFT


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic and fold, one of two, of at most so many labelled documents."""
    known = labels.select(F.col(id_col).alias("id"), "toxic").where("id is not null and toxic is not null").groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    chosen = known.where("toxic = other").orderBy(F.xxhash64("id"), "id").limit(most).select("id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
    return texts.join(F.broadcast(chosen), "id").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """toxic, fold, feature, n: the different contexts of every word ("w" + word) and prefix
    ("p" + prefix); and under "n" the words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, folds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j, texts in text_slices(batch.column(0)):
                found = Words(texts)
                if not len(found):
                    continue
                lowered, h = found.lowered(), found.hashes()
                of = np.searchsorted(found.text_words, np.arange(len(h)), side="right") - 1
                left, right = np.roll(h, 1), np.roll(h, -1)
                left[0] = right[-1] = 0
                left[1:][of[1:] != of[:-1]] = 0
                right[:-1][of[1:] != of[:-1]] = 0
                words = [lowered[a:b] for a, b in zip(found.char_from.tolist(), found.char_to.tolist())]
                contexts = mixed(left * np.uint64(31) + right).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(classes[i:j][of]), pa.array(folds[i:j][of]), pa.array(contexts)], names=["feature", "toxic", "fold", "context"])

    keys = ("toxic", "fold")
    once = rows.mapInArrow(lean(run), COUNTED).distinct()
    by_word = stored(once.groupBy("feature", *keys).agg(F.count("*").alias("n")), "toxicity-words")
    prefix = by_word.where(f"length(feature) >= {PREFIX}").groupBy(F.concat(F.lit("p"), F.substring("feature", 1, PREFIX)).alias("feature"), *keys).agg(F.sum("n").alias("n"))
    total = by_word.groupBy(F.lit("n").alias("feature"), *keys).agg(F.sum("n").alias("n"))
    return by_word.select(F.concat(F.lit("w"), "feature").alias("feature"), *keys, "n").unionByName(prefix).unionByName(total)


def fitted(counts: DataFrame) -> ToxicityModel:
    """The features of stored counts. The driver gets those that are at
    once significant and toxic, whose number the bound on training text bounds."""
    of = lambda x: F.coalesce(F.sum(F.when(F.col("toxic") == x, F.col("n"))), F.lit(0))
    counts = counts.groupBy("feature").agg(of(1).alias("t"), of(0).alias("c"))
    total = counts.where("feature = 'n'").first()
    if total is None or not total.t or not total.c:
        return ToxicityModel()
    n_t, n_c = float(total.t), float(total.c)
    scored = with_log_odds(counts.where("feature <> 'n'"), n_t, n_c).where((F.col("z") >= LEAST_Z) & (F.col("delta") > DRIFT))
    found = sorted((clean_rate(r.t, r.c, n_t, n_c), r.feature, r.delta) for r in scored.select("feature", "t", "c", "delta").collect())
    while True:
        words, prefixes = ({f[1:]: d for _, f, d in found if f[0] == kind} for kind in "wp")
        chance = Counter()
        for rate, feature, delta in found:
            if feature[0] == "p" or feature[1 : 1 + PREFIX] not in prefixes:
                chance[delta - DRIFT] += rate
        rate = sum(chance.values())
        if sum(p * s for s, p in chance.items()) < (1 - rate) * DRIFT:
            return ToxicityModel(words, prefixes, *calibrate(chance), rate)
        found.pop()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The model of the labelled documents with calibrated tails. The driver gets histograms of the statistics."""
    rows = training_rows(docs, labels, most, id_col, text_col)
    counts = stored(feature_counts(rows), "toxicity-counts")
    model = fitted(counts)
    if not (model.words or model.prefixes):
        return model
    halves = [fitted(counts.where(F.col("fold") == f)) for f in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for i, j, texts in text_slices(batch.column(0)):
                for fold in (0, 1):
                    own = [t for t, f in zip(texts, folds[i:j]) if f == fold]
                    values = np.array([x for x, _ in scan_slice(sent.value[1 - fold], own)]).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ceil(np.minimum(v, 700) * 100).astype(np.int32)) for v in values.T], names=["a", "b"])

    seen = rows.where("toxic = 0").select("text", "fold").mapInArrow(lean(run), "a int, b int")
    both = seen.select(F.posexplode(F.array("a", "b")).alias("which", "at")).groupBy("which", "at").count().collect()
    tails = [tail({r.at / 100: r["count"] for r in both if r.which == which}) for which in (0, 1)]
    return replace(model, tails=tuple(tails))


def tail(counts: dict[float, int]) -> Tail:
    """The law of a statistic from how often clean documents have each value, 0 for nothing strange."""
    n = sum(counts.values())
    above, start = n - counts.get(0.0, 0), 0.0
    for value in sorted(counts):
        if above <= TAIL * n:
            break
        if value > 0:
            start, above = value, above - counts[value]
    excess = [(x - start, c) for x, c in sorted(counts.items()) if x > start]
    if above < LEAST_TAIL:
        return Tail((n - counts.get(0.0, 0) + 1) / (n + 1))
    reached, half = 0, 0.0
    for half, c in excess:
        reached += c
        if 2 * reached >= above:
            break
    return Tail(above / n, start, math.log(2) / half)


def clean_rate(t: float, c: float, n_t: float, n_c: float) -> float:
    """How often a feature is to be expected in clean text."""
    prior = PRIOR_SHARE * (n_t + n_c)
    return (c + PRIOR_SHARE * (t + c)) / (n_c + prior)


def with_log_odds(counts: DataFrame, n_t: float, n_c: float) -> DataFrame:
    """delta and its z-score beside t and c (Monroe, Colaresi and Quinn)."""
    prior, a = PRIOR_SHARE * (n_t + n_c), PRIOR_SHARE * (F.col("t") + F.col("c"))
    odds = lambda y, n: F.log((y + a) / (F.lit(n + prior) - y - a))
    delta = odds(F.col("t"), n_t) - odds(F.col("c"), n_c)
    deviation = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    return counts.withColumn("delta", delta).withColumn("z", F.col("delta") / deviation)


def calibrate(chance: dict[float, float]) -> tuple[float, float]:
    """lambda and K from the rates of the positive scores in clean text, which scores below zero on average."""
    if not chance:
        return 1.0, 1.0
    rest = max(0.0, 1 - sum(chance.values()))
    excess = lambda x: sum(p * math.exp(x * s) for s, p in chance.items()) + rest * math.exp(-x * DRIFT) - 1
    low, high = 1e-9, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low, max(1e-300, min(1.0, sum(p * math.exp(low * s) for s, p in chance.items())))


def segments(places: list[int], scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first place, last place, score). Given are the
    places of positive scores; every place in between costs DRIFT. Linear time: each
    candidate points at the nearest one to its left that begins lower."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum at the end, pointer
    total, before = 0.0, -1
    for place, score in zip(places, scores):
        left = total - (place - before - 1) * DRIFT
        total, before = left + score, place
        first, low = place, left
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, place, low, total, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def sum_statistic(scores: list[float], n: int, decay: float, scale: float) -> float:
    """How unlikely segments of such scores are in clean text of n words, as -ln p: Karlin and
    Altschul's sum statistics of the best r, r weighted by 2**-r."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += decay * s - math.log(max(scale * n, 1e-300))
        if total <= 0:
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return best


def count_statistic(k: int, mean: float) -> float:
    """-ln of the chance that a Poisson law of that mean gives k or more."""
    if not k or mean <= 0:
        return 0.0
    total = term = 1.0
    i = k
    while term > 1e-12 * total:
        i += 1
        term *= mean / i
        total += term
    return max(0.0, mean - k * math.log(mean) + math.lgamma(k + 1) - math.log(total))


def scan_slice(model: ToxicityModel, texts: list[str | None]) -> list[tuple[tuple[float, float], list[tuple]]]:
    """The two statistics and the reported segments of each text."""
    found = Words(texts)
    out: list[tuple[tuple[float, float], list[tuple]]] = [((0.0, 0.0), [])] * len(texts)
    if not len(found) or not (model.words or model.prefixes):
        return out
    known, prefixes = sorted_hashes(tuple(sorted(model.words))), sorted_hashes(tuple(sorted(model.prefixes)))
    hit = np.flatnonzero(within(found.hashes(), known) | within(found.prefix_hashes(PREFIX), prefixes))
    if not len(hit):
        return out
    lowered = found.lowered()
    of = np.searchsorted(found.text_words, hit, side="right") - 1
    for hits in np.split(hit, np.flatnonzero(np.diff(of)) + 1):
        text = int(np.searchsorted(found.text_words, hits[0], side="right")) - 1
        start = int(found.text_words[text])
        words = [lowered[found.char_from[w] : found.char_to[w]] for w in hits]
        own = [(int(w) - start, model.score(word), word) for w, word in zip(hits, words)]
        own = [x for x in own if x[1] > 0]
        n = int(found.text_words[text + 1]) - start
        parts = segments([w for w, *_ in own], [s for _, s, _ in own])
        base = int(found.text_at[text])
        rows = []
        for a, b, s in parts:
            e = model.scale * n * math.exp(-model.decay * s)
            if e <= LEAST_E:
                rows.append((int(found.char_from[start + a]) - base, int(found.char_to[start + b]) - base, round(s, 6), e))
        statistics = sum_statistic([s for *_, s in parts], n, model.decay, model.scale), count_statistic(len({word for *_, word in own}), n * model.rate)
        out[text] = statistics, rows
    return out


@lru_cache(4)
def sorted_hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(word_hashes(list(words))) if words else np.zeros(0, np.uint64)


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def find(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least_p: float = LEAST_P) -> DataFrame:
    """id_col, p_value and segments of the toxic documents."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("char_from", pa.int32()), ("char_to", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
    keys = ("char_from", "char_to", "score", "e_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in text_slices(batch.column(1)):
                found = scan_slice(sent.value, texts)
                p_values = [sent.value.p(x) for x, _ in found]
                at = [i for i, p in enumerate(p_values) if p <= least_p]
                rows = [[dict(zip(keys, x)) for x in found[i][1]] for i in at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + i for i in at], pa.int64())), pa.array([p_values[i] for i in at], pa.float64()), pa.array(rows, kind)], names=[id_col, "p_value", "segments"])

    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)['id']}, p_value double, segments {SEGMENTS}")


def clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least_p: float = LEAST_P) -> DataFrame:
    """The rows, unchanged, of documents that aren't toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                keep = [sent.value.p(x) > least_p for x, _ in scan_slice(sent.value, texts)]
                yield batch.slice(a, b - a).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
