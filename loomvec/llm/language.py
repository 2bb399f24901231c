"""Language identification of mixed text.

Words are runs of letters of one script; where the script changes inside a run of letters, a
word ends. A word's script leaves a few candidate languages: those whose labelled text has at
least LEAST_SHARE of its letters in the script, and of the trained ones those known to be written with it (SCRIPTS). Han
and kana that touch are one word, Japanese where it has kana. Each candidate scores the
word by the log-probabilities of its letter trigrams, counted over all
documents, and a Viterbi pass over the words with a penalty for each switch of
language yields spans. A word of a script that has no trained candidate gets the
script's first known language, "und" where none is known.

A language model is one row of log-probabilities over hashed trigrams, so its
size doesn't depend on the corpus. A further row, "und", stands for anything
else: to it every trigram is as likely as in a flat distribution. The MAX_LANGUAGES labels of most
documents (of equals the first in order) are learned, so a column of stray labels doesn't make the model grow.

Texts are worked on as arrays of code points, many documents at once.

Defined results: a null or empty text, and one without letters, has lang "und",
no spans and share 0. Null or empty language labels are not learned from. Ties
go to the label first in order, and to staying in a language. Repeated rows
count, and are labelled, each. Extra columns are ignored. Very long texts count whole. Without any labelled
text all Latin words are "und"."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, name

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm.textarrays import BLANK, Words, lean, text_slices

BUCKETS = 1 << 16
#: Pseudo-count that spreads mass over trigrams a language hasn't shown, log-odds that a switch costs, and
#: what "und" gets per letter beside a flat distribution.
PRIOR, SWITCH, UND_BONUS = 0.5, 8.0, -1.0
#: Least share of a language's letters in a script that makes it a candidate there; labels learned at most.
LEAST_SHARE, MAX_LANGUAGES = 0.01, 128
#: Characters labelled at once, many, as each place in a text is one step for all texts; and texts
#: that are few enough to be finished one by one. Neither changes a result.
LABELLED, FEW = 1_000_000, 4

#: Languages written with a script, by the word that begins the names of its letters.
SCRIPTS: dict[str, tuple[str, ...]] = {
    "GREEK": ("el",), "CYRILLIC": ("ru", "uk", "bg", "sr"), "ARMENIAN": ("hy",), "HEBREW": ("he", "yi"), "ARABIC": ("ar", "fa", "ur"), "DEVANAGARI": ("hi", "mr", "ne"), "BENGALI": ("bn",), "GURMUKHI": ("pa",), "GUJARATI": ("gu",), "ORIYA": ("or",),
    "TAMIL": ("ta",), "TELUGU": ("te",), "KANNADA": ("kn",), "MALAYALAM": ("ml",), "SINHALA": ("si",), "THAI": ("th",), "LAO": ("lo",), "TIBETAN": ("bo",), "MYANMAR": ("my",), "KHMER": ("km",), "GEORGIAN": ("ka",), "ETHIOPIC": ("am", "ti"), "THAANA": ("dv",),
    "HANGUL": ("ko",), "HIRAGANA": ("ja",), "CJK": ("zh", "ja"),
}
#: Other beginnings of names; None is a sign of any script, which takes that of its neighbours.
NAMES = {"KATAKANA": "HIRAGANA", "KATAKANA-HIRAGANA": "HIRAGANA", "IDEOGRAPHIC": "CJK", "BOPOMOFO": "CJK", "COMBINING": None, "MODIFIER": None, "MASCULINE": None, "FEMININE": None, "VARIATION": None, "MICRO": None, "": None}

SPANS = "array<struct<char_from:int,char_to:int,lang:string>>"
SEEN = "lang int, bucket int, n bigint"


@lru_cache(1)
def script_table() -> tuple[list[str], np.ndarray]:
    """Names of scripts and, by code point, a letter's script as a place in them; 0 for what has none of its own."""
    names, at = [""], {None: 0}
    table = np.zeros(0x110000, dtype=np.int16)
    for c in range(0x110000):
        if category(chr(c))[0] in "LM":
            first, _, rest = name(chr(c), "").partition(" ")
            if first in ("FULLWIDTH", "HALFWIDTH"):
                first = rest.partition(" ")[0]
            first = NAMES.get(first, first)
            if first not in at:
                at[first] = len(names)
                names.append(first)
            table[c] = at[first]
    return names, table


class ScriptWords:
    """The words of some texts, parted where the script changes. word_at, char_from, char_to and
    text_words are as in Words; script is each word's, buckets the hashed trigram around each letter, beside a word are blanks."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts)
        names, table = script_table()
        self.source, self.at, self.text_at = words.source, words.at, words.text_at
        own = table[words.source[words.at - 1]]
        n = len(own)
        if (own == 0).any():
            begins = np.repeat(words.word_at, np.diff(words.word_at, append=n))
            ends = np.repeat(np.append(words.word_at[1:], n), np.diff(words.word_at, append=n))
            before = np.maximum.accumulate(np.where(own > 0, np.arange(n), -1))
            after = np.minimum.accumulate(np.where(own > 0, np.arange(n), n)[::-1])[::-1]
            source = np.where(before >= begins, before, np.where(after < ends, after, np.arange(n)))
            own = own[source]
        kana, han = names.index("HIRAGANA"), names.index("CJK")
        group = np.where(own == kana, han, own)
        begin = np.zeros(n, dtype=bool)
        begin[words.word_at] = True
        begin[1:] |= group[1:] != group[:-1]
        self.word_at = np.flatnonzero(begin)
        last = np.append(self.word_at[1:], n) - 1 if n else self.word_at
        self.char_from, self.char_to = words.at[self.word_at] - 1, words.at[last]
        self.text_words = np.searchsorted(self.char_from, self.text_at)
        self.script = group[self.word_at]
        if n and (self.script == han).any():
            self.script = np.where(np.logical_or.reduceat(own == kana, self.word_at), kana, self.script)
        c = words.chars.astype(np.uint64)
        left, right = c[words.at - 1], c[words.at + 1]
        left[self.word_at] = right[last] = BLANK
        h = (left * np.uint64(0x9E3779B97F4A7C15) + c[words.at] * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        self.buckets = (h >> np.uint64(48)).astype(np.int32)

    def letters(self) -> np.ndarray:
        """How many each word has."""
        return np.diff(self.word_at, append=len(self.at))


def trigram_counts(docs: DataFrame, languages: list[str], text_col: str, lang_col: str) -> DataFrame:
    """SEEN: how often each language, as a place in languages, has each hashed trigram, over all
    documents; beyond BUCKETS, how many letters it has in each script."""
    size = BUCKETS + len(script_table()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(1)):
                own = batch.column(0).filter(pc.equal(batch.column(1), lang))
                n = seen.setdefault(languages.index(lang.as_py()), np.zeros(size, dtype=np.int64))
                for _, _, texts in text_slices(own):
                    words = ScriptWords(texts)
                    n += np.bincount(words.buckets, minlength=size)
                    n[BUCKETS:] += np.bincount(words.script, words.letters(), size - BUCKETS).astype(np.int64)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": np.full(len(at), lang, np.int32), "bucket": at.astype(np.int32), "n": n[at]})

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("length(text) > 0").where(F.col("lang").isin(languages))
    return known.mapInArrow(lean(run), SEEN).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities of hashed trigrams and candidates by script. Labels: trained languages in order,
    "und", then those known by script alone."""

    def __init__(self, counts: dict[str, np.ndarray]):
        names, _ = script_table()
        self.languages = sorted(counts)
        seen = {x: counts[x][:BUCKETS] for x in self.languages}
        rows = [np.log((seen[x] + PRIOR) / (seen[x] + PRIOR).sum()) for x in self.languages]
        distinct = max([1, *(int((c > 0).sum()) for c in seen.values())])
        self.log_p = np.stack([*rows, np.full(BUCKETS, -np.log(distinct) + UND_BONUS)]).astype(np.float32)
        by_script = {x for langs in SCRIPTS.values() for x in langs}
        self.labels = [*self.languages, "und", *sorted(by_script - {*self.languages, "und"})]
        self.candidates = np.zeros((len(names), len(self.languages)), dtype=bool)
        self.known = np.full(len(names), -1)  # the label of a script without candidates
        for k, x in enumerate(self.languages):
            letters = counts[x][BUCKETS:]
            self.candidates[:, k] = (letters > 0) & (letters >= LEAST_SHARE * letters.sum())
        for script, langs in SCRIPTS.items():
            i = names.index(script)
            self.candidates[i] |= np.array([x in langs for x in self.languages], dtype=bool)
            if not self.candidates[i].any():
                self.known[i] = self.labels.index(langs[0])

    def scores(self, words: ScriptWords) -> np.ndarray:
        """Log-probability of each word under each label; -inf where its script excludes one."""
        out = np.full((len(words.word_at), len(self.labels)), -np.inf, dtype=np.float32)
        if not len(out):
            return out
        for k in range(len(self.languages) + 1):
            out[:, k] = np.add.reduceat(self.log_p[k][words.buckets], words.word_at)
        for script in np.unique(words.script):
            of = words.script == script
            out[np.ix_(of, np.flatnonzero(~self.candidates[script]))] = -np.inf
            if self.known[script] >= 0:
                out[of, self.known[script]] = 0
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of all labelled documents. The driver gets BUCKETS counts a language, and one for each
    script, at most, of at most MAX_LANGUAGES languages."""
    labelled = docs.where(f"length(`{text_col}`) > 0 and length(`{lang_col}`) > 0").groupBy(F.col(lang_col).alias("lang")).count()
    languages = [r.lang for r in labelled.orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    found = trigram_counts(docs, languages, text_col, lang_col).toArrow()
    lang, bucket, n = (found[c].to_numpy() for c in ("lang", "bucket", "n"))
    counts = {}
    for i in np.unique(lang):
        counts[languages[i]] = np.zeros(BUCKETS + len(script_table()[0]))
        counts[languages[i]][bucket[lang == i]] = n[lang == i]
    return LanguageModel(counts)


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores: words by labels, texts one after another;
    starts: where each text's words begin, with the end. All texts advance together,
    so the work is linear in the words and has a step for each place in a text."""
    path = np.zeros(len(scores), dtype=np.int64)
    if not len(scores):
        return path
    used = np.flatnonzero(np.isfinite(scores).any(0))
    scores = scores[:, used]
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = starts[:-1][order], lengths[order]
    live = [int(x) for x in np.searchsorted(-lengths, -np.arange(lengths[0] + 1), side="left")]  # texts of more than t words
    stay = np.ones(scores.shape, dtype=bool)
    came = np.zeros(len(scores), dtype=np.uint8)
    state = np.zeros(live[0], dtype=np.int64)
    best = scores[begin[: live[0]]].astype(np.float64)
    shared = next(t for t in range(1, len(live)) if live[t] <= FEW)  # from there on few texts go on
    for t in range(1, shared + 1):
        if t == shared:
            for i in range(live[t]):
                rows = slice(int(begin[i]) + t, int(begin[i]) + int(lengths[i]))
                state[i] = finish(best[i].tolist(), scores[rows], stay[rows], came[rows], switch)
        state[live[t] : live[t - 1]] = best[live[t] :].argmax(1)
        if t == shared:
            break
        best = best[: live[t]]
        rows = begin[: live[t]] + t
        jump = best.max(1) - switch
        keep = best >= jump[:, None]
        stay[rows] = keep
        came[rows] = best.argmax(1)
        best = np.where(keep, best, jump[:, None]) + scores[rows]
    for i in range(live[shared]):
        rows = slice(int(begin[i]) + shared, int(begin[i]) + int(lengths[i]))
        path[rows], state[i] = retrace(int(state[i]), stay[rows], came[rows])
    for t in range(shared - 1, -1, -1):
        now = state[: live[t]]
        rows = begin[: live[t]] + t
        path[rows] = now
        state[: live[t]] = np.where(stay[rows, now], now, came[rows])
    return used[path]


def finish(best: list[float], scores: np.ndarray, stay: np.ndarray, came: np.ndarray, switch: float) -> int:
    """The remaining steps of one text in plain numbers, into stay and came; the last label."""
    places = range(len(best))
    for a in range(0, len(scores), 50_000):
        kept, jumps = bytearray(), bytearray()
        for row in scores[a : a + 50_000].tolist():
            most = max(best)
            jump = most - switch
            jumps.append(best.index(most))
            for k in places:
                if best[k] >= jump:
                    kept.append(1)
                    best[k] += row[k]
                else:
                    kept.append(0)
                    best[k] = jump + row[k]
        stay[a : a + 50_000] = np.frombuffer(kept, dtype=bool).reshape(-1, len(best))
        came[a : a + 50_000] = np.frombuffer(jumps, dtype=np.uint8)
    return best.index(max(best))


def retrace(label: int, stay: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, int]:
    """The labels of finish()'s steps from the last one back, and the label before them."""
    path = bytearray(len(came))
    for a in range((len(came) - 1) // 50_000 * 50_000, -1, -50_000):
        kept, jumps = stay[a : a + 50_000].tolist(), came[a : a + 50_000].tolist()
        for i in range(len(jumps) - 1, -1, -1):
            path[a + i] = label
            if not kept[i][label]:
                label = jumps[i]
    return np.frombuffer(path, dtype=np.uint8), label


def label_slice(model: LanguageModel, texts: list[str | None]) -> list[pa.Array]:
    """The columns lang, share and spans."""
    words = ScriptWords(texts)
    path = viterbi(model.scores(words), words.text_words)
    letters = (words.char_to - words.char_from).astype(np.float64)
    of = np.repeat(np.arange(len(texts)), np.diff(words.text_words))
    n_labels, und = len(model.labels), len(model.languages)
    mass = np.bincount(of * n_labels + path, letters, len(texts) * n_labels).reshape(len(texts), n_labels)
    total = mass.sum(1)
    known = mass.copy()
    known[:, und] = 0
    lang = np.where(known.max(1) > 0, known.argmax(1), und)
    share = mass[np.arange(len(texts)), lang] / np.maximum(total, 1)
    new = np.ones(len(path), dtype=bool)
    new[1:] = (path[1:] != path[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(path)) - 1 if len(head) else head
    base = words.text_at[of[head]]
    names = pa.array(model.labels)
    inner = pa.StructArray.from_arrays(
        [pa.array((words.char_from[head] - base).astype(np.int32)), pa.array((words.char_to[tail] - base).astype(np.int32)), names.take(pa.array(path[head]))], names=["char_from", "char_to", "lang"]
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of[head], minlength=len(texts)))]).astype(np.int32)
    return [names.take(pa.array(lang)), pa.array(np.round(share, 6)), pa.ListArray.from_arrays(pa.array(offsets), inner)]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang, share and spans per row: lang has most of the letters, share tells
    how many of them, spans are the runs of words in one language."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "lang", "share", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), LABELLED):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *label_slice(sent.value, texts)], names=names)

    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)['id']}, lang string, share double, spans {SPANS}")


def word_labels(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The label of every word of the texts, its letters and its text. Words are found and scored in smaller slices
    than paths, and of the scores only labels that some word can have are held."""
    scores, letters, n = [], [], []
    for _, _, texts in text_slices(column):
        words = ScriptWords(texts)
        own = model.scores(words)
        used = np.flatnonzero(np.isfinite(own).any(0))
        scores.append((used, own[:, used]))
        letters.append((words.char_to - words.char_from).astype(np.float64))
        n.append(np.diff(words.text_words))
    del words, own
    used = np.unique(np.concatenate([x for x, _ in scores]))
    every = np.full((sum(map(len, letters)), len(used)), -np.inf, dtype=np.float32)
    begin = 0
    for x, own in scores:
        every[begin : begin + len(own), np.searchsorted(used, x)] = own
        begin += len(own)
    n = np.concatenate(n)
    path = viterbi(every, np.concatenate([[0], np.cumsum(n)]))
    return used[path] if len(path) else path, np.concatenate(letters), np.repeat(np.arange(len(n)), n)


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, unchanged, of which at least so large a part of the letters has an
    identified language; rows without letters go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        und = len(sent.value.languages)
        for batch in batches:
            for a, b, _ in text_slices(batch.column(at), LABELLED):
                path, letters, of = word_labels(sent.value, batch.column(at).slice(a, b - a))
                total = np.bincount(of, letters, b - a)
                keep = (total > 0) & (np.bincount(of, letters * (path != und), b - a) >= least * total)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
