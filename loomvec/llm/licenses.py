"""License scans by template markup.

A template is a license text or notice with regions: <<beginOptional>> ...
<<endOptional>> may be left out whole; <<var;name="x";original="y";match="regex">> stands for any
text that the regular expression matches as a whole, over line ends too. It compiles to an automaton over word tokens: the
mandatory words must follow one another exactly, in whatever case, spacing and
punctuation. Spelling variants (licence, license) count as equal.

A region is any number of words, at least one where its expression can't match nothing: as few as lead to a match,
however many these are. An expression of words parted by | is a choice of one word. Where an expression is another than .+ or .*
it decides, on the text between the words around the region, once the automaton has found a place; the regions' bounds are then sought
by the expression itself. tokens="a-b", an addition to the markup, bounds the number of words, and as many as lead to a match are taken.

Whole texts of licenses are in templates.zip beside this module, read by load_templates, which
takes a folder or archive of the user's as well; NOTICES are lines that name a license. A license's terms are the template, without
title, preamble and instructions.

A document is scanned in one pass per template that it can match at all: Spark
first drops the texts that lack a mandatory word of every template, then those
tokens decide which templates to run. A pass from the end backwards marks where matches can begin, so
repeated beginnings cost nothing. Matches of one template are leftmost,
don't overlap, and are the longest after the last region without bounds.

Defined results: null and empty texts match nothing; a document has a row for
each license found, repeated rows have theirs each; very long texts count whole; extra columns are
ignored; an empty table gives no rows. A template without mandatory words is an error."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib.resources import files
from io import BytesIO
from pathlib import Path
from zipfile import ZipFile, is_zipfile

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm.textarrays import text_slices

TOKEN = regex.compile(r"[\p{L}\p{N}]+")
VARIANTS = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization", "merchantibility": "merchantability"}
MARK = regex.compile(r"""<<(beginOptional|endOptional|var)((?:;\s*\w+=(?:"[^"]*"|'[^']*'))*)\s*;?>>""")
#: Subset states an automaton keeps; more are worked out again. It changes no result.
STATES = 50_000

VERBS = '<<var;name="verb";match="released|licensed|distributed|available|provided|published|offered">>'
THIS = '<<beginOptional>>This <<var;name="what";tokens="1-3">> is <<endOptional>>'
TERMS = "<<beginOptional>>the terms of <<endOptional>>"
#: Lines that name a license.
NOTICES = {
    "MIT-notice": f"{THIS}{VERBS} under {TERMS}the MIT License",
    "Apache-2.0-notice": f"{VERBS} under {TERMS}the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use <<var;name=\"what\";tokens=\"1-3\">> except in compliance with the License<<endOptional>>",
    "GPL-3.0-notice": f"{THIS}{VERBS} under {TERMS}the GNU General Public License, version 3<<beginOptional>> or later<<endOptional>>",
    "GPL-3.0-or-later": "This <<var;name=\"what\";tokens=\"1-3\">> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version",
    **{f"CC-{x}-4.0-notice": f"{THIS}{VERBS} under <<beginOptional>>a <<endOptional>>CC {x} 4.0<<beginOptional>> License<<endOptional>>" for x in ("BY-NC", "BY", "BY-SA")},
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this <<var;name=\"what\";tokens=\"1-3\">>, You can obtain one at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0",
}


def load_templates(path: str | Path | None = None) -> dict[str, str]:
    """License id to template, of the .txt files of a folder or a zip archive; without a path of the package's own, which may itself be shipped as an archive."""
    if path is None or is_zipfile(path):
        with ZipFile(path or BytesIO(files(__package__).joinpath("templates.zip").read_bytes())) as z:
            return {n.removesuffix(".txt"): z.read(n).decode() for n in sorted(z.namelist()) if n.endswith(".txt")}
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("*.txt"))}


#: License id to template: whole texts and notices.
TEMPLATES = load_templates() | NOTICES


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with the characters they cover."""
    return [(VARIANTS.get(w := m.group().lower(), w), *m.span()) for m in TOKEN.finditer(text)]


@dataclass(frozen=True)
class Optional_:
    parts: tuple


@dataclass(frozen=True)
class Var:
    """least to most words, or any number; match decides on the text where it is given."""

    least: int
    most: int | None
    match: str | None = None


@dataclass(frozen=True)
class Choice:
    """One of some words."""

    words: frozenset


def region(attributes: str) -> Var | Choice:
    given = {m[1]: m[2] or m[3] or "" for m in regex.finditer(r"""(\w+)=(?:"([^"]*)"|'([^']*)')""", attributes)}
    if bounds := regex.fullmatch(r"(\d+)-(\d+)", given.get("tokens", "")):
        return Var(*map(int, bounds.groups()))
    match = given.get("match", ".+")
    if regex.fullmatch(r"\w+(\|\w+)*", match):
        return Choice(frozenset(tokens(w)[0][0] for w in match.split("|")))
    return Var(0 if regex.compile(match, regex.DOTALL).fullmatch("") else 1, None, None if match in (".+", ".*") else match)


def parse(template: str) -> tuple:
    """A template as nested parts: words, Optional_, Var and Choice."""
    stack: list[list] = [[]]
    at = 0
    for m in MARK.finditer(template):
        stack[-1] += [w for w, _, _ in tokens(template[at : m.start()])]
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = Optional_(tuple(stack.pop()))
            stack[-1].append(inner)
        else:
            stack[-1].append(region(m[2]))
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    stack[0] += [w for w, _, _ in tokens(template[at:])]
    return tuple(stack[0])


def source(parts: tuple) -> str:
    """The parts as a regular expression on text, each followed by what parts words."""
    gap, out = r"(?:[^\p{L}\p{N}]+|\Z|(?<![\p{L}\p{N}])|(?![\p{L}\p{N}]))", ""
    spelt = lambda w: "(?:" + "|".join(map(regex.escape, [w, *(v for v, x in VARIANTS.items() if x == w)])) + r")(?![\p{L}\p{N}])"
    for part in parts:
        if isinstance(part, str):
            out += spelt(part) + gap
        elif isinstance(part, Choice):
            out += "(?:" + "|".join(map(spelt, sorted(part.words))) + ")" + gap
        elif isinstance(part, Optional_):
            out += f"(?:{source(part.parts)})?"
        elif part.match is not None:
            out += f"(?s:(?:{part.match})){gap}"
        elif part.most is None:
            out += rf"(?:[\p{{L}}\p{{N}}]+{gap}){{{part.least},}}?"
        else:
            out += rf"(?:[\p{{L}}\p{{N}}]+{gap}){{{part.least},{part.most}}}"
    return out


class Automaton:
    """A template's states as bits; subsets met in scanning become states of a
    deterministic automaton, kept for the next scan."""

    def __init__(self, parts: tuple):
        self.words: list[frozenset | None] = []  # the words that lead from state i to i + 1, None for any
        skips: list[tuple[int, int]] = []
        self.loops = 0  # states that any word keeps
        self.decides = None

        def add(parts: tuple) -> None:
            for part in parts:
                start = len(self.words)
                if isinstance(part, str):
                    self.words.append(frozenset((part,)))
                elif isinstance(part, Choice):
                    self.words.append(part.words)
                elif isinstance(part, Optional_):
                    add(part.parts)
                    skips.append((start, len(self.words)))
                elif part.most is None:
                    self.words += [None] * part.least
                    self.loops |= 1 << len(self.words)
                    self.decides = self.decides or part.match
                else:
                    self.words += [None] * part.most
                    skips.extend((start + i, start + part.most) for i in range(part.least, part.most))

        add(parts)
        n = len(self.words)
        self.final = 1 << n
        self.mandatory = frozenset(p for p in parts if isinstance(p, str))
        self.close = closure(skips)
        self.back = closure([(b, a) for a, b in skips])
        self.start, self.ends = joined(self.close, 1), joined(self.back, self.final)
        if not self.mandatory or self.start & self.final:
            raise ValueError("a template needs mandatory wording")
        self.past = -1 << self.loops.bit_length()  # states after the last region without bounds
        self.by_word: dict[str, int] = {}
        self.any = 0
        for i, ws in enumerate(self.words):
            if ws is None:
                self.any |= 1 << i
            for w in ws or ():
                self.by_word[w] = self.by_word.get(w, 0) | 1 << i
        self.steps: dict[tuple[int, str | None], int] = {}
        self.steps_back: dict[tuple[int, str | None], int] = {}
        self.expression = regex.compile(source(parts), regex.IGNORECASE) if self.decides is not None else None

    def step(self, states: int, word: str) -> int:
        key = (states, word if word in self.by_word else None)
        found = self.steps.get(key)
        if found is None:
            found = joined(self.close, (states & (self.any | self.by_word.get(word, 0))) << 1 | states & self.loops)
            remember(self.steps, key, found)
        return found

    def step_back(self, states: int, word: str) -> int:
        """States from which a word leads to one of the given ones."""
        key = (states, word if word in self.by_word else None)
        found = self.steps_back.get(key)
        if found is None:
            found = joined(self.back, states >> 1 & (self.any | self.by_word.get(word, 0)) | states & self.loops)
            remember(self.steps_back, key, found)
        return found

    def matches(self, words: list[str]) -> list[tuple[int, int]]:
        """Leftmost matches as ranges of words."""
        n = len(words)
        able = bytearray(n)
        states = self.ends
        for i in range(n - 1, -1, -1):
            states = self.step_back(states, words[i])
            able[i] = states & 1
            states |= self.ends
        out = []
        at = able.find(1)
        while at >= 0:
            states, i, end = self.start, at, None
            while states and i < n:
                states = self.step(states, words[i])
                i += 1
                if states & self.final:
                    end = i
                    states &= self.past
            out.append((at, end))
            at = able.find(1, end)
        return out

    def ranges(self, text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
        """Matches as (first word, character from, character to)."""
        out = [(a, found[a][1], found[b - 1][2]) for a, b in self.matches([w for w, _, _ in found])]
        if self.expression is None or not out:
            return out
        begins = {c: i for i, (_, c, _) in enumerate(found)}
        ends = sorted(c for _, _, c in found)
        out, at = [], 0
        for m in self.expression.finditer(text):
            last = max((c for c in ends[bisect_left(ends, m.start()) : bisect_right(ends, m.end())]), default=None)
            if m.start() in begins and m.start() >= at and last is not None:
                out.append((begins[m.start()], m.start(), last))
                at = last
        return out


def closure(skips: list[tuple[int, int]]) -> tuple[int, dict[int, int]]:
    """The states from which others are reached without a word, and by state those others."""
    to: dict[int, list[int]] = {}
    for a, b in skips:
        to.setdefault(a, []).append(b)
    reached: dict[int, int] = {}
    for a in sorted(to, reverse=all(a <= b for a, b in skips)):  # what is reached from b is known before
        reached[a] = 0
        for b in to[a]:
            reached[a] |= 1 << b | reached.get(b, 0)
    return sum(1 << a for a in to), reached


def joined(close: tuple[int, dict[int, int]], states: int) -> int:
    begin, reached = close
    left = states & begin
    while left:
        low = left & -left
        states |= reached[low.bit_length() - 1]
        left ^= low
    return states


@lru_cache(4)
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[str, Automaton]:
    return {k: Automaton(parse(t)) for k, t in templates}


def remember(steps: dict, key: tuple, found: int) -> None:
    if len(steps) >= STATES:
        steps.clear()
    steps[key] = found


def cover(automata: dict[str, Automaton]) -> list[str]:
    """Few words of which every template has one as mandatory, in all spellings: no text without any can match."""
    left, chosen = set(automata), []
    words = sorted({w for a in automata.values() for w in a.mandatory if len(w) > 2}, key=lambda w: (-len(w), w))
    while left:
        best = max(words, key=lambda w: (sum(w in automata[k].mandatory for k in left), len(w)))
        hit = {k for k in left if best in automata[k].mandatory}
        if not hit:
            raise ValueError("a template has no word of three letters")
        chosen.append(best)
        left -= hit
    return [*chosen, *(v for v, w in VARIANTS.items() if w in chosen)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, license_id, n_matches, first_token and matches, the ranges of characters,
    for every document and each license found in it."""
    given = tuple(templates.items())
    needed = cover(compiled(given))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lowered = F.lower("text")
    possible = F.lit(False)
    for w in needed:
        possible = possible | lowered.contains(w)
    names = [id_col, "license_id", "n_matches", "first_token", "matches"]
    kind = pa.list_(pa.struct([("char_from", pa.int32()), ("char_to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(given)
        for batch in batches:
            of, rows = [], []
            for begin, _, texts in text_slices(batch.column(1)):
                for i, text in enumerate(texts, begin):
                    found = tokens(text)
                    have = {w for w, _, _ in found}
                    for name, automaton in automata.items():
                        if automaton.mandatory <= have and (hits := automaton.ranges(text, found)):
                            of.append(i)
                            rows.append((name, len(hits), hits[0][0], [{"char_from": a, "char_to": b} for _, a, b in hits]))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], kind)], names=names)

    schema = f"`{id_col}` {dict(chosen.dtypes)['id']}, license_id string, n_matches int, first_token int, matches array<struct<char_from:int,char_to:int>>"
    return chosen.where(possible).mapInArrow(run, schema)


# The same in SQL


def pattern(parts: tuple) -> str:
    """A template as a regular expression over words written <word>."""
    out = ""
    for part in parts:
        if isinstance(part, str):
            out += f"<{regex.escape(part)}>"
        elif isinstance(part, Choice):
            out += "<(?:" + "|".join(sorted(part.words)) + ")>"
        elif isinstance(part, Optional_):
            out += f"(?:{pattern(part.parts)})?"
        elif part.most is None:
            out += "(?:<[^<>]+>){%d,}?" % part.least
        else:
            out += "(?:<[^<>]+>){%d,%d}" % (part.least, part.most)
    return out


def oracle(templates: dict[str, str] = TEMPLATES, table: str = "documents") -> str:
    """DuckDB SQL for id, license, number of matches and the first one's place. Templates without regions are plain
    wording; expressions other than .+ and .* aren't in it."""
    words = r"'<' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', '><', 'g') || '>'"
    for variant, word in VARIANTS.items():
        words = f"replace({words}, '<{variant}>', '<{word}>')"
    parsed = {k: parse(t) for k, t in templates.items()}
    plain = {k for k, t in parsed.items() if all(isinstance(x, str) for x in t)}
    rows = ", ".join(f"('{k}', '{pattern(t)}')" for k, t in parsed.items() if k not in plain)
    literal = ", ".join(f"('{k}', '{''.join(f'<{w}>' for w in t)}')" for k, t in parsed.items() if k in plain) or "('', '')"
    count = lambda x: f"CAST(len(regexp_extract_all({x}, '<[^<>]+>')) AS INTEGER)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM {table} WHERE text IS NOT NULL)
SELECT doc_id, license_id, CAST(len(regexp_extract_all(w, p)) AS INTEGER) AS n_matches, {count("split_part(w, regexp_extract(w, p), 1)")} AS first_token
FROM d, (VALUES {rows}) AS t(license_id, p) WHERE regexp_matches(w, p)
UNION ALL
SELECT doc_id, license_id, CAST((len(w) - len(replace(w, p, ''))) / len(p) AS INTEGER) AS n_matches, {count("split_part(w, p, 1)")} AS first_token
FROM d, (VALUES {literal}) AS t(license_id, p) WHERE p <> '' AND contains(w, p)"""
