"""License scans beside SQL and regular expressions."""

import time

import regex
from compare import spark_rows, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import catalogue, licenses


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(catalogue.QUERIES["op2_licenses"](spark, sf)) == sql_rows(catalogue.ORACLES["op2_licenses"], sf)


TEMPLATE = 'a b<<beginOptional>> c<<beginOptional>> d<<endOptional>><<endOptional>> <<var;name="x";tokens="0-2">> e'


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefx"), max_size=25))
def test_automaton_equals_regular_expression(words):
    parts = licenses.parse(TEMPLATE)
    found = licenses.Automaton(parts).matches(words)
    # the leftmost longest match, by trying every end from the far one
    whole, at, expected = regex.compile(licenses.pattern(parts)), 0, []
    while at < len(words):
        end = next((e for e in range(len(words), at, -1) if whole.fullmatch("".join(f"<{w}>" for w in words[at:e]))), None)
        if end:
            expected.append((at, end))
        at = end or at + 1
    assert found == expected


def words(text):
    return [w for w, _, _ in licenses.tokens(text)]


def filled(name, region="the authors"):
    """A template's text with its regions filled and its options in or out."""
    text = regex.sub(r"<<var;[^<]*?>>", lambda m: "1." if "bullet" in m[0] else region, licenses.load_templates()[name])
    return regex.sub(r"<<\w+>>", "", text), regex.sub(r"(?:<<beginOptional>>[^<]*?<<endOptional>>)", "", text)


def matched(name, text):
    return licenses.Automaton(licenses.parse(licenses.TEMPLATES[name])).ranges(text, licenses.tokens(text))


def test_mandatory_wording_is_exact():
    full, short = filled("MIT", "the authors or copyright holders")
    n = len(full)
    assert matched("MIT", full) == [(0, 0, n - 1)] and len(matched("MIT", short)) == 1
    assert len(matched("MIT", full.upper().replace(" ", "\n * "))) == 1
    assert matched("MIT", full.replace("without restriction", "with restriction")) == []
    assert matched("MIT", full.replace("free of charge", "free of any charge")) == []
    assert len(matched("MIT", full.replace("authors or copyright holders", "a " * 500))) == 1  # a region has no bound
    assert [m[0] for m in matched("MIT", full + " And " + full)] == [0, len(words(full)) + 1]


def test_whole_texts():
    """Each whole text is found by its own template alone, and not when one word of it is another."""
    found = licenses.load_templates()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense", "Zlib"} <= set(found)
    for name in found:
        text = "Some title. " + filled(name)[1 if name == "Unlicense" else 0] + " And more."
        assert [k for k in found if matched(k, text)] == [name]
        middle = words(text)[len(words(text)) // 2]
        at = [m.span() for m in regex.finditer(rf"(?i)\b{middle}\b", text)]
        a, b = at[len(at) // 2]
        changed = text[:a] + "otherwise so" + text[b:]
        assert not matched(name, changed) or "otherwise" in middle


def test_markup():
    """The attributes of regions: expressions with >, choices, bounds, nothing."""
    of = lambda t, text: [text[a:b] for _, a, b in licenses.Automaton(licenses.parse(t)).ranges(text, licenses.tokens(text))]
    assert of('from <<var;name="x";original="<y>";match="[^>]+">> to', "a from b c to d from x > y to z") == ["from b c to"]
    assert of('year <<var;name="y";match="[0-9]{4}">> by', "year 2020 by year 20 by year 2021 by") == ["year 2020 by", "year 2021 by"]
    assert of('go <<var;name="y";match="left|right">> now', "go left now go up now GO RIGHT NOW") == ["go left now", "GO RIGHT NOW"]
    assert of('a <<var;name="y";match=".{0,3}">> b', "a b a xx b a xxxxx b") == ["a b", "a xx b"]
    assert of("a <<var;name='y';match='.+'>> b<<beginOptional;name=\"z\">> c<<endOptional>>", "a b b c a") == ["a b b c"]
    assert of('a <<var;name="y";match=".*">> b', "a b c b") == ["a b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdeab"), max_size=25))
def test_regions_without_bounds_equal_a_regular_expression(found):
    parts = licenses.parse('a b <<var;name="x";match=".+">> c<<beginOptional>> d<<beginOptional>> e<<endOptional>><<endOptional>>')
    line = "".join(f"<{w}>" for w in found)
    expected = [(line[: m.start()].count("<"), line[: m.end()].count("<")) for m in regex.finditer(licenses.pattern(parts), line)]
    assert licenses.Automaton(parts).matches(found) == expected


def test_repeated_beginnings_cost_nothing():
    began = time.process_time()
    a = licenses.Automaton(licenses.parse(licenses.TEMPLATES["MIT"]))
    found = words(filled("MIT")[0])
    cut = found.index("event") + 2
    assert a.matches(found[:cut] * 1500) == [] and len(a.matches(found[:cut] * 1500 + found)) == 1
    assert time.process_time() - began < 20


def test_ranges_equal_expressions_on_the_text(spark):
    """Character ranges of all matches in a table, by a search on the text itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.doc_id, r.license_id): [tuple(m) for m in r.matches] for r in licenses.scan(docs, licenses.NOTICES).collect()}
    expressions = {k: regex.compile(r"(?<![\p{L}\p{N}])" + licenses.source(licenses.parse(t)), regex.IGNORECASE) for k, t in licenses.NOTICES.items()}
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        for k, e in expressions.items():
            if hits := [m for m in e.finditer(r.text or "")]:
                expected[r.doc_id, k] = [(m.start(), m.start() + len(regex.sub(r"[^\p{L}\p{N}]+\Z", "", m[0]))) for m in hits]
    assert found == expected and len(found) > 10


def test_templates_of_a_folder(tmp_path):
    (tmp_path / "own.txt").write_text("these are <<var;name='x';match='.+'>> terms")
    assert licenses.load_templates(tmp_path) == {"own": "these are <<var;name='x';match='.+'>> terms"}


def test_ranges_and_defined_results(spark, odd_docs, no_docs):
    line = "Released under the MIT licence."
    df = spark.createDataFrame([(1, f"{line} And so on. {line}", 1, "q"), (1, f"{line} And so on. {line}", 1, "q"), (2, None, 1, "q"), (3, "", 1, "q")], "doc_id bigint, text string, id int, license_id string")
    rows = licenses.scan(df).collect()
    assert [(r.doc_id, r.license_id, r.n_matches, r.first_token) for r in rows] == [(1, "MIT-notice", 2, 0)] * 2
    assert [(f"{line} And so on. {line}")[m.char_from : m.char_to] for m in rows[0].matches] == [line[:-1]] * 2
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    long = "word " * 100_000 + line
    assert licenses.scan(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first().first_token == 100_000
