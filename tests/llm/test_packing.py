"""Packing: the reduction beside an exhaustive optimum, plans and placed documents checked whole."""

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import packing


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(6, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_reduction_keeps_an_optimum(case):
    capacity, items = case
    left = packing.Lengths(Counter(items))
    _, fixed = packing.reduce(left, capacity)
    assert fixed + fewest([w for w, n in left.n.items() for _ in range(n)], capacity) == fewest(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(6, 200).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 50), max_size=20))))
def test_plan_places_all(case):
    capacity, counts = case
    runs, bins = packing.plan(counts, capacity)
    ranges, used, ranks = defaultdict(list), Counter(), defaultdict(list)
    for r in runs:
        used[r.length] += r.per_bin * r.bins
        ranks[r.length] += range(r.first, r.first + r.per_bin * r.bins)
        for b in range(r.bins):
            ranges[r.bin + b].append((r.offset, r.offset + r.per_bin * r.length))
    assert used == Counter(counts) and sorted(ranges) == list(range(bins))
    assert all(sorted(x) == list(range(counts[w])) for w, x in ranks.items())
    for spans in ranges.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def check(docs, rows, capacity):
    tokens = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
        bins[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens))
    expected = Counter()
    for r in docs.collect():
        expected[r.doc_id] += len((r.text or "").split())
    assert dict(tokens) == {k: v for k, v in expected.items() if v}
    assert sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return len(bins), sum(tokens.values())


def test_the_three_of_a_bin_are_fixed():
    """Only pairs fit beside the longest, and the best of them has the longest partner."""
    for items, capacity, bins in (([5, 3, 2], 10, 1), ([4, 4, 4] * 5, 12, 5), ([6, 3, 3] * 4, 12, 4), ([9, 6, 5, 5, 9, 6, 5, 5], 20, 3)):
        left = packing.Lengths(Counter(items))
        runs, fixed = packing.reduce(left, capacity)
        assert fixed + fewest([w for w, n in left.n.items() for _ in range(n)], capacity) == fewest(items, capacity) == bins
    assert [packing.reduce(packing.Lengths(Counter(x)), 10)[1] for x in ([5, 3, 2], [5, 5, 5])] == [1, 2]


def test_given_lengths(spark):
    """A column of counts takes the place of words; null, zero and negative ones take no bin."""
    df = spark.createDataFrame([(1, 5), (2, None), (3, -4), (4, 0), (5, 23), (6, 3), (6, 3)], "doc_id bigint, size bigint")
    rows = packing.pack(df, capacity=10, length=df["size"]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(1, 5), (5, 3), (5, 10), (5, 10), (6, 3), (6, 3)]


def test_documents(small):
    docs = small("documents")
    bins, tokens = check(docs, packing.pack(docs).collect(), packing.CAPACITY)
    assert bins <= -(-tokens // packing.CAPACITY) * 1.05 + 1


def test_defined_results(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64).collect()
    check(odd_docs, rows, 64)
    assert {r.doc_id for r in rows} == {1, 2, None, 5, 6, 7}
    assert max(r.piece for r in rows if r.doc_id == 5) == 65000 // 64
    assert packing.pack(no_docs).count() == 0
