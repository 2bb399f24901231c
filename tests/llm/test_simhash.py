"""SimHash keys, groups and verification beside brute force over all pairs."""

import time
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import simhash
from loomvec.session import stored


def codewords():
    """The 4,096 words of the code: data in the upper 12 bits, remainder below."""
    return np.array([x << 11 | simhash._syndrome(x << 11) for x in range(1 << 12)])


def test_code_is_perfect():
    words = codewords()
    nearest = [int(np.bitwise_count(words[0] ^ w)) for w in words[1:]]
    assert min(nearest) == 7
    some = np.random.default_rng(1).integers(0, 1 << 23, 500)
    of, index = simhash.nearby(some)
    for i, s in enumerate(some):
        near = np.bitwise_count(words ^ s)
        assert near.min() <= 3
        assert sorted(index[of == i]) == np.flatnonzero(near <= simhash.RADIUS).tolist()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 23) - 1), st.integers(0, 22), st.integers(0, 22))
def test_two_errors_share_a_codeword(word, i, j):
    other = word ^ (1 << i) ^ ((1 << j) if i != j else 0)
    of, index = simhash.nearby(np.array([word, other]))
    assert set(index[of == 0]) & set(index[of == 1])


def brute_pairs(prints, most):
    ids, p = [r[0] for r in prints], np.array([r[1:] for r in prints], dtype=np.int64)
    return ids, [(ids[x], ids[y + x + 1]) for x in range(len(ids)) for y in np.flatnonzero(simhash.alike(p[x + 1 :], p[x], most))]


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root) if find(x) != x}


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [tuple(r) for r in simhash.fingerprints(docs).collect()]
    _, pairs = brute_pairs(prints, simhash.MAX_DISTANCE)
    expected = groups(pairs)
    found = {r.doc_id: r.duplicate_of for r in simhash.duplicates(docs).collect()}
    assert len(expected) > 50
    assert set(found.items()) <= set(expected.items()) or all(x in expected for x in found)
    assert len(set(found) & set(expected)) >= 0.95 * len(expected)


def test_recall_by_distance_of_groups_of_two(spark, monkeypatch):
    """Nine in ten at each distance, all of them up to 20 bits; also where rows travel for each pair of segments."""
    rng = np.random.default_rng(11)
    distances, n, rows = (11, 20, 24, 28, 32, simhash.MAX_DISTANCE), 2000, []
    for g in range(n * len(distances)):
        bits = rng.integers(0, 2, simhash.BITS)
        other = bits.copy()
        other[rng.choice(simhash.BITS, distances[g // n], replace=False)] ^= 1
        sketch = rng.integers(1, 1 << 62, 2).tolist()
        rows += [(2 * g + i, *(int("".join(map(str, part)), 2) for part in b.reshape(simhash.PAIRS, -1)), *sketch) for i, b in enumerate((bits, other))]
    schema = "id bigint, " + ", ".join(f"{c} bigint" for c in [*simhash.PRINT, *simhash.SKETCH])
    prints = spark.createDataFrame(rows, schema)
    found = {(r.a, r.b) for r in simhash.near_pairs(prints).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)
    recall = [sum((2 * g, 2 * g + 1) in found for g in range(k * n, (k + 1) * n)) / n for k in range(len(distances))]
    assert recall[:2] == [1, 1] and min(recall) >= 0.9, recall
    monkeypatch.setattr(simhash, "ROWS_PER_KEY", 5)
    assert {(r.a, r.b) for r in simhash.near_pairs(prints).collect()} == found


def frame(spark, prints):
    """Fingerprints with sketches, numbered from 0."""
    rows = [(i, *p) for i, p in enumerate(prints.tolist())]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} bigint" for c in [*simhash.PRINT, *simhash.SKETCH]))


def test_any_four_slots_have_a_key():
    """So many slots in common as near copies have at least hold a key, whichever they are."""
    every = [k for i in range(simhash.SLOTS) for k in simhash.kinds((i,))]
    assert simhash.FILLED == [0, 3, 6, 10, 13, 16]
    for agree in range(1, 6):
        useful = [set(k) for k in every if simhash.fewest(k) >= agree]
        for common in combinations(range(simhash.SLOTS), agree):
            assert any(k <= set(common) for k in useful)
    assert sum(simhash.fewest(k) == 5 for k in every) == 112


def test_every_alike_pair_is_found(spark, monkeypatch):
    """At MAX_DISTANCE with the fewest slots that may agree, for any number of filled ones; at SURE bits with none."""
    rng = np.random.default_rng(21)
    prints = []
    for g in range(3400):
        filled = g % 17
        one, other = rng.integers(1, 256, (2, simhash.SLOTS)).astype(np.uint8)
        at = rng.permutation(simhash.SLOTS)
        least = next(a for a in range(simhash.SLOTS) if a >= simhash.AGREE * filled)
        other = np.where(other == one, other % 255 + 1, other).astype(np.uint8)
        other[at[:least]] = one[at[:least]]
        one[at[filled:]] = other[at[filled:]] = 0
        if filled > least > 1:
            other[at[least]] = 0  # filled in one alone
        bits = rng.integers(0, 2, simhash.BITS)
        twin = bits.copy()
        twin[rng.choice(simhash.BITS, simhash.MAX_DISTANCE if filled else simhash.SURE, replace=False)] ^= 1
        for b, s in ((bits, one), (twin, other)):
            prints.append([*(int("".join(map(str, part)), 2) for part in b.reshape(simhash.PAIRS, -1)), *s.view(np.int64).tolist()])
    df = frame(spark, np.array(prints, dtype=np.int64))
    expected = {(2 * g, 2 * g + 1) for g in range(3400)}
    assert {(r.a, r.b) for r in simhash.near_pairs(df).collect()} == expected
    monkeypatch.setattr(simhash, "ROWS_PER_KEY", 5)
    assert {(r.a, r.b) for r in simhash.near_pairs(df).collect()} == expected


def test_work_grows_with_the_table(spark):
    """Texts of one language, whose fingerprints have most bits in common, don't meet by them."""
    rng = np.random.default_rng(22)
    took = []
    for n in (15_000, 60_000):
        bits = rng.random((n, simhash.PAIRS, 46)) < np.where(rng.random((simhash.PAIRS, 46)) < 0.5, 0.2, 0.8)
        prints = np.concatenate([bits @ (1 << np.arange(46)), rng.integers(0, 256, (n, simhash.SLOTS)).astype(np.uint8).view(np.int64)], axis=1)
        df = stored(frame(spark, prints), "prints")
        began = time.time()
        assert simhash.near_pairs(df).count() < n / 1000
        took.append(time.time() - began)
    assert took[1] < 6 * took[0], took


def test_near_copies_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(5000)]
    rows, at = [], 0
    for group in range(40):
        base = [vocabulary[i] for i in rng.integers(0, 5000, 200)]
        for copy in range(2 if group else 300):
            words = list(base)
            for i in rng.choice(200, 6 if copy else 0, replace=False):
                words[i] = vocabulary[rng.integers(0, 5000)]
            rows.append((at, group, " ".join(words)))
            at += 1
    found = {r.doc_id: r.duplicate_of for r in simhash.duplicates(spark.createDataFrame(rows, "doc_id bigint, grp int, text string")).collect()}
    first = {}
    for i, g, _ in rows:
        first.setdefault(g, i)
    expected = {i: first[g] for i, g, _ in rows if i != first[g]}
    assert all(expected.get(i) == j for i, j in found.items())
    assert len(found) >= 0.97 * len(expected)


def test_a_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 46, (3, 4))
    prints = np.array([c ^ (np.int64(1) << rng.integers(0, 46, 4)) for c in centres for _ in range(60)])
    edges, rest = simhash.forest(prints, 8)
    assert not len(rest)
    _, pairs = brute_pairs([(i, *p) for i, p in enumerate(prints.tolist())], 8)
    assert groups(edges) == groups(pairs)


def unlike(rng, n, group=0):
    """Made-up fingerprints with sketches that share one key of two segments; of `group` near copies at the end half are sure, half alike by sketch."""
    prints = np.concatenate([rng.integers(0, 1 << 46, (n, 4)), rng.integers(0, 1 << 62, (n, 2))], axis=1)
    prints[:, 0] = prints[0, 0]
    for i in range(n - group, n):
        other = prints[rng.integers(0, n - group) if i % 3 else n - group]
        own = other.copy()
        for bit in rng.permutation(184)[: simhash.SURE if i % 2 else 30]:
            own[bit // 46] ^= np.int64(1) << (bit % 46)
        slots = own[4:].view(np.uint8)
        change = rng.permutation(16)[: 16 if i % 2 else 11]
        slots[change] = rng.integers(1, 256, len(change))
        prints[i] = own
    return prints


def test_finer_keys_lose_no_alike_pair():
    rng = np.random.default_rng(12)
    prints = unlike(rng, 900, 300)
    prints[rng.permutation(900)[:200], 4] &= 0xFFFF  # texts of few triples
    prints[rng.permutation(900)[:100], 4:] = 0
    prints[rng.permutation(900)[:100], 5] = 0
    _, pairs = brute_pairs([(i, *p) for i, p in enumerate(prints.tolist())], simhash.MAX_DISTANCE)
    shared = [set() for _ in range(900)]
    parts = simhash.pieces(prints)
    assert simhash.constant(parts)[0] == {0, 1, 2, 3}
    for dead in (simhash.constant(parts), (set(), set()), ({2, 3}, {7}), (set(range(8)), {1, 2, 3, 4})):
        for mine in shared:
            mine.clear()
        for own, keys in simhash.finer_keys(parts, dead):
            for i, k in zip(own.tolist(), keys.tolist()):
                shared[i].add(k)
        assert len(pairs) > 150 and all(shared[a] & shared[b] for a, b in pairs)
    assert simhash.finer_keys(parts, (set(range(9)), set())) is None


def test_unlike_members_of_a_hot_key():
    """As many groups as by all pairs, and work in proportion to the members."""
    rng = np.random.default_rng(13)
    prints = unlike(rng, 3000, 600)
    _, pairs = brute_pairs([(i, *p) for i, p in enumerate(prints.tolist())], simhash.MAX_DISTANCE)
    assert groups(map(tuple, simhash.linked(prints, simhash.MAX_DISTANCE).tolist())) == groups(pairs)
    took = []
    for n in (10_000, 40_000):
        prints = unlike(rng, n)
        began = time.process_time()
        assert len(simhash.linked(prints, simhash.MAX_DISTANCE)) < n / 100
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_a_key_too_hot_to_be_held(spark, monkeypatch):
    """Rows of such a key go by finer keys to other tasks; the groups stay."""
    prints = unlike(np.random.default_rng(14), 2500, 500)
    rows = [(i, *p) for i, p in enumerate(prints.tolist())]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} bigint" for c in [*simhash.PRINT, *simhash.SKETCH]))
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    _, pairs = brute_pairs(rows, simhash.MAX_DISTANCE)
    assert groups((r.a, r.b) for r in simhash.near_pairs(df, hot=300).collect()) == groups(pairs)


def test_ids_of_any_type(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("b", text), ("a", text), ("c", text + " 11"), ("d", "something else altogether it is")], "doc_id string, text string")
    assert {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(df).collect()} >= {("b", "a")}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} >= {"a", "d"}


def test_numbers_are_words():
    p = simhash.fingerprint_slice(["order 123 of 456 was sent 789", "order 321 of 654 was sent 987", "1 2 3", "4 5 6"])
    assert (p[0] != p[1]).any() and not np.array_equal(p[2], p[3])
    assert simhash.alike(p[1:2], p[0], simhash.MAX_DISTANCE).tolist() == [False]


def test_shared_words_are_no_copy():
    """The same words in another order are told apart by the sketch; an edited copy isn't."""
    rng = np.random.default_rng(8)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(300)]
    edited = [w if i % 12 else w[::-1] for i, w in enumerate(words)]
    mixed = [words[i] if i % 12 else words[i][::-1] for i in rng.permutation(300)]
    p = simhash.fingerprint_slice([" ".join(x) for x in (words, edited, mixed)])
    d = [int(np.bitwise_count(p[0, :4] ^ p[i, :4]).sum()) for i in (1, 2)]
    assert d[0] == d[1] and simhash.SURE < d[0] <= simhash.MAX_DISTANCE
    assert simhash.alike(p[1:], p[0], simhash.MAX_DISTANCE).tolist() == [True, False]


def test_defined_results(odd_docs, no_docs):
    assert {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(odd_docs).collect()} == {(2, 1)}
    kept = simhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 1, 3, 4, 5, 6, 7)] + [(True, 0)]
    assert simhash.duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
