"""Near-duplicate documents by SimHash and Golay-code fuzzy hashing.

A document's fingerprint has 8 segments of 23 bits, each bit the majority over
its distinct words. Its sketch has the smallest hash of the text's word triples in each of
16 slots, a byte each. Two documents are near copies if at most SURE of the 184 bits differ, or at most
MAX_DISTANCE and enough slots agree: long texts of one language have many words in common without
being copies, but not their order. Keys find every such pair:

At most SURE bits apart, one of the 4 pairs of segments has at most one error. The binary Golay code is perfect: every
23-bit word is within 3 bits of one codeword, and words at most 2 bits apart share a codeword within 4
bits of both. So a segment as it is makes keys with the indices, 12 bits each, of all codewords within 4 bits of its partner,
one to six of them.

Beyond, at least 5 of the 16 slots agree, 3 of them in one half, so three slots of a half make a key: 112
of 24 bits. Documents of few slots may agree in fewer, and make further keys: of the triples that are in any 4 slots, of all
triples, of pairs or of single slots. Few texts share three slots by chance, whatever their language: one pair in 150,000.

Documents with equal fingerprints are one before keys are made. Within a key the
verified pairs of a large group are replaced by a forest that connects the same
documents, found by search from one member after another. Where that takes more than BUDGET comparisons a member,
members being unlike, finer keys part the rest, again and again: alike documents agree either in at least 5 of the sketch's 16 slots
(fewer where fewer are filled) or, at most SURE bits apart, in all but SURE of 16 pieces of 11 or 12 bits, hence
in a pair of some of few groups. Slots and pieces that most of a key's members share make no keys. So no pair is lost and unlike members aren't all compared.
Rows come sorted by key, and a key of more than HOT rows isn't held: its rows go
by their finer keys to other tasks. Groups are the connected components.

Rows travel by a segment or by a key's first slot, once for all keys it is the first of; the
keys are made where they arrive. Where the table is large they travel by the first two slots.

Defined results: null ids and null or empty texts are no duplicates of anything;
a text without letters and digits is a duplicate of equal texts alone. Words are runs of letters or of digits. Rows that share an id are
one document and stay or go together. Ids may be of any type that can be ordered; the smallest id of a group stays. Extra columns are ignored.
Very long texts count whole."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomvec.llm.textarrays import Words, lean, mixed, text_slices
from loomvec.session import stored

SEGMENT, SEGMENTS, PAIRS, BITS = 23, 8, 4, 184
#: Bits in which the fingerprints of near copies differ at most, of 184.
MAX_DISTANCE = 36
#: Bits up to which that alone decides, and the share of slots that must agree beyond.
SURE, AGREE = 7, 0.3
RADIUS = 4
GENERATOR = 0xC75
#: Members of a key beyond which a forest takes the place of all pairs, and pairs verified at once; neither changes the groups.
FOREST, BLOCK = 48, 1 << 21
#: Comparisons a member before finer keys are used; rows of a routing key that are held, rows worked on
#: at once, rows of a routing key and of a task aimed at. None changes a group.
BUDGET, HOT, AT_ONCE, ROWS_PER_KEY, ROWS_PER_TASK = 16, 1_000_000, 200_000, 20_000, 2_000_000
#: How often keys are refined before all members are compared.
DEPTH = 3
PRINT = [f"p{i}" for i in range(PAIRS)]
SKETCH = ["s0", "s1"]
SLOTS = 16
#: By slots that agree: how many are filled at most in near copies in which no more agree.
FILLED = [max(f for f in range(SLOTS + 1) if AGREE * f <= a) for a in range(6)]


# The code


def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and the lower 11 bits; by syndrome the error patterns
    of at most RADIUS bits, and how many."""
    high = np.array([_syndrome(x << 11) for x in range(1 << 12)], dtype=np.int64)
    low = np.arange(1 << 11, dtype=np.int64)
    single = [_syndrome(1 << i) for i in range(SEGMENT)]
    by_syndrome: list[list[int]] = [[] for _ in range(1 << 11)]

    def extend(start: int, pattern: int, syndrome: int, left: int) -> None:
        by_syndrome[syndrome].append(pattern)
        if left:
            for i in range(start, SEGMENT):
                extend(i + 1, pattern | 1 << i, syndrome ^ single[i], left - 1)

    extend(0, 0, 0, RADIUS)
    n = np.array(list(map(len, by_syndrome)), dtype=np.int64)
    patterns = np.zeros((1 << 11, int(n.max())), dtype=np.int64)
    for i, x in enumerate(by_syndrome):
        patterns[i, : len(x)] = x
    return high, low, patterns, n


def nearby(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of all codewords within RADIUS of each segment: which segment, and the index."""
    high, low, patterns, n = golay()
    syndrome = high[segments >> 11] ^ low[segments & 0x7FF]
    count = n[syndrome]
    of = np.repeat(np.arange(len(segments)), count)
    slot = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, (segments[of] ^ patterns[syndrome[of], slot]) >> 11


# Fingerprints


def sketches(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Texts by 2: a byte for each slot, 0 where no triple falls into it. h and of: the words'
    hashes and texts. A text of one or two words counts by words."""
    triple = np.flatnonzero(of[2:] == of[:-2])
    few = np.flatnonzero(np.bincount(of, minlength=n)[of] < 3)
    s = mixed(np.concatenate([h[triple] * np.uint64(0x9E3779B97F4A7C15) + h[triple + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[triple + 2] * np.uint64(0x165667B19E3779F9), h[few]]))
    least = np.full(n * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, np.concatenate([of[triple], of[few]]) * SLOTS + (s >> np.uint64(60)).astype(np.int64), s & np.uint64((1 << 60) - 1))
    slots = np.where(least == np.iinfo(np.uint64).max, 0, 1 + mixed(least) % np.uint64(255)).astype(np.uint8)
    return slots.reshape(n, SLOTS).view(np.int64)


def fingerprint_slice(texts: list[str | None]) -> np.ndarray:
    """Texts by PAIRS, 46 bits each, and their sketches in two further columns."""
    found = Words(texts, "LMN")
    words = found.hashes()
    of = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(found.text_words))
    sketch = sketches(words, of.astype(np.int64), len(texts))
    distinct = np.unique((of << np.uint64(40)) | (words >> np.uint64(24)))
    bare = np.flatnonzero(np.diff(found.text_words) == 0)
    if len(bare):
        own = np.array([xxhash.xxh64_intdigest((texts[i] or "").encode("utf-8", "surrogatepass")) >> 24 for i in bare], dtype=np.uint64)
        distinct = np.sort(np.concatenate([distinct, (bare.astype(np.uint64) << np.uint64(40)) | own]))
    of = (distinct >> np.uint64(40)).astype(np.int64)
    h = distinct & np.uint64((1 << 40) - 1)
    first = np.searchsorted(of, np.arange(len(texts)))
    n = np.diff(first, append=len(of))
    out = np.zeros((len(texts), PAIRS), dtype=np.int64)
    weights = np.int64(1) << np.arange(46, dtype=np.int64)
    for pair in range(PAIRS):
        bits = np.unpackbits(mixed(h ^ np.uint64((0x9E3779B97F4A7C15 * (pair + 1)) & (1 << 64) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6], axis=1)[:, :46]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[:, pair] = (2 * ones > n[:, None]) @ weights
    return np.concatenate([out, sketch], axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the four 46-bit parts p0 to p3 and the sketch."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                prints = fingerprint_slice(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, prints.T)], names=["id", *PRINT, *SKETCH])

    return chosen.mapInArrow(lean(run), f"id {dict(chosen.dtypes)['id']}, " + ", ".join(f"{p} bigint" for p in [*PRINT, *SKETCH]))


# Search


def alike(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of a are near copies of those of b, or of b itself where it is one row."""
    d = np.bitwise_count(a[:, :PAIRS] ^ b[..., :PAIRS]).sum(-1, dtype=np.int64)
    near = d <= most
    at = np.flatnonzero(near & (d > SURE))
    if len(at):
        x = np.ascontiguousarray(a[at, PAIRS:]).view(np.uint8)
        y = np.ascontiguousarray(b[at, PAIRS:] if b.ndim > 1 else b[None, PAIRS:]).view(np.uint8)
        near[at] = ((x == y) & (x > 0)).sum(1) >= AGREE * ((x | y) > 0).sum(1)
    return near


def group_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within groups of consecutive places, in blocks."""
    n = sizes * (sizes - 1) // 2
    cut = np.searchsorted(np.cumsum(n), np.arange(BLOCK, int(n.sum()) + BLOCK, BLOCK))
    for a, b in zip([0, *(cut + 1)], cut + 1):
        s, m, k = starts[a:b], sizes[a:b], n[a:b]
        if not len(s):
            continue
        rank = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        high = ((1 + np.sqrt(1 + 8 * rank.astype(np.float64))) / 2).astype(np.int64)
        high -= high * (high - 1) // 2 > rank
        high += high * (high + 1) // 2 <= rank
        base = np.repeat(s, k)
        yield base + rank - high * (high - 1) // 2, base + high


def forest(prints: np.ndarray, most: int, budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a chain of near copies connects: each
    member reached is compared with those not yet reached. And, once so many
    comparisons are made, the members that are still to be compared with each other."""
    left = np.arange(len(prints))
    edges = [np.zeros((0, 2), dtype=np.int64)]
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        if budget is not None:
            budget -= len(left)
            if budget < 0:
                return np.concatenate(edges), np.sort(np.concatenate([np.array(queue, dtype=np.int64), left]))
        at = queue.pop()
        near = alike(prints[left], prints[at], most)
        reached = left[near]
        edges.append(np.stack([np.full(len(reached), at), reached], 1))
        queue += reached.tolist()
        left = left[~near]
    return np.concatenate(edges), np.zeros(0, dtype=np.int64)


def slots_of(prints: np.ndarray) -> np.ndarray:
    """The sketches' bytes: rows by 16."""
    return np.ascontiguousarray(prints[:, PAIRS:]).view(np.uint8).reshape(len(prints), SLOTS)


def pieces(prints: np.ndarray) -> np.ndarray:
    """The halves of all segments, 11 and 12 bits, and the slots of the sketch: rows by 16, each."""
    halves = [prints[:, part] >> a & ((1 << (b - a)) - 1) for part in range(PAIRS) for a, b in ((23, 34), (34, 46), (0, 11), (11, 23))]
    return np.concatenate([np.stack(halves, 1), slots_of(prints)], 1)


def constant(parts: np.ndarray) -> tuple[set[int], set[int]]:
    """The pieces and slots in which more than half of the rows agree: they part little."""
    found = {i for i in range(parts.shape[1]) if 2 * np.bincount(parts[:, i]).max() > len(parts)}
    return {i for i in found if i < 16}, {i - 16 for i in found if i >= 16}


def finer_keys(parts: np.ndarray, dead: tuple[set[int], set[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Places of rows and their keys, kind by kind: alike rows share a key of some kind. Keys of different
    kinds differ. Pieces and slots that are dead make no keys; None where the rest can't tell.

    Of n live pieces alike rows have `least` in common; among least - 1 groups of them, two of some group."""
    slots = parts[:, 16:]
    filled = (slots > 0).sum(1)
    live = [[i for i in range(16) if i not in d] for d in dead]
    least = len(live[0]) - SURE, 5 - len(dead[1])
    if min(least) < 1:
        return None

    def kinds(own: list[int], least: int) -> list[tuple[int, ...]]:
        groups = [own[g :: least - 1] for g in range(least - 1)]
        return [(i, j) for g in groups for x, i in enumerate(g) for j in g[x + 1 :]] or [(i,) for i in own]

    def run() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every, kind = np.arange(len(parts)), 0
        for columns in kinds(live[0], least[0]):
            yield every, sum((parts[:, i] << 12 * x for x, i in enumerate(columns)), np.int64(0)) | kind << 32
            kind += 1
        few = filled * AGREE <= 4  # only with such can a pair agree in less than 5 slots
        for columns, own in [*((c, None) for c in kinds(live[1], least[1])), *(((i,), few) for i in range(SLOTS))]:
            here = (slots[:, columns] > 0).all(1) if own is None else own & (slots[:, columns[0]] > 0)
            at = np.flatnonzero(here)
            yield at, sum((slots[at, i] << 8 * x for x, i in enumerate(columns)), np.int64(0)) | kind << 32
            kind += 1
        at = np.flatnonzero(filled == 0)
        yield at, np.full(len(at), kind << 32, dtype=np.int64)

    return run()


def labels(n: int, edges: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    label = np.arange(n)
    while len(edges):
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        new = label.copy()
        np.minimum.at(new, edges[:, 0], low)
        np.minimum.at(new, edges[:, 1], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def linked(prints: np.ndarray, most: int, depth: int = 0) -> np.ndarray:
    """Edges that connect what chains of near copies connect, without comparing all members where they are unlike."""
    edges, rest = forest(prints, most, BUDGET * len(prints) if depth < DEPTH else None)
    if not len(rest):
        return edges
    parts = pieces(prints[rest])
    keyed = finer_keys(parts, constant(parts))
    if keyed is None:
        return np.concatenate([edges, rest[forest(prints[rest], most)[0]]])
    return connected(prints, ((rest[own], keys) for own, keys in keyed), most, edges, depth)


def connected(prints: np.ndarray, keyed: Iterable[tuple[np.ndarray, np.ndarray]], most: int, edges: np.ndarray = np.zeros((0, 2), np.int64), depth: int = -1) -> np.ndarray:
    """The edges and more, till they connect what shares a key and is alike. keyed: places of rows and their keys, kind by
    kind; what one kind connects the next don't compare."""
    label = labels(len(prints), edges)
    for own, keys in keyed:
        by = np.argsort(keys, kind="stable")
        order, keys = own[by], keys[by]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(start, append=len(keys))
        fresh = [np.zeros((0, 2), dtype=np.int64)]
        few = (size > 1) & (size <= FOREST)
        for a, b in group_pairs(start[few], size[few]):
            x, y = order[a], order[b]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            near = alike(prints[x], prints[y], most)
            fresh.append(np.stack([x[near], y[near]], 1))
        for s, m in zip(start[size > FOREST], size[size > FOREST]):
            members = order[s : s + m]
            if (label[members] != label[members[0]]).any():
                fresh.append(members[linked(prints[members], most, depth + 1)])
        new = np.concatenate(fresh)
        if len(new):
            edges = np.concatenate([edges, new])
            label = labels(len(prints), np.concatenate([np.stack([label, np.arange(len(label))], 1), new]))
    return edges


def local_forest(pairs: np.ndarray) -> np.ndarray:
    """As many edges as connect the same ids, each to the smallest of its set."""
    if not len(pairs):
        return pairs
    nodes, at = np.unique(pairs, return_inverse=True)
    label = labels(len(nodes), at.reshape(-1, 2))
    other = label != np.arange(len(nodes))
    return np.stack([nodes[label[other]], nodes[other]], 1)


def segment(parts: list[np.ndarray] | np.ndarray, i: int) -> np.ndarray:
    """The i-th segment, two of which are in each of the parts."""
    return parts[i >> 1] & ((1 << SEGMENT) - 1) if i & 1 else parts[i >> 1] >> SEGMENT


def fewest(kind: tuple[int, ...]) -> int:
    """In how many slots near copies agree at least that need keys of these slots. Any 5 of 16 have three in one half; any
    4 in three sets have three in one, or two in one and one in the next."""
    if len(kind) < 3:
        return len(kind)
    if len({2 * i // SLOTS for i in kind}) == 1:
        return 5
    sets = [3 * i // SLOTS for i in kind]
    return 4 if len(set(sets)) == 1 or any(sets.count(g) == 2 and (g + 1) % 3 in sets for g in sets) else 3


def kinds(shared: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The slots of keys that begin with the shared ones, at most three."""
    return [(*shared, *rest) for n in range(4 - len(shared)) for rest in combinations(range(shared[-1] + 1, SLOTS), n)]


def slot_keys(prints: np.ndarray, shared: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows and their keys, kind by kind, of the kinds that begin with the shared slots."""
    slots = slots_of(prints)
    filled = (slots > 0).sum(1)
    within = [np.flatnonzero(filled <= most) for most in FILLED]
    columns = slots.T.astype(np.int64)
    for kind in kinds(shared):
        own = within[fewest(kind)]
        for i in kind:
            own = own[columns[i, own] > 0]
        if len(own) > 1:
            yield own, sum((columns[i, own] << 8 * x for x, i in enumerate(kind)), np.int64(0))


def segment_keys(prints: np.ndarray, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows and their keys: the i-th segment with each codeword near the other segment of its part."""
    own, index = nearby(segment(prints.T, i ^ 1))
    yield own, segment(prints.T, i)[own] << 12 | index


def by_key(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[tuple[bool, pa.Table]]:
    """Rows sorted by their first column, in tables of whole keys of about AT_ONCE rows; keys
    of more than `hot` rows in pieces, with True."""
    held: list[pa.RecordBatch] = []
    size, flowing = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if flowing is not None:
            n = int(np.searchsorted(keys, flowing, side="right"))
            if n:
                yield True, pa.Table.from_batches([batch.slice(0, n)])
            if n == len(keys):
                continue
            batch, keys, flowing = batch.slice(n), keys[n:], None
        held.append(batch)
        size += len(keys)
        if size < AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if cut:
            yield False, table.slice(0, cut)
        held, size = table.slice(cut).combine_chunks().to_batches(), len(keys) - cut
        if hot is not None and size > hot:
            flowing = keys[-1]
            yield True, pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield False, pa.Table.from_batches(held)


def near_pairs(prints: DataFrame, most: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """a, b: edges between ids of different fingerprints, enough to connect each group."""
    spark = prints.sparkSession
    rows = prints.count()
    carried = [*PRINT, *SKETCH]
    # what rows travel by: slots, with the most that are filled in rows for which these begin a key; or a segment
    if rows > 256 * ROWS_PER_KEY:
        slot_legs = [((i,), FILLED[1]) for i in range(SLOTS)] + [(x, max(FILLED[fewest(k)] for k in kinds(x))) for x in combinations(range(SLOTS), 2)]
    else:
        slot_legs = [((i,), max(FILLED[fewest(k)] for k in kinds((i,)))) for i in range(SLOTS)]
    legs = [*slot_legs, *range(SEGMENTS)]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * len(legs) / ROWS_PER_TASK))
    fields = ", ".join(f"{p} bigint" for p in carried)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            slots = slots_of(np.stack(columns[1:], 1))
            filled = (slots > 0).sum(1)
            for leg, by in enumerate(legs):
                if isinstance(by, int):
                    own, value = np.arange(batch.num_rows), segment(columns[1:], by)
                else:
                    own = np.flatnonzero((slots[:, by[0]] > 0).all(1) & (filled <= by[1]))
                    value = sum((slots[own, i].astype(np.int64) << 8 * x for x, i in enumerate(by[0])), np.int64(0))
                yield pa.RecordBatch.from_arrays([pa.array((value << 8 | leg).astype(np.int32)), *(pa.array(c[own]) for c in columns)], names=["route", "id", *carried])

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return table.column(0).to_numpy().astype(np.int64), table["id"].to_numpy(), np.stack([table[p].to_numpy() for p in carried], 1)

    def emitted(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = local_forest(np.concatenate(found)) if found else []
        if len(edges):
            none = pa.nulls(len(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(edges[:, 0]), pa.array(edges[:, 1]), *[none] * len(carried)], names=["finer", "id", "other", *carried])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flows, table in by_key(batches, hot):
            routes, ids, prints = arrays(table)
            if flows:
                by = legs[int(routes[0]) & 255]
                for own, keys in finer_keys(pieces(prints), ({2 * by, 2 * by + 1}, set()) if isinstance(by, int) else (set(), set(by[0]))):
                    finer = mixed((mixed(keys.astype(np.uint64)) ^ routes[own].astype(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(ids[own]), pa.nulls(len(own), pa.int64()), *(pa.array(prints[own, c]) for c in range(len(carried)))], names=["finer", "id", "other", *carried])
                continue
            found = []
            same = np.concatenate([[False], routes[1:] == routes[:-1], [False]])
            met = np.flatnonzero(same[1:] | same[:-1])
            for leg in np.unique(routes[met] & 255):
                own, by = met[routes[met] & 255 == leg], legs[leg]
                keyed = segment_keys(prints[own], by) if isinstance(by, int) else slot_keys(prints[own], by[0])
                found.append(ids[own[connected(prints[own], keyed, most)]])
            yield from emitted(found)

    def meet_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(batches, None):
            keys, ids, prints = arrays(table)
            yield from emitted([ids[connected(prints, [(np.arange(len(ids)), keys)], most)]])

    out = f"finer bigint, id bigint, other bigint, {fields}"
    routed = prints.select("id", *carried).mapInArrow(route, f"route int, id bigint, {fields}").repartition(tasks, "route").sortWithinPartitions("route")
    found = stored(routed.mapInArrow(meet, out), "near")
    edges = found.where("finer is null")
    if not found.where("finer is not null").isEmpty():
        finer = found.where("finer is not null").select("finer", "id", *carried)
        edges = edges.unionAll(stored(finer.repartition(max(tasks, finer.count() // ROWS_PER_TASK), "finer").sortWithinPartitions("finer").mapInArrow(meet_finer, out), "near"))
    return edges.select(F.col("id").alias("a"), F.col("other").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """id, root: every id of an edge with the smallest id that edges lead to. Large-star
    and small-star steps alternate till nothing changes, each stored."""
    state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = mark
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        both = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        state = stored(both.where("a <> b").distinct(), "edges")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DISTANCE) -> DataFrame:
    """id_col, duplicate_of: the documents that go, each with the one of its group that stays."""
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    first = prints.groupBy(*PRINT).agg(F.min(F.struct("id", *SKETCH)).alias("first")).select(*PRINT, "first.*")
    numbered = isinstance(docs.schema[id_col].dataType, IntegralType)
    # numbers in the order of ids, so that the smallest number of a group is that of the smallest id
    distinct = stored(first.withColumn("uid", F.col("id").cast("bigint")) if numbered else first.orderBy("id").withColumn("uid", F.monotonically_increasing_id()), "distinct")
    roots = components(near_pairs(distinct.select(F.col("uid").alias("id"), *PRINT, *SKETCH), most)).select(F.col("id").alias("uid"), F.col("root").alias("root_uid"))
    named = distinct.join(roots, "uid", "left").withColumn("root_uid", F.coalesce("root_uid", "uid"))
    if numbered:
        named = named.select(*PRINT, F.col("root_uid").cast(docs.schema[id_col].dataType).alias("root"))
    else:
        named = named.select(*PRINT, "root_uid").join(distinct.select(F.col("uid").alias("root_uid"), F.col("id").alias("root")), "root_uid").select(*PRINT, "root")
    all_rows = prints.select("id", *PRINT).join(named, PRINT).where("id <> root")
    return all_rows.select(F.col("id").alias(id_col), F.col("root").alias("duplicate_of")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DISTANCE) -> DataFrame:
    """The rows, unchanged, without the documents that go."""
    gone = duplicates(docs, id_col, text_col, most).select(F.col(id_col).alias("gone"))
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
