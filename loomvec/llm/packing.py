"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the counts of lengths matter for a packing, so the instance is a histogram:
at most `capacity` lengths with their numbers, however many documents. On it,
Martello and Toth's dominance reduction fixes bins whose content provably
dominates what any packing could put with their largest document, and takes
those documents out; best fit, longest first, packs the rest. Both work on runs
of equal bins, so their cost depends on the capacity, not on the documents. The
plan is a table of runs (length, ranks, bins), and each document finds its bin by
its rank among those of its length.

The dominance used, for any remaining length w with room r = capacity - w:
  * no remaining document fits beside it: it is alone;
  * one of length exactly r is left: the two fill the bin;
  * let x be the longest that fits. If not even the two shortest others fit
    together in r, no bin holds w with more than one other, and x dominates every other
    choice;
  * if only pairs of others can fit beside it, no three, and x is at least as long
    as any such pair's sum, x dominates the pairs too;
  * if only pairs can fit, let y be the longest that fits beside w and x. Where no two others that are both
    longer than y fit beside w, every pair is dominated by x and y, and the three lie together.
Each keeps some optimal packing reachable, so the reduction never costs a bin.

Documents longer than the capacity are cut into full sequences, which are bins of
their own, and a rest. Lengths are counts of white-space tokens by default; any column of counts may be
given, as the pipeline gives those of byte-level BPE.

Defined results: null and empty texts, and those of no tokens, take no bin and
have no row, nor do lengths that are null or negative; a null id is an id like another; rows that repeat are placed each;
equal lengths are placed by id. Extra columns are ignored; an empty table gives no
rows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.session import stored

CAPACITY = 2048
#: Parts into which the documents of one length are dealt for ranking; it decides among equal lengths only.
SPREAD = 64


@dataclass(frozen=True)
class Run:
    """per_bin documents of one length in each of `bins` bins: of the length's documents
    those from rank `first`, in bins from `bin`, at `offset` in the bin."""

    length: int
    first: int
    per_bin: int
    bin: int
    bins: int
    offset: int
    fixed: bool


class Lengths:
    """The remaining lengths in order with their numbers."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)
        self.taken = dict.fromkeys(self.n, 0)

    def take(self, w: int, n: int) -> int:
        """Removes n documents of length w; the rank of the first."""
        first = self.taken[w]
        self.taken[w] += n
        self.n[w] -= n
        if not self.n[w]:
            del self.n[w]
            self.order.remove(w)
        return first

    def shortest(self, k: int, less: int | None = None) -> list[int]:
        """The k shortest, without one document of length `less`."""
        out: list[int] = []
        for w in self.order:
            out += [w] * min(k - len(out), self.n[w] - (w == less))
            if len(out) >= k:
                break
        return out

    def longest_beside(self, room: int, used: Counter) -> int | None:
        """The longest that fits when so many of each length are used."""
        for i in range(bisect_left(self.order, room + 1) - 1, -1, -1):
            if self.n[self.order[i]] > used[self.order[i]]:
                return self.order[i]
        return None

    def two_above(self, y: int, used: Counter) -> int | None:
        """The least sum of two documents longer than y when so many of each length are used."""
        out: list[int] = []
        for w in self.order[bisect_left(self.order, y + 1) :]:
            out += [w] * min(2 - len(out), self.n[w] - used[w])
            if len(out) == 2:
                return sum(out)
        return None

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two documents that fits, besides one of length `without`; 0 if none does."""
        best, i, j = 0, 0, bisect_left(self.order, room + 1) - 1
        n = lambda w: self.n[w] - (w == without)
        while 0 <= i <= j:
            a, b = self.order[i], self.order[j]
            if n(a) < 1 or (a == b and n(a) < 2):
                i += 1
                continue
            if n(b) < 1 or a + b > room:
                j -= 1
                continue
            best = max(best, a + b)
            i += 1
        return best


def dominant(lengths: Lengths, w: int, room: int) -> tuple[tuple[int, ...], int] | None:
    """The others that dominate all that could lie beside one of length w, longest first,
    and in how many bins alike; None where no dominance holds."""
    x = lengths.longest_beside(room, Counter((w,)))
    others: tuple[int, ...] = () if x is None else (x,)
    if x is not None and x < room:
        two = lengths.shortest(2, w)
        if len(two) == 2 and sum(two) <= room:
            three = lengths.shortest(3, w)
            if len(three) == 3 and sum(three) <= room:
                return None
            if lengths.best_pair(room, w) > x:
                y = lengths.longest_beside(room - x, Counter((w, x)))
                if y is None:
                    return None
                above = lengths.two_above(y, Counter((w, x)))
                if above is not None and above <= room:
                    return None
                others = (x, y)
    return others, min(lengths.n[v] // c for v, c in Counter((w, *others)).items())


def reduce(lengths: Lengths, capacity: int, next_bin: int = 0) -> tuple[list[Run], int]:
    """The bins that dominance fixes, and the next free number. Every length is tried,
    longest first, again and again until a pass fixes nothing; best fit takes over from there."""
    runs: list[Run] = []
    changed = True
    while changed:
        changed = False
        for w in reversed(list(lengths.order)):
            while w in lengths.n and (found := dominant(lengths, w, capacity - w)):
                others, many = found
                offset = 0
                for v, c in Counter((w, *others)).items():
                    runs.append(Run(v, lengths.take(v, c * many), c, next_bin, many, offset, True))
                    offset += c * v
                next_bin += many
                changed = True
    return runs, next_bin


def best_fit(lengths: Lengths, capacity: int, next_bin: int) -> tuple[list[Run], int]:
    """Best fit, longest first, on runs of bins with equal room."""
    runs: list[Run] = []
    rooms: list[tuple[int, int, int]] = []  # room, first bin, bins
    while lengths.order:
        w = lengths.order[-1]
        n = lengths.n[w]
        while n:
            i = bisect_left(rooms, (w, -1, -1))
            if i < len(rooms):
                room, first, bins = rooms.pop(i)
            else:
                room, first, bins = capacity, next_bin, -(-n // (capacity // w))
                next_bin += bins
            most = room // w  # a bin begun stays the fullest that fits until no more fits
            full = min(bins, n // most)
            if full:
                runs.append(Run(w, lengths.take(w, full * most), most, first, full, capacity - room, False))
                n -= full * most
                if room - most * w:
                    insort(rooms, (room - most * w, first, full))
            elif n:
                runs.append(Run(w, lengths.take(w, n), n, first, 1, capacity - room, False))
                insort(rooms, (room - n * w, first, 1))
                full, n = 1, 0
            if bins > full:
                if room < capacity:
                    insort(rooms, (room, first + full, bins - full))
                elif n:
                    runs.append(Run(w, lengths.take(w, n), n, first + full, 1, 0, False))
                    insort(rooms, (room - n * w, first + full, 1))
                    n = 0
    return runs, next_bin


def plan(counts: dict[int, int], capacity: int, reduction: bool = True) -> tuple[list[Run], int]:
    """Runs that place every document, and the number of bins."""
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError("lengths lie between 1 and the capacity")
    lengths = Lengths(counts)
    runs, bins = reduce(lengths, capacity) if reduction else ([], 0)
    more, bins = best_fit(lengths, capacity, bins)
    return runs + more, bins


def token_count(text: Column) -> Column:
    """White-space tokens."""
    return F.regexp_count(text, F.lit(r"\S+"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """id_col, piece, bin_id, bin_offset, n_tokens, fixed: piece counts the parts of one
    document, bin_offset is where its tokens begin in the bin, fixed tells that dominance placed it.

    Bins are numbered from 0: first the planned ones, then full sequences of long
    documents. Only the histogram of lengths goes to the driver, capacity rows at most."""
    spark = docs.sparkSession
    n = token_count(F.col(text_col)) if length is None else length
    sized = docs.select(F.col(id_col).alias("id"), n.cast("bigint").alias("n")).where("n > 0")
    whole, rest = F.expr(f"n div {capacity}"), F.expr(f"n % {capacity}")
    # ranks in two steps, so that a frequent length is no one task's work
    dealt = sized.select("id", "n", whole.alias("whole"), rest.cast("int").alias("rest"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("part"))
    dealt = stored(dealt, "sized")
    counts = dealt.groupBy("rest", "part").agg(F.count("*").alias("c"), F.sum("whole").alias("w"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("rank0", F.coalesce(F.sum("c").over(before), F.lit(0))), "lengths")
    histogram = {r.rest: r.c for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}
    runs, bins = plan(histogram, capacity)
    # full sequences: their bins follow, counted by length and part
    chunk_counts = counts.where("w > 0").withColumn("bin0", F.lit(bins) + F.coalesce(F.sum("w").over(Window.orderBy("rest", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("rest", "part").orderBy("id", "n")
    ranked = dealt.withColumn("r", F.row_number().over(order) - 1).withColumn("chunks", F.coalesce(F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(F.broadcast(counts.join(chunk_counts.select("rest", "part", "bin0"), ["rest", "part"], "left").select("rest", "part", "rank0", "bin0")), ["rest", "part"])
    table = spark.createDataFrame([(r.length, r.first, r.per_bin, r.bin, r.bins, r.offset, r.fixed) for r in runs], "rest int, first bigint, per_bin int, bin bigint, bins bigint, at int, fixed boolean")
    # runs of one length, found by rank: an array per length and a search in it
    by_length = table.groupBy("rest").agg(F.array_sort(F.collect_list(F.struct("first", "per_bin", "bin", "bins", "at", "fixed"))).alias("runs"))
    rank = F.col("rank0") + F.col("r")
    run = F.element_at(F.filter("runs", lambda x: x["first"] <= rank), -1)
    placed = ranked.where("rest > 0").join(F.broadcast(by_length), "rest").withColumn("run", run).withColumn("k", rank - F.col("run.first"))
    within = F.expr("cast(k % run.per_bin as int)")
    rests = placed.select(
        F.col("id").alias(id_col), F.col("whole").cast("int").alias("piece"), (F.col("run.bin") + F.expr("k div run.per_bin")).alias("bin_id"), (F.col("run.at") + within * F.col("rest")).alias("bin_offset"), F.col("rest").alias("n_tokens"), F.col("run.fixed").alias("fixed")
    )
    full = ranked.where("whole > 0").select("id", "bin0", "chunks", F.explode(F.expr("sequence(0, cast(whole as int) - 1)")).alias("piece"))
    full = full.select(F.col("id").alias(id_col), "piece", (F.col("bin0") + F.col("chunks") + F.col("piece")).alias("bin_id"), F.lit(0).alias("bin_offset"), F.lit(capacity).alias("n_tokens"), F.lit(True).alias("fixed"))
    return rests.unionByName(full)
