"""Exact n-gram Jaccard self-join by signature trees.

A document is the set of its distinct word shingles.  Two documents are linked when the
Jaccard similarity of their sets reaches ``percent``; the result names the connected
component of every document.  Links are never listed in full: groups of texts that are
alike give spanning edges, and all links between different components are tested.

1. Documents with equal sets form one class; only classes go on.
2. A class meets others through its prefix: the first ``|s| - ceil(percent * |s|) + 1``
   shingles in one order of all shingles.  Any two linked sets share a prefix shingle,
   whichever the order is.  It puts shingles of rare words first and those that were seen
   in many documents last, so that few texts meet that aren't alike, however many there
   are.  A meeting counts only if the sizes, and the places of the shingle in both sets,
   leave room for the overlap that a link needs; groups with the same members are one.
3. The classes of a group form signature trees: leaves hold a bitmap of the set, inner
   nodes the OR of their children's bitmaps, the range of sizes and the largest slack
   (shingles that share a bit).  A dual traversal drops node pairs whose maximum possible
   overlap is too small.  What survives are families of candidates.
4. Each family's sets build trees again, now with one bit for every shingle that two
   members share, so that the bound at the leaves is the overlap itself.

Groups of more than ``MEMBERS`` classes or ``BYTES`` of signatures are cut into blocks.
Blocks are resolved by themselves first, under two different cuts; then only pairs of
blocks that are not yet one component, and whose sizes are near, are tested, so the work
in a large group of copies grows with its size and not with the square of it.

Defined results: null and empty texts have no shingles and are linked with nothing; a
text with fewer words than a shingle has its whole sequence as one; texts are read whole;
rows that repeat a doc_id are documents of their own; a null doc_id never names a
component unless no member has another; an empty table gives an empty result; further
columns don't enter the result (:func:`one_of_each` passes them through).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from segspark.llm._components import connected_components
from segspark.llm._scratch import LEAST_TASKS, discard, materialize, tasks_for, text_slices
from segspark.llm._words import Words, mix, shingle_sets, window_hashes

SIZE = 4
PERCENT = 85
#: Classes and bytes of signatures in one block of a group.
MEMBERS = 128
BYTES = 12 << 20
#: A shingle counts as frequent from so many documents on; within one run of texts of
#: about RUN_BYTES it is noticed from so many on.  At most FREQUENT shingles are moved to
#: the end of the order (2 MB to broadcast); which ones are never changes the result.
FREQUENT, FREQUENT_FROM, NOTICED_FROM, RUN_BYTES = 1 << 18, 8, 3, 16 << 20
#: Words with at least this share of a run are noticed; at most so many are told apart by
#: frequency, in a table of WORD_TABLE bytes to broadcast, all others count as rare.
WORD_SHARE, WORDS, WORD_TABLE = 2.0**-18, 1 << 17, 1 << 20
#: Bits of the filter that spares sets nobody asks for from the shuffle (1 MB).
FILTER_BITS = 1 << 23
#: Classes whose set a task remembers to have sent.
SENT = 1 << 16
FANOUT = 4
#: What a row of :func:`scan` is about.
DOCUMENT, SHINGLE, WORD = range(3)
_U = np.uint64


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    a = mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)
    b = mix(mix(shingles) + _U(0x14057B7EF767814F)).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each value of a shingle's low bits; as many bits as shingles, rounded up."""
    width = max(64, 1 << int(len(shingles) - 1).bit_length())
    flags = np.zeros(width, bool)
    flags[(shingles & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def bitmap_bytes(n: Column) -> Column:
    """Bytes of the bitmap of ``n`` shingles."""
    return F.greatest(F.lit(8), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))))) / 8).cast("long")


def set_bytes(n: Column) -> Column:
    return 8 * n


class Order:
    """One order of all shingles: rare words first, frequent shingles last.

    Any order gives the same links; this one makes prefix shingles rare.  ``frequent`` are
    sorted shingles; ``words`` with their ``classes`` of frequency go to a table of fixed
    size, where words that share a place share a class."""

    def __init__(self, frequent: np.ndarray, words: np.ndarray, classes: np.ndarray):
        self.frequent, self.words = frequent, np.zeros(WORD_TABLE, np.uint8)
        np.maximum.at(self.words, words & _U(WORD_TABLE - 1), classes.astype(np.uint8))

    def keys(self, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place in the order of each window of ``size`` words; the highest bit of
        a place marks frequent shingles."""
        hashes, _ = window_hashes(words, size)
        if not len(hashes):
            return hashes, hashes
        sums = np.concatenate(([0], np.cumsum(self.words[words.hashes & _U(WORD_TABLE - 1)], dtype=np.int64)))
        place = np.minimum(sums[size:] - sums[:-size], 127).astype(_U) << _U(56) | hashes >> _U(8)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            place |= (self.frequent[at] == hashes).astype(_U) << _U(63)
        return hashes, place

    def prefixes(self, words: Words, size: int, percent: int, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
        """The prefix of each set, in order, and how many of it aren't frequent."""
        hashes, place = self.keys(words, size)
        for i, shingles in enumerate(sets):
            lo, n = words.first[i], words.counts[i]
            if n < size:
                yield shingles, len(shingles)
                continue
            keep = len(shingles) - -(-percent * len(shingles) // 100) + 1
            x, p = hashes[lo : lo + n - size + 1], place[lo : lo + n - size + 1]
            for order in (np.argsort(p, kind="stable"), None):
                order = np.lexsort((x, p)) if order is None else order  # only where different shingles share a place
                y = x[order]
                once = np.ones(len(y), bool)
                np.not_equal(y[1:], y[:-1], out=once[1:])
                if once.sum() == len(shingles):
                    break
            yield y[once][:keep], int((p[order][once][:keep] >> _U(63) == 0).sum())


def tree_pairs(bits: np.ndarray, sizes: np.ndarray, slack: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose maximum possible overlap allows a link, by dual traversal.

    ``bits`` has a row of 64-bit words for each leaf, ``slack`` the number of shingles
    beyond its set bits.  With no slack and exact bits these are exactly the links."""
    order = np.argsort(sizes, kind="stable")
    levels = [(bits[order], sizes[order], sizes[order], slack[order])]
    while len(levels[-1][1]) > FANOUT:
        b, low, high, s = levels[-1]
        cut = np.arange(0, len(low), FANOUT)
        levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(s, cut)))
    i, j = np.triu_indices(len(levels[-1][1]))
    for depth in range(len(levels) - 1, -1, -1):
        b, low, high, s = levels[depth]
        if depth == 0:
            i, j = i[i < j], j[i < j]
        fits = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        i, j = i[fits], j[fits]
        both = np.empty(len(i), np.int64)
        step = max(1, (1 << 20) // max(1, b.shape[1]))
        for at in range(0, len(i), step):
            both[at : at + step] = np.bitwise_count(b[i[at : at + step]] & b[j[at : at + step]]).sum(1)
        most = np.minimum(both + np.minimum(s[i], s[j]), np.minimum(high[i], high[j]))
        fits = (100 + percent) * most >= percent * (low[i] + low[j])
        i, j = i[fits], j[fits]
        if depth:
            children, n = np.arange(FANOUT), len(levels[depth - 1][1])
            x, y = np.broadcast_arrays((i[:, None] * FANOUT + children)[:, :, None], (j[:, None] * FANOUT + children)[:, None, :])
            x, y = x.ravel(), y.ravel()
            inside = (x <= y) & (y < n)
            i, j = x[inside], y[inside]
    return order[i], order[j]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def candidates(sizes: np.ndarray, signatures: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the bitmaps allow.  Only equal and neighbouring widths can be linked; the
    wider bitmap is folded."""
    width = np.array([len(x) for x in signatures])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for w in np.unique(width):
        which = np.flatnonzero((width == w) | (width == 2 * w))
        if len(which) < 2:
            continue
        wide = width[which] > w
        bits = np.empty((len(which), w // 8), _U)
        for row, k in enumerate(which):
            x = np.frombuffer(signatures[k], _U)
            bits[row] = x[: w // 8] | x[w // 8 :] if wide[row] else x
        i, j = tree_pairs(bits, sizes[which], sizes[which] - np.bitwise_count(bits).sum(1, dtype=np.int64), percent)
        here = ~(wide[i] & wide[j])
        found.append((which[i[here]], which[j[here]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links(sizes: np.ndarray, signatures: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are linked; signatures are the sets themselves."""
    tokens = np.concatenate([np.frombuffer(x, _U) for x in signatures])
    owner = np.repeat(np.arange(len(signatures)), [len(x) // 8 for x in signatures])
    _, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
    met = count > 1
    place = np.cumsum(met) - 1
    here = met[number]
    owner, place = owner[here], place[number[here]]
    bits = np.zeros((len(signatures), max(1, -(-int(met.sum()) // 64))), _U)
    np.bitwise_or.at(bits, (owner, place >> 6), _U(1) << (place & 63).astype(_U))
    return tree_pairs(bits, sizes, np.zeros(len(sizes), np.int64), percent)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """``uid, n, signature`` of each run of rows with equal keys (columns key, uid, n, signature)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = table["key"].to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(cuts):
            yield from _cut(table.slice(0, int(cuts[-1])), cuts[:-1])
            table = table.slice(int(cuts[-1]))
        rest = table
    if rest is not None and len(rest):
        yield from _cut(rest, np.empty(0, np.int64))


def _cut(table: pa.Table, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    uid, n, signature = table["uid"].to_numpy(), table["n"].to_numpy(), table["signature"]
    bounds = [0, *cuts.tolist(), len(uid)]
    for lo, hi in zip(bounds, bounds[1:]):
        u, first = np.unique(uid[lo:hi], return_index=True)
        if len(u) > 1:
            texts = signature.slice(lo, hi - lo).to_pylist()
            yield u, n[lo:hi][first], [texts[k] for k in first]


def useful(grp: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, reach: int) -> np.ndarray:
    """Which rows, sorted by group and n, have a partner in their group that they can be
    linked with: sizes near enough, and in both sets enough shingles from this one on.

    Linked sets are tested at the first shingle that they share, so all before it count as
    different.  Partners up to ``reach`` rows on are looked at; a row with more than that
    in its group is always kept."""
    keep = np.zeros(len(grp), bool)
    bounds = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
    end = np.repeat(bounds[1:], np.diff(bounds))
    left = n - place
    i = np.arange(len(grp))
    for step in range(1, reach + 1):
        i = i[i + step < end[i]]
        j = i + step
        fits = (100 * n[i] >= percent * n[j]) & ((100 + percent) * np.minimum(left[i], left[j]) >= percent * (n[i] + n[j]))
        keep[i[fits]] = True
        keep[j[fits]] = True
        if not len(i):
            return keep
    many = end - np.repeat(bounds[:-1], np.diff(bounds)) > reach + 1
    return keep | many


def meetings(entries: DataFrame, percent: int, members: int = MEMBERS, size: int = BYTES) -> DataFrame:
    """Groups of classes that meet on a shingle (rows ``grp, uid, n, place``) and may be
    linked: ``uids`` of small groups, ``grp, uids, ns`` of stretches of large ones.

    Size and place travel as one number.
    A group passes through its task as a stream sorted by size; no more than a stretch of
    it is held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, begun = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            grp = table["grp"].to_numpy()
            last = int(np.searchsorted(grp, grp[-1]))  # sorted, and the last group may go on
            before, long = begun, len(table) - last > 4 * members
            if long:
                last, begun = len(table), grp[-1]
            if last:
                yield from groups(table.slice(0, last), before, begun if long else None)
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield from groups(rest, begun, None)

    def groups(table: pa.Table, begun: int | None, goes_on: int | None) -> Iterator[pa.RecordBatch]:
        """The groups of a stretch; ``begun`` has rows before it, ``goes_on`` after it."""
        grp, uid, n = (table[c].to_numpy() for c in ("grp", "uid", "at"))
        n, place = n >> 32, n & 0xFFFFFFFF
        part = np.isin(grp, [x for x in (begun, goes_on) if x is not None])
        kept = useful(grp, n, place, percent, members) | part
        part = part[kept]
        grp, uid, n = grp[kept], uid[kept], n[kept]
        if not len(grp):
            return
        order = np.lexsort((uid, grp))
        grp, uid, n, part = grp[order], uid[order], n[order], part[order]
        bounds = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
        count, first = np.diff(bounds), bounds[:-1]
        held = np.add.reduceat(np.maximum(8, n // 4), first)
        large = (count > members) | (held > size) | part[first]
        some = large | (count > 1)
        rows = np.repeat(some, count)
        offsets = pa.array(np.concatenate(([0], np.cumsum(count[some]))).astype(np.int32))
        ns = pa.ListArray.from_arrays(offsets, pa.array(n[rows]))
        none = pa.array(~large[some])
        names = pa.array(grp[first[some]], mask=~large[some])
        yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(offsets, pa.array(uid[rows])), pc.if_else(none, pa.scalar(None, ns.type), ns)], names=["grp", "uids", "ns"])

    dealt = entries.select("grp", "uid", (F.shiftleft("n", 32) + F.col("place")).alias("at")).repartition("grp").sortWithinPartitions("grp", "at")
    return dealt.mapInArrow(work, "grp long, uids array<long>, ns array<long>")


def resolve(keyed: DataFrame, test: Callable, percent: int) -> DataFrame:
    """Spanning edges (``a``, ``b``) of what ``test`` finds within equal keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for uid, n, signatures in runs(batches):
            i, j = test(n, signatures, percent)
            label = spanning(len(uid), i, j)
            other = np.flatnonzero(label != np.arange(len(uid)))
            a.append(uid[label[other]])
            b.append(uid[other])
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = keyed.select("key", "uid", "n", "signature").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "a long, b long")


def deal(rows: DataFrame, weight: Callable[[Column], Column], members: int, size: int) -> DataFrame:
    """``rows`` (grp, uid, n) of groups with two members or more, with ``bytes`` (of a
    signature) and ``k``, the blocks that the group is cut into."""
    rows = rows.withColumn("bytes", weight(F.col("n")))
    groups = rows.groupBy("grp").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
    return rows.join(groups.filter("m > 1").select("grp", _blocks(F.col("m"), F.col("b"), members, size).alias("k")), "grp")


def _blocks(n: Column, b: Column, members: int, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(members)), F.ceil(b / F.lit(size)), F.lit(1))


def first_keys(dealt: DataFrame) -> DataFrame:
    """``key, uid``: each group, or each of its blocks under two cuts, is one key."""
    cut = lambda seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("k"))
    keys = F.when(F.col("k") == 1, F.array(F.xxhash64("grp"))).otherwise(F.array(*(F.xxhash64("grp", F.lit(seed), cut(seed)) for seed in (1, 2))))
    return dealt.select("uid", F.explode(keys).alias("key"))


def all_links(dealt: DataFrame, edges: DataFrame, signed: DataFrame, test: Callable, percent: int, members: int, size: int) -> DataFrame:
    """``node, component`` by ``edges`` and by the links between what ``edges`` leave apart in
    groups of several blocks.

    The second search for components starts with the stars that the first has found.

    Blocks hold one component each, or whole small components, of one range of sizes; pairs
    of blocks that are one component or whose sizes are not near need no test."""
    found = connected_components(edges)
    large = dealt.filter("k > 1").drop("k")
    if large.isEmpty():
        return found
    label = found.select(F.col("node").alias("uid"), "component")
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent))
    large = large.join(label, "uid", "left").withColumn("component", F.coalesce("component", "uid")).withColumn("band", band)
    of = large.groupBy("grp", "band", "component").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
    of = of.withColumn("k", _blocks(F.col("m"), F.col("b"), members, size)).withColumn("whole", F.when(F.col("k") > 1, F.col("component")))
    rest = of.filter("whole IS NULL").groupBy("grp", "band").agg(_blocks(F.sum("m"), F.sum("b"), members, size).alias("_rest"))
    of = of.join(rest, ["grp", "band"], "left").select("grp", "band", "component", "whole", "k", "_rest")
    split = F.xxhash64("whole", "band", F.pmod(F.xxhash64("uid"), F.col("k")))
    block = F.when(F.col("whole").isNotNull(), split).otherwise(F.xxhash64(F.lit("rest"), F.col("band"), F.pmod(F.xxhash64("component"), F.col("_rest"))))
    placed = large.join(of, ["grp", "band", "component"])
    placed = materialize(placed.select("grp", "uid", "n", "whole", block.alias("block")), "blocks")
    nodes = placed.groupBy("grp", "block").agg(F.first("whole").alias("whole"), F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = nodes.alias("x"), nodes.alias("y")
    near = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    apart = F.coalesce(F.col("x.whole") != F.col("y.whole"), F.lit(True))
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") <= F.col("y.block")) & near & apart)
    sides = F.array_distinct(F.array("x.block", "y.block"))
    pairs = pairs.select(F.col("x.grp").alias("grp"), F.xxhash64("x.grp", "x.block", "y.block").alias("key"), F.explode(sides).alias("block"))
    keyed = pairs.join(placed.select("grp", "block", "uid"), ["grp", "block"]).select("key", "uid").join(signed, "uid")
    more = materialize(resolve(keyed, test, percent), "spanning")
    discard(placed)
    if not more.isEmpty():
        stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = connected_components(stars.unionByName(more))
    discard(more)
    return found


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for lo, hi, data, offsets in text_slices(column):
        yield lo, hi, shingle_sets(Words(data, offsets), size)


def scan(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """One row for each document (``doc_id, c1, c2, n``) and for each shingle and word that
    stood out in a run of texts (``c1``: its hash, ``n``: how often it was seen)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, weight = [], [], 0
        names = ["kind", id_field.name, "c1", "c2", "n"]

        def noticed() -> Iterator[pa.RecordBatch]:
            for kind, values, least in ((SHINGLE, held, NOTICED_FROM), (WORD, words, max(NOTICED_FROM, WORD_SHARE * sum(map(len, words))))):
                value, count = np.unique(np.concatenate(values), return_counts=True)
                some = count >= least
                k = int(some.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.nulls(k, id_type), pa.array(value[some].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(count[some].astype(np.int64))], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                here = Words(data, offsets)
                sets = shingle_sets(here, size)
                c1, c2 = np.array([class_of(s) if len(s) else (0, 0) for s in sets], np.int64).T
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, DOCUMENT, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(c1), pa.array(c2), pa.array(n)], names=names)
                held += sets
                words.append(here.hashes)
                weight += 8 * int(n.sum())
                if weight > RUN_BYTES:
                    yield from noticed()
                    held, words, weight = [], [], 0
        if held:
            yield from noticed()

    id_field = docs.schema[doc_id]
    schema = StructType([StructField("kind", IntegerType()), StructField(id_field.name, id_field.dataType), *(StructField(c, LongType()) for c in ("c1", "c2", "n"))])
    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(work, schema)


def most_seen(noticed: DataFrame, rows: int, limit: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``value, seen`` of those seen most in ``noticed`` (of ``rows`` rows), sorted by value:
    all above a threshold that at most ``limit`` pass, so that is the most that reaches the
    driver."""
    few = tasks_for(rows)
    seen = materialize(noticed.groupBy("c1").agg(F.sum("n").alias("seen")).filter(F.col("seen") >= least).coalesce(few), "seen")
    step = F.floor(16 * F.log2("seen"))
    steps = seen.groupBy(step.alias("step")).count().coalesce(LEAST_TASKS).collect()  # 1024 rows at most
    passed, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["count"]
        if total > limit:
            break
        passed = r["step"]
    most = seen.filter(step >= passed).toPandas() if passed is not None else None
    discard(seen)
    if most is None:
        return np.empty(0, _U), np.empty(0)
    value, count = most["c1"].to_numpy(np.int64).view(_U), most["seen"].to_numpy(np.float64)
    order = np.argsort(value)
    return value[order], count[order]


def learn_order(found: DataFrame) -> Order:
    """The order of shingles that the rows of :func:`scan` suggest."""
    kind = F.col("kind")
    have = found.agg(F.count_if(kind == SHINGLE).alias("shingles"), F.count_if(kind == WORD).alias("words"), F.sum(F.when(kind == DOCUMENT, F.col("n"))).alias("n")).first()
    frequent, _ = most_seen(found.filter(kind == SHINGLE), have["shingles"], FREQUENT, FREQUENT_FROM)
    words, count = most_seen(found.filter(kind == WORD), have["words"], WORDS)
    total = have["n"] or 1
    classes = np.clip(np.log2(np.maximum(count, 1) / total / WORD_SHARE), 1, 15).astype(np.int64)
    return Order(frequent, words, classes)


def _prefixes(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, order: Order) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                sets = shingle_sets(words, size)
                some = [k for k, s in enumerate(sets) if len(s)]
                names = [class_of(sets[k]) for k in some]
                prefixes = list(shared.value.prefixes(words, size, percent, sets))
                columns = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(some, pa.int64())),
                    pa.array([a for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    pa.array([len(sets[k]) for k in some], pa.int64()),
                    pa.array([bitmap(sets[k]) for k in some], pa.binary()),
                    pa.array([prefixes[k][0].view(np.int64) for k in some], pa.list_(pa.int64())),
                    pa.array([prefixes[k][1] for k in some], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "c1", "c2", "n", "signature", "prefix", "early"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(work, f"doc_id {kind}, c1 long, c2 long, n long, signature binary, prefix array<long>, early int")


def _wanted_sets(docs: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """``uid, n, signature`` (the set) and ``keys`` of the wanted classes (uid, c1, c2, keys).

    A task sends the set of a class once, and what several tasks send becomes one."""
    word, bit = F.floor(F.pmod("c1", F.lit(FILTER_BITS)) / 64), F.pmod("c1", F.lit(64)).cast("int")
    rows = wanted.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[[r["w"] for r in rows]] = [r["bits"] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), size):
                names = [class_of(s) if len(s) else (0, 0) for s in sets]
                at = np.array([a for a, _ in names], np.int64) % FILTER_BITS
                some = []
                for k in np.flatnonzero((shared.value[at >> 6] >> (at & 63)) & 1):
                    if names[k] not in sent:
                        some.append(k)
                        sent.add(names[k])
                if len(sent) > SENT:
                    sent.clear()
                columns = [pa.array([names[k][0] for k in some], pa.int64()), pa.array([names[k][1] for k in some], pa.int64()), pa.array([len(sets[k]) for k in some], pa.int64()), pa.array([sets[k].tobytes() for k in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "n", "signature"])

    sets = docs.select(F.col(f"`{text}`")).mapInArrow(work, "c1 long, c2 long, n long, signature binary")
    once = sets.groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
    return once.join(wanted, ["c1", "c2"]).select("uid", "n", "signature", "keys")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    found = materialize(scan(docs, doc_id, text, size), "shingles")
    order = learn_order(found)
    rows = found.filter(F.col("kind") == DOCUMENT).select(F.col(f"`{doc_id}`").alias("doc_id"), "c1", "c2", "n")

    grouped = _prefixes(docs, doc_id, text, size, percent, order).groupBy("c1", "c2")
    same = [F.first(c).alias(c) for c in ("n", "signature", "prefix", "early")]
    classes = materialize(grouped.agg(F.min("doc_id").alias("first_id"), *same).withColumn("uid", F.monotonically_increasing_id()), "classes")

    # Shingles that aren't frequent: groups are small, and those with equal members are one.
    rare = classes.select("uid", "n", F.posexplode(F.slice("prefix", 1, F.col("early"))).alias("place", "grp"))
    met = materialize(meetings(rare, percent, members).distinct(), "meetings")
    small = met.filter("grp IS NULL").select(F.xxhash64("uids").alias("key"), F.explode("uids").alias("uid"))
    pair = F.explode(F.arrays_zip("uids", "ns")).alias("x")
    crowded = met.filter("grp IS NOT NULL").select("grp", pair).select("grp", F.col("x.uids").alias("uid"), F.col("x.ns").alias("n"))
    # Frequent ones, FREQUENT at most: members are counted map-side before anything moves.
    late = classes.filter("size(prefix) > early").select("uid", "n", F.explode(F.slice("prefix", F.col("early") + 1, F.size("prefix"))).alias("grp"))
    names = [F.bit_xor(F.xxhash64("uid", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    several = late.groupBy("grp").agg(F.count("*").alias("m"), *names).filter("m > 1").groupBy("m", "x1", "x2").agg(F.min("grp").alias("grp")).select("grp")
    dealt = materialize(deal(late.join(F.broadcast(several), "grp").unionByName(crowded), bitmap_bytes, members, BYTES), "dealt")
    signed = classes.select("uid", "n", "signature")
    near = materialize(resolve(small.unionByName(first_keys(dealt)).join(signed, "uid"), candidates, percent), "spanning")
    family = all_links(dealt, near, signed, candidates, percent, members, BYTES).select(F.col("node").alias("uid"), F.col("component").alias("grp"))
    names = classes.select("uid", "c1", "c2", "n", "first_id")
    family = materialize(family.join(names.select("uid", "c1", "c2", "n"), "uid"), "families")
    discard(met, dealt, near)

    dealt = materialize(deal(family.select("grp", "uid", "n"), set_bytes, members, BYTES), "dealt")
    keys = first_keys(dealt).groupBy("uid").agg(F.collect_list("key").alias("keys"))
    sets = materialize(_wanted_sets(docs, text, size, family.select("uid", "c1", "c2").join(keys, "uid")), "sets")
    near = materialize(resolve(sets.select("uid", "n", "signature", F.explode("keys").alias("key")), links, percent), "spanning")
    label = materialize(all_links(dealt, near, sets.filter("size(keys) > 1").select("uid", "n", "signature"), links, percent, members, BYTES), "labels")
    discard(dealt, sets, family, near)

    # Classes that have a link; all others name themselves by their smallest id.
    linked = names.join(label.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(linked.join(least, "component").select("c1", "c2", "component_id"), "named")
    discard(classes, label)
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(named, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see :func:`components`."""
    return components(docs, doc_id, text, size, percent)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, and of
    rows with that id the one whose text has the smallest hash.

    Few rows are dropped, so the dropped ones are looked up, not the kept."""
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    found = materialize(components(docs.select(key.alias("key"), F.col(f"`{text}`")), "key", text, size, percent), "components")
    stands = F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = found.filter(~stands).select("doc_id.*").distinct().withColumnRenamed("id", "_id").withColumnRenamed("h", "_h")
    again = found.filter(stands).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id.*").withColumnRenamed("id", "_id").withColumnRenamed("h", "_h")
    keyed = docs.withColumn("_hash", F.xxhash64(F.col(f"`{text}`")))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    kept = keyed.join(drop, same, "left_anti")
    once = kept.join(again, same, "left_anti")
    rest = kept.join(again, same, "left_semi").dropDuplicates([doc_id, "_hash"])
    return once.unionByName(rest).drop("_hash")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g
  FROM d
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), p AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid
), l AS (
  SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (
  SELECT r.x AS rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.y GROUP BY r.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d JOIN c ON c.rid = d.rid LEFT JOIN n ON n.rid = d.rid
"""
