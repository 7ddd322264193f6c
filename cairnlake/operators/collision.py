"""Duplicate detection: incoming nodes that look like existing ones.

The score is half the better of name and alias similarity and a quarter each for
sources and tags. A pair without a common path has at most the tags' quarter
beside its name, so it reaches the threshold only by a name similarity that can
be named in advance; a pair with one meets in a join on paths. Where the
threshold is so low that tags alone reach it, pairs with a common tag are added.
Only these candidates meet the score's set operations. At a threshold of 0 or
less every existing node scores enough; those without anything in common score 0
and rank by their place in the document, so the first few of them stand for all.

Names are dealt by pairs of their rarest bigrams, some ten rows a name, and those
that share one are compared where they meet: bit maps of bigrams first, then all
bigrams of what passes. A pair of names comes out of one group only, that of the
first two bigrams that they share, so pairs are never shuffled or written. A group
of more than ``BLOCK`` names is cut, and any two of its blocks meet in one task.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.functions import similarity
from cairnlake.functions.text import bigrams
from cairnlake.session import written

#: Bigrams that a combination has at most, and combinations of a string at most where it has more than one bigram in each.
DEEPEST, COMBINATIONS = 2, 512
#: Strings of a group that meet in one task, bigrams that are ranked by how many strings have them, and the place of ranked ones.
BLOCK, RANKED, PLACE = 50_000, 60_000, 1 << 43
#: Pairs that are compared at once, pairs that a task hands on at once, and bigrams from which a pair is checked by itself.
CELLS, AT_ONCE, LONG = 1 << 17, 200_000, 64


def _shared_at_least(n: int, part: float) -> int:
    """What a string of n bigrams must share with any partner."""
    return max(1, math.ceil(n * part - 1e-9))


def _depth(n: int, part: float) -> int:
    """How many bigrams the combinations of a string of n bigrams have: as many as it must share and its number of combinations allows."""
    must = _shared_at_least(n, part)
    return max([1, *[k for k in range(2, DEEPEST + 1) if k <= must and math.comb(n - must + k, k) <= COMBINATIONS]])


def _ways(n: int, part: float) -> list[tuple[int, np.ndarray]]:
    """(depth, places of each combination) for a string of n bigrams.

    A pair's depth is the lesser of its two strings', so a string has combinations of
    every depth that a partner of a size within bounds brings about.
    """
    depths, own = set(), _depth(n, part)
    for m in range(_shared_at_least(n, part), math.floor(n / part + 1e-9) + 1):
        if len(depths) == own:  # all there are
            break
        depths.add(1 if own == 1 else min(own, _depth(m, part)))
    return [(k, np.array(list(itertools.combinations(range(n - _shared_at_least(n, part) + k), k)))) for k in sorted(depths)]


def _numbers(strings: DataFrame) -> tuple[dict[str, int], str]:
    """Numbers of bigrams in one order of all of them, rare ones first, and the type that holds them.

    Beyond the ``RANKED`` most frequent ones a bigram is its two code points, which come first.
    """
    counts = strings.select(F.explode(bigrams("s")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = [r.g for r in counts.orderBy(F.desc("df"), "g").limit(RANKED).collect()]
    if len(ranked) < RANKED:
        return {g: len(ranked) - i for i, g in enumerate(ranked)}, "u2"
    return {g: PLACE + len(ranked) - i for i, g in enumerate(ranked)}, "i8"


def _signed(strings: DataFrame, numbers, kind: str, part: float, hot=None) -> DataFrame:
    """(g, h, block, meta, s, ids): strings (s, low, side) under each combination of bigrams by which they are found.

    ``g`` and ``h`` (0 for a single one) are the combination, ``ids`` all bigrams in
    order, ``meta`` holds the string's block, how many bigrams the combination leaves
    out before its last, and the side. Without ``hot`` (number of blocks by
    combination) the rows are (g, h, n): how often a batch has a combination.
    """

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, list] = {}
        for batch in batches:
            by_size: dict[int, tuple[list[int], list[list[int]]]] = {}
            for i, low in enumerate(batch.column(1).to_pylist()):
                own = {low[at : at + 2] for at in range(len(low) - 1)}
                rows, lists = by_size.setdefault(len(own), ([], []))
                rows.append(i)
                lists.append(sorted(numbers.value.get(g) or (ord(g[0]) << 21 | ord(g[1])) + 1 for g in own))
            of, firsts, lasts, left_out = [], [], [], []
            ids: list[bytes] = [b""] * batch.num_rows
            for n, (rows, lists) in by_size.items():
                if not n:
                    continue
                if n not in ways:
                    ways[n] = _ways(n, part)
                grid = np.array(lists, np.int64)
                for i, x in zip(rows, grid.astype(kind)):
                    ids[i] = x.tobytes()
                for k, at in ways[n]:
                    of.append(np.repeat(rows, len(at)))
                    firsts.append(grid[:, at[:, 0]].ravel())
                    lasts.append(grid[:, at[:, 1]].ravel() if k > 1 else np.zeros(len(rows) * len(at), np.int64))
                    left_out.append(np.tile(at[:, -1] + 1 - k, len(rows)))
            of, g, h, e = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (of, firsts, lasts, left_out))
            if hot is None:
                keys, n = np.unique(np.stack([g, h]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n)], ["g", "h", "n"])
                continue
            block, own = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            if hot.value:
                spots = [zlib.crc32(x.encode()) for x in batch.column(0).to_pylist()]
                cut = np.array([hot.value.get(x, 1) for x in zip(g.tolist(), h.tolist())], np.int64)
                own = np.array(spots, np.int64)[of] % cut
                each = np.repeat(np.arange(len(g)), cut)
                other = np.arange(len(each)) - np.repeat(np.cumsum(cut) - cut, cut)
                of, g, h, e, own, cut = (x[each] for x in (of, g, h, e, own, cut))
                block = (np.minimum(own, other) * cut + np.maximum(own, other)) * 2 + (own != other)
            side = batch.column(2).to_numpy()[of].astype(np.int64)
            at = pa.array(of)
            whole = [pa.array(x) for x in (g, h, block, own << 34 | e << 2 | side)]
            yield pa.RecordBatch.from_arrays([*whole, batch.column(0).take(at), pa.array(ids, pa.binary()).take(at)], ["g", "h", "block", "meta", "s", "ids"])

    return strings.mapInArrow(signs, "g long, h long, n long" if hot is None else "g long, h long, block long, meta long, s string, ids binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each combination and block, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise(cuts):
            own = tuple(keys[:, start].tolist())
            if held and key != own:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _common(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, last: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of strings: how many bigrams they share, and how many of these come up to ``last``; of the first ``most`` bigrams, if given."""
    total, early = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    wide = min(int(sizes.max()), most or int(sizes.max()))
    if wide > LONG:
        for i, (p, q) in enumerate(zip(x, y)):
            both = np.intersect1d(flat[starts[p] : starts[p] + sizes[p]], flat[starts[q] : starts[q] + sizes[q]], assume_unique=True)
            total[i], early[i] = len(both), (both <= last).sum()
        return total, early
    places, step = np.arange(wide), CELLS // wide + 1
    for at in range(0, len(x), step):
        own = []
        for r in (x[at : at + step], y[at : at + step]):
            here = places < sizes[r][:, None]
            own.append((flat[np.minimum(starts[r][:, None] + places, len(flat) - 1)], here))
        (a, in_a), (b, in_b) = own
        b = np.where(in_b, b, 0)  # no bigram's number
        met = np.zeros(a.shape, bool)
        for c in range(wide):
            met |= a == b[:, c : c + 1]
        met &= in_a
        total[at : at + step], early[at : at + step] = met.sum(axis=1), (met & (a <= last)).sum(axis=1)
    return total, early


def _near(x: np.ndarray, y: np.ndarray, bits: tuple, room: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y (sorted by size and room; the same array: each pair once) that their bit maps and what their combination leaves out let be similar."""
    low, high, spare = bits
    same = x is y

    def compared(p: np.ndarray, q: np.ndarray, need) -> tuple[np.ndarray, np.ndarray]:
        shared = np.bitwise_count(low[p][:, None] & low[q]) + np.bitwise_count(high[p][:, None] & high[q]) + np.minimum(spare[p][:, None], spare[q])
        i, j = np.nonzero(shared >= need)
        return p[i], q[j]

    if len(x) * len(y) <= CELLS:
        half = least / 2 * sizes
        need = half[x][:, None] + half[y] - 1e-6
        need = np.where(np.minimum(room[x][:, None], room[y]) >= need, need, np.inf)
        if same:
            need[np.tril_indices(len(x))] = np.inf
        yield compared(x, y, need)
        return

    def runs(r: np.ndarray) -> list[np.ndarray]:
        return np.split(r, np.flatnonzero((np.diff(sizes[r]) != 0) | (np.diff(room[r]) != 0)) + 1)

    of_x, of_y = runs(x), runs(y)
    for k, p in enumerate(of_x):
        for m, q in enumerate(of_y[k:] if same else of_y):
            need = least / 2 * (sizes[p[0]] + sizes[q[0]]) - 1e-6
            if min(room[p[0]], room[q[0]]) < need:
                continue
            wide = min(len(q), CELLS // 16)
            step = max(1, CELLS // wide)
            for i in range(0, len(p), step):
                for j in range(0, len(q), wide):
                    a, b = compared(p[i : i + step], q[j : j + wide], need)
                    if same and not m:
                        a, b = a[a < b], b[a < b]  # each pair of the run is met both ways
                    yield a, b


def _pairs(group: pa.Table, kind: str, part: float, least: float, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, dice) of a group's rows, which are sorted by string: similar pairs whose first common bigrams are the group's."""
    g, h, block = (group.column(c)[0].as_py() for c in range(3))
    depth, last = (2, h) if h else (1, g)
    meta, ids = group.column(3).to_numpy(), group.column(5).combine_chunks()
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    flat = np.frombuffer(b"".join(ids.to_pylist()), kind)
    sizes = np.array([len(x) for x in ids.to_pylist()], np.int64) // np.dtype(kind).itemsize
    starts = np.cumsum(sizes) - sizes
    side, left_out, own = meta & 3, (meta >> 2) & 0xFFFFFFFF, meta >> 34
    spots = flat.astype(np.int64) & 127
    one = np.uint64(1) << (spots & 63).astype(np.uint64)
    low, high = (np.bitwise_or.reduceat(np.where(spots >> 6 == k, one, np.uint64(0)), starts) for k in (0, 1))
    spare = (sizes - np.bitwise_count(low) - np.bitwise_count(high)).astype(np.uint16 if sizes.max() < 1 << 15 else np.int64)
    room = sizes - left_out  # what a string can share at most, if the combination is the first
    classes: dict[tuple[int, int], np.ndarray] = {}
    order = np.lexsort((room, sizes))
    for c in {*zip(side.tolist(), own.tolist())}:
        classes[c] = order[(side[order] == c[0]) & (own[order] == c[1])]
    depths = {n: _depth(n, part) for n in set(sizes.tolist())} if depth < DEEPEST else {}
    deep = np.array([depths.get(n, 1) for n in sizes.tolist()])
    across = block & 1  # rows of two blocks, which have met their own elsewhere
    for (c, x), (d, y) in itertools.combinations_with_replacement(classes.items(), 2):
        if not ((c[0] & 1 and d[0] & 2) or (c[0] & 2 and d[0] & 1)) or across and c[1] == d[1]:
            continue
        for i, j in _near(x, y, (low, high, spare), room, sizes, least):
            if depths:
                i, j = i[(ok := np.minimum(deep[i], deep[j]) == depth)], j[ok]
            if not len(i):
                continue
            i, j = np.minimum(i, j), np.maximum(i, j)
            most = int(max(left_out[i].max(), left_out[j].max())) + depth
            first = _common(flat, starts, sizes, i, j, last, most)[1] == depth
            i, j = i[first], j[first]
            if not len(i):
                continue
            dice = 2.0 * _common(flat, starts, sizes, i, j, last)[0] / (sizes[i] + sizes[j])
            there = (dice >= least) & (side[i] & 1 > 0) & (side[j] & 2 > 0)
            yield i[there], j[there], dice[there]
            if not ordered:
                back = (dice >= least) & (side[j] & 1 > 0) & (side[i] & 2 > 0)
                yield j[back], i[back], dice[back]


def _similar(left: DataFrame, right: DataFrame, least: float, ordered: bool) -> DataFrame:
    """(a, b, dice) of unequal strings (column s) with Dice >= least > 0, each pair once; only those with a < b, if asked.

    Strings of x and y bigrams with 2c / (x + y) >= least have a smaller side of at
    least least / (2 - least) of the larger one, and each shares at least o = that
    part of its own bigrams. In one order of all bigrams (rare ones first) the first
    k common ones, k <= o, lie within the first n - o + k of either; so the strings
    share a combination of k of these. What a string leaves out before the last of
    the first k common ones it doesn't share.
    """
    part = least / (2 - least)
    if left is right:
        strings = left.select("s").where("s IS NOT NULL").distinct().withColumn("side", F.lit(3))
    else:
        both = left.select("s", F.lit(1).alias("side")).union(right.select("s", F.lit(2).alias("side")))
        strings = both.where("s IS NOT NULL").groupBy("s").agg(F.bit_or("side").alias("side"))
    strings = written(strings)
    named, kind = _numbers(strings)
    context = strings.sparkSession.sparkContext
    numbers = context.broadcast(named)
    rows = strings.select("s", F.lower("s").alias("low"), "side")
    counted = _signed(rows, numbers, kind, part).groupBy("g", "h").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    hot = context.broadcast({(r.g, r.h): -(-r.n // BLOCK) for r in counted.collect()})
    dealt = _signed(rows, numbers, kind, part, hot).repartition("g", "h", "block").sortWithinPartitions("g", "h", "block", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            strings, out, n = group.column(4).combine_chunks(), [], 0

            def made() -> pa.RecordBatch:
                a, b, dice = (np.concatenate(x) for x in zip(*out))  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (strings.take(pa.array(a)), strings.take(pa.array(b)))] + [pa.array(dice)], ["a", "b", "dice"])  # noqa: B023

            for found in _pairs(group, kind, part, least, ordered):
                out.append(found)
                n += len(found[0])
                if n > AT_ONCE:
                    yield made()
                    out, n = [], 0
            if n:
                yield made()

    return dealt.mapInArrow(run, "a string, b string, dice double")


def candidate_strings(left: DataFrame, right: DataFrame, least: float, *, ordered: bool = False) -> DataFrame:
    """(a, b) of unequal strings (column s) with Dice >= least > 0, each pair once."""
    return _similar(left, right, least, ordered).select("a", "b")


def similar_strings(left: DataFrame, right: DataFrame, least: float, *, ordered: bool = False) -> DataFrame:
    """(a, b, dice) of distinct strings (column s) with Dice >= least > 0: equal ones included, or only those with a < b."""
    met = _similar(left, right, least, ordered)
    if ordered:
        return met
    equal = left.select(F.col("s").alias("a")).distinct().join(right.select(F.col("s").alias("b")).distinct(), F.col("a") == F.col("b"))
    return met.unionByName(equal.select("a", "b", F.lit(1.0).alias("dice")))


def find_collisions(incoming: DataFrame, nodes: DataFrame, *, threshold: float | None = None, top: int = similarity.TOP) -> DataFrame:
    """(id, candidate, similarity, rank): the best ``top`` existing nodes of each incoming one at or above the threshold.

    Both sides have id, name, sources and tags; existing nodes also aliases and map_pos. The own id is no candidate.
    """
    threshold = similarity.threshold() if threshold is None else threshold
    new = incoming.select("id", "name", "sources", "tags")
    old = nodes.select(F.col("id").alias("candidate"), F.col("name").alias("c_name"), F.col("sources").alias("c_sources"), F.col("tags").alias("c_tags"), "aliases", "map_pos")
    tagged = (threshold - similarity.TAG_WEIGHT) / similarity.NAME_WEIGHT  # what the name must give without a common path
    alone = threshold / similarity.NAME_WEIGHT  # and without a common tag as well
    pairs = _by_name(new, old, max((tagged if tagged > 0 else alone) - 1e-9, 1e-9)).union(_by_part(new, old, "sources", lambda s: s["file_path"]))
    if tagged <= 0:
        pairs = pairs.union(_by_part(new, old, "tags", lambda t: t))
        if threshold <= 0:
            first = old.orderBy("map_pos").limit(top + 1).select("candidate")
            pairs = pairs.union(new.select("id").join(F.broadcast(first), how="cross"))
    both = pairs.where(F.col("id") != F.col("candidate")).distinct().join(new, "id").join(old, "candidate")
    score = similarity.collision_score(F.col("name"), F.col("c_name"), F.col("aliases"), F.col("sources"), F.col("c_sources"), F.col("tags"), F.col("c_tags"))
    found = both.withColumn("similarity", score).where(F.col("similarity") >= threshold)
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "map_pos")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("id", "candidate", "similarity", "rank")


def _by_name(new: DataFrame, old: DataFrame, least: float) -> DataFrame:
    """(id, candidate) with a name or alias of at least this similarity; none above 1."""
    if least > 1:
        return new.select("id", F.lit(None).cast("string").alias("candidate")).where("false")
    strings = old.select("candidate", F.explode(F.array_distinct(F.concat(F.array("c_name"), "aliases"))).alias("s"))
    pairs = similar_strings(new.select(F.col("name").alias("s")), strings.select("s"), least)
    return new.select("id", "name").join(pairs, F.col("name") == F.col("a")).join(strings, F.col("s") == F.col("b")).select("id", "candidate")


def _by_part(new: DataFrame, old: DataFrame, column: str, key) -> DataFrame:
    """(id, candidate) that share an element of an array column."""
    x = new.select("id", F.explode(F.array_distinct(F.transform(column, key))).alias("k"))
    y = old.select("candidate", F.explode(F.array_distinct(F.transform(f"c_{column}", key))).alias("k"))
    return x.join(y, "k").select("id", "candidate")
