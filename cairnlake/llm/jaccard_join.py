"""N-gram Jaccard join: an exact similarity self-join of shingle sets, and its components.

Two documents link if ``den * |A and B| >= num * |A or B|`` for their sets of
word shingles. The join works on distinct sets, so copies of a text cost nothing.

Index. Each set's shingles are put in one global order (frequent ones last,
then by hash) and only its prefix is indexed: sets that link share a prefix
shingle. The frequent shingles are those that repeat within slices of the corpus,
added up over all of it, and, among the lowest hashes, which prefixes are made of,
those that an eighth of the sets has often; their number is bounded by the order's
thresholds, so they can be broadcast, and they decide only the order. An index list longer than ``BLOCKED`` is cut into blocks by
set size and by position in the set's order. Both are part of the join's key: a
probe names the blocks whose sizes and positions leave room for a link and never
meets the others; in a short list it meets all and looks at sizes and positions. A pair survives only if its shared prefix
shingles reach the least number that a link needs, and if small sketches of its
sets, which never tell sets further apart than they are, leave room for a link;
only texts of such pairs are shuffled.

Answers from answers. In a block longer than ``dense`` pairs aren't formed.
One member is the block's hub; all members are compared with it. By the triangle
inequality of the Jaccard distance, every link of a member near the hub lies
within a wider circle around the hub. Inside the circle a set is kept as its
difference from the circle's consensus (the shingles that most members have),
and links are derived from the differences alone: sets with small differences
link by arithmetic, and others only if they share differences, which an index of
the rarest differences finds.

Homes. A set may sit in several circles; its home is the largest of those whose
consensus it is closest to, give or take half the room that a link leaves. Where
many members of a circle are far from its consensus and share differences that
make up half the room, they are a family of their own: one of them becomes a further hub,
and its circle is derived from the old one by composing differences, without a
look at any text. A home circle is made to hold all who share a circle with one
of its sets, derived in the same way. A link by shared differences is looked for
from a home circle's own sets only, so two families cost what their sizes cost
and not the square; only sets that share frequent differences within one family
(edits at the same places, too large for arithmetic) are met pair by pair. No
link between different sets is lost.

Counts. For the number of links of each set, links by arithmetic are read off
sums over the weights in its home circle, links by shared differences are
derived one by one.

Verdicts on pairs are exact on 64-bit shingle hashes. A document without words
(null or empty text) has an empty set and links with nothing; one with fewer
words than a shingle has its whole sequence as one. Texts are read whole,
however long. Repeated rows and ids each get their row; null ids never name a
component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.llm.common import as_bytes, bit_map, give_back, has_bit, map_batches, persist, pick, release
from cairnlake.llm.components import components
from cairnlake.llm.shingles import WordHashes, least_apart, parity_sketch, set_key, shingle_set

#: Shingles in this many texts of a slice or more are counted for the order.
LOCAL_REPEATS = 3
#: One in so many sets tells how many sets have its shingles of the lowest hashes (below LOW).
COUNTED, LOW = 8, 1 << 62
#: Bound for each way of counting on the frequent shingles that are broadcast (16 bytes each).
MOST_FREQUENT = 1 << 20
LEAST_FREQUENT = 64
#: Index lists longer than this are solved around a hub.
DENSE = 16
#: Index lists longer than this are cut into blocks; the probes of others aren't multiplied.
BLOCKED = 64
#: Sizes of the bit maps of wanted texts and of shared shingles: 2 and 16 MB.
FILTER_BITS, TOKEN_BITS = 1 << 24, 1 << 27
#: The rows of one hub are dealt over this many keys where they meet what is known of the hub.
SALTS = 32
#: A further hub is sought where a difference is shared by this part of a circle's far members; at most so many rounds, pairs do the rest.
FAMILY_PART, ROUNDS = 8, 6


def profile(rows: DataFrame, size: int) -> DataFrame:
    """kind 0: (id, n, key, at, sketch) of each text; kind 1: (token key, n) of shingles that repeat in a slice; kind 2: those below LOW of one in COUNTED sets."""
    kind = dict(rows.dtypes)["id"]

    def make():
        hashes = WordHashes()

        def work(batch):
            sets = [shingle_set(t, size, hashes) for t in as_bytes(batch.column(1))]
            tokens, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= LOCAL_REPEATS
            own = [set_key(s) for s in sets]
            low, held = np.unique(np.concatenate([*(s[: np.searchsorted(s, np.uint64(LOW))] for s, k in zip(sets, own) if k % COUNTED == 0), np.zeros(0, np.uint64)]), return_counts=True)
            extra = int(often.sum()) + len(low)
            keys = own + tokens[often].view(np.int64).tolist() + low.view(np.int64).tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * len(sets) + [1] * (extra - len(low)) + [2] * len(low), pa.int32()),
                    pa.concat_arrays([batch.column(0), pa.nulls(extra, batch.column(0).type)]),
                    pa.array([len(s) for s in sets] + counts[often].tolist() + held.tolist(), pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.concat_arrays([batch.column(2), pa.nulls(extra, pa.string())]),
                    pa.array([parity_sketch(s) for s in sets] + [None] * extra, pa.binary()),
                ],
                ["kind", "id", "n", "key", "at", "sketch"],
            )

        return work

    return map_batches(rows, make, f"kind int, id {kind}, n long, key long, at string, sketch binary")


def frequent(profiles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, log2 of their counts); at most MOST_FREQUENT of each kind, since their counts add up to at most all that were counted."""
    totals = {r.kind: r.n for r in profiles.where("kind != 1").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = max(LEAST_FREQUENT, -(-totals.get(0, 0) // MOST_FREQUENT))
    least_low = max(LEAST_FREQUENT // COUNTED, -(-totals.get(2, 0) // MOST_FREQUENT))
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    counts = profiles.where("kind > 0").groupBy("key").agg(of_kind(1).alias("n"), of_kind(2).alias("low"))
    found = counts.where((F.col("n") >= least) | (F.col("low") >= least_low)).select("key", F.greatest("n", F.col("low") * COUNTED).alias("n")).toArrow()
    tokens, counts = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    del found
    give_back()
    return tokens[order], np.log2(np.maximum(counts[order], 1)).astype(np.int8) + 1


def ordered(tokens: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: rare ones first, then by hash."""
    if not len(often):
        return tokens
    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
    return tokens[np.lexsort((tokens, np.where(often[at] == tokens, rank[at], 0)))]


def step_of(num: int, den: int) -> float:
    """Ratio of the size blocks: no link reaches further than the next block."""
    return max(den / num, 1.01)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def index_entries(rows: DataFrame, size: int, num: int, den: int, often: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(token, key, n, pos) of the prefix of each set; a set once a slice."""
    shared = rows.sparkSession.sparkContext.broadcast((often, rank))

    def make():
        hashes = WordHashes()
        often, rank = shared.value

        def work(batch):
            seen: set[int] = set()
            parts, meta = [np.zeros(0, np.uint64)], []
            for text in as_bytes(batch.column(0)):
                tokens = shingle_set(text, size, hashes)
                key = set_key(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    parts.append(ordered(tokens, often, rank)[: prefix_length(len(tokens), num, den)])
                    meta.append((key, len(tokens), len(parts[-1])))
            times = np.array([m[2] for m in meta], np.int64)
            spread = lambda i: np.repeat(np.array([m[i] for m in meta], np.int64), times)
            pos = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(spread(0)), pa.array(spread(1).astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "key", "n", "pos"])

        return work

    return map_batches(rows.select("text"), make, "token long, key long, n int, pos int")


def plausible(pairs: DataFrame, names: DataFrame, least: Fraction) -> tuple[DataFrame, DataFrame]:
    """(those of ``pairs`` whose sketches leave room for a similarity of ``least``, (key, at) of their sets); none that has it is lost."""
    keys_of = lambda df: df.select(F.col("a").alias("key")).union(df.select(F.col("b").alias("key"))).distinct()
    known = persist(keys_of(pairs).join(names, "key"))
    own = lambda side: known.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"sketch_{side}"))
    num, den = least.numerator, least.denominator

    def make():
        def work(batch):
            na, nb, one, other = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [(num + den) * least_apart(x, y) <= (den - num) * (n + m) for n, m, x, y in zip(na, nb, one, other)]
            return pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

        return work

    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
    left = persist(map_batches(rows, make, "a long, b long"))
    keys = persist(keys_of(left).join(known.select("key", "at"), "key"))
    release(known)
    return left, keys


def compared(pairs: DataFrame, texts: DataFrame, size: int, least: Fraction) -> DataFrame:
    """(a, b, na, nb, both, gone, more) of the pairs (a, b) whose similarity is at least ``least``.

    gone: shingles of b that a lacks; more: shingles that only a has.
    """
    own = lambda side: texts.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}"))
    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "text_a", "text_b")
    num, den = least.numerator, least.denominator

    def make():
        hashes = WordHashes()
        last: dict[int, np.ndarray] = {}

        def tokens(key: int, text: bytes) -> np.ndarray:
            if key not in last:
                if len(last) > 200:
                    last.clear()
                last[key] = shingle_set(text, size, hashes)
            return last[key]

        def work(batch):
            out = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                x, y = tokens(a, ta), tokens(b, tb)
                common = np.intersect1d(x, y, assume_unique=True)
                if den * len(common) >= num * (len(x) + len(y) - len(common)):
                    gone, more = (np.setdiff1d(s, common, assume_unique=True).view(np.int64).tolist() for s in (y, x))
                    out.append((a, b, len(x), len(y), len(common), gone, more))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "na", "nb", "both", "gone", "more"])

        return work

    return map_batches(rows, make, "a long, b long, na long, nb long, both long, gone array<bigint>, more array<bigint>")


def dealt(rows: DataFrame, by_hub: DataFrame, spread: str) -> DataFrame:
    """``rows`` joined with the row of their hub; the rows of a hub are spread over SALTS keys."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.join(by_hub.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hub", "salt"]).drop("salt")


def composed(gone: str, more: str, gone_2: str, more_2: str) -> tuple[Column, Column]:
    """(in K but not in X, in X but not in K) from the differences of X (gone, more) and of K (gone_2, more_2) to one set."""
    apart = lambda a, b, c, d: F.concat(F.array_except(a, b), F.array_except(c, d))  # noqa: E731  the two sides are disjoint
    return apart(gone, gone_2, more_2, more), apart(gone_2, gone, more, more_2)


def seats_of(circles: DataFrame) -> DataFrame:
    """(hub, set, nh, gone, more) of every member of a circle, the hub itself included."""
    none = F.array().cast("array<bigint>")
    own = circles.groupBy("b").agg(F.first("nb").alias("nh")).select(F.col("b").alias("hub"), F.col("b").alias("set"), "nh", none.alias("gone"), none.alias("more"))
    return circles.select(F.col("b").alias("hub"), F.col("a").alias("set"), F.col("nb").alias("nh"), "gone", "more").union(own)


def centres(seats: DataFrame, num: int, den: int, dense: int) -> DataFrame:
    """(hub, fg, fm, np, m): what most members around the hub lack of it, and have beyond it; the consensus' size; members of the circle.

    Only members within half the room of the hub have a say, or, where these are
    few, the nearest quarter, so that the consensus is that of the hub's family.
    """
    apart = den * F.size("gone") + num * F.size("more")
    half = F.floor(F.col("nh") * (den - num) / 2)
    sizes = seats.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.first("nh").alias("nh"), F.count_if(apart <= half).alias("close"), F.percentile_approx(apart, 0.25, 200).alias("quarter"))
    sizes = sizes.withColumn("reach", F.when(F.col("close") > dense, half).otherwise(F.col("quarter"))).select("hub", "m", "nh", "reach")
    inner = dealt(seats.drop("nh"), sizes.select("hub", "reach"), "set").where(apart <= F.col("reach")).select("hub", "gone", "more")
    voters = inner.groupBy("hub").agg(F.count(F.lit(1)).alias("v"))
    token = lambda c, is_gone: inner.select("hub", F.explode(c).alias("token"), F.lit(is_gone).alias("lost"))
    counts = token("gone", True).union(token("more", False)).groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c"), F.first("lost").alias("lost")).where("c > 1")
    most = dealt(counts, voters, "token").where("2 * c > v")
    flips = most.groupBy("hub").agg(F.collect_list(F.when(F.col("lost"), F.col("token"))).alias("fg"), F.collect_list(F.when(~F.col("lost"), F.col("token"))).alias("fm"))
    none = F.array().cast("array<bigint>")
    out = sizes.join(flips, "hub", "left").withColumns({c: F.coalesce(c, none) for c in ("fg", "fm")})
    return out.select("hub", "fg", "fm", (F.col("nh") - F.size("fg") + F.size("fm")).cast("long").alias("np"), "m")


def weighed(seats: DataFrame, centre: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, set, own, w, k, room, m): each member's difference from the consensus of its circle.

    With differences taken to any set P of the circle (not necessarily a
    document's), |A and B| = |P| - gone(A) - gone(B) + c with c the differences
    that A and B share, so A and B link if and only if
    w(A) + w(B) <= (den - num) * |P| + (den + num) * c, where w = den * gone + num * more.
    """
    gone, more = composed("gone", "more", "fg", "fm")
    met = dealt(seats, centre, "set").select("hub", "set", gone.alias("gone"), more.alias("more"), (F.col("np") * (den - num)).alias("room"), "m")
    return met.select("hub", "set", F.concat("gone", "more").alias("own"), (den * F.size("gone") + num * F.size("more")).cast("long").alias("w"), (F.size("gone") + F.size("more")).cast("long").alias("k"), "room", "m")


def homes(members: DataFrame) -> DataFrame:
    """(set, hub, far) of each set's home: of the circles that are nearest, give or take half the room, the largest.

    far: whether it is half the room or more from the consensus even there.
    """
    seats = F.collect_list(F.struct("m", (-F.col("hub")).alias("order"), "w", "room", "hub"))
    rows = members.groupBy("set").agg(seats.alias("seats"), F.min("w").alias("least"))
    best = F.array_max(F.filter(F.transform("seats", lambda x: F.when(2 * (x["w"] - F.col("least")) <= x["room"], x)), lambda x: x.isNotNull()))
    return rows.select("set", best.alias("best")).select("set", F.col("best.hub").alias("hub"), (2 * F.col("best.w") >= F.col("best.room")).alias("far"))


def derived(seats: DataFrame, to: DataFrame, least: Fraction) -> DataFrame:
    """Seats (hub: the new one) of the members of old circles around new hubs; ``to`` (hub, new, nk, gone_2, more_2) has the new hub's differences to the old one.

    |X and K| = |K| - (what X lacks of K); only members at least ``least`` similar stay.
    """
    gone, more = composed("gone", "more", "gone_2", "more_2")
    met = dealt(seats.select("hub", "set", "gone", "more"), to, "set").select(F.col("new").alias("hub"), "set", F.col("nk").alias("nh"), gone.alias("gone"), more.alias("more"))
    both, every = F.col("nh") - F.size("gone"), F.col("nh") + F.size("more")
    return met.where(F.lit(least.denominator) * both >= F.lit(least.numerator) * every).dropDuplicates(["hub", "set"])


def further_hubs(seats: DataFrame, members: DataFrame, home: DataFrame, known: DataFrame, num: int, den: int, dense: int) -> DataFrame:
    """(hub, new, nk, gone_2, more_2): for each circle with a family among its far members, one of the family, unless ``known`` (set) as a hub.

    A family shares a difference, and most of it share differences that make up half the room.
    """
    far = members.join(home.where("far").select("set", "hub"), ["hub", "set"]).join(known, "set", "left_anti").select("hub", "set", "own", "room")
    sizes = far.groupBy("hub").agg(F.count(F.lit(1)).alias("u"), F.first("room").alias("room")).where(F.col("u") > dense)
    single = far.select("hub", "set", F.explode("own").alias("token"))
    shared = single.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c"), F.min("set").alias("new")).where(F.col("c") > dense)
    top = shared.groupBy("hub").agg(F.max(F.struct("c", "token", "new")).alias("t")).join(sizes, "hub").where(FAMILY_PART * F.col("t.c") >= F.col("u")).select("hub", "room", "t.*")
    family = single.join(top.select("hub", "token"), ["hub", "token"]).select("hub", "set")
    held = single.join(family, ["hub", "set"]).groupBy("hub", "token").agg(F.count(F.lit(1)).alias("held"))
    often = dealt(held, top.select("hub", "c"), "token").where("2 * held > c")
    named = often.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(top, "hub").where(F.col("n") * (num + den) >= F.col("room")).select("hub", F.col("new").alias("set"))
    own = seats.join(named, ["hub", "set"])
    return own.select("hub", F.col("set").alias("new"), (F.col("nh") - F.size("gone") + F.size("more")).cast("long").alias("nk"), F.col("gone").alias("gone_2"), F.col("more").alias("more_2"))


def home_circles(circles: DataFrame, num: int, den: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """(home (set, hub), members of the home circles as ``weighed`` gives them, with ``home``: whether it is the set's own).

    Whoever shares a circle with a set sits in the set's home circle too, so all
    links of the set with sets of its circles can be counted there, once.
    """
    far = 1 - Fraction(num, den)
    seats = persist(seats_of(circles))
    centre = persist(centres(seats, num, den, dense))
    members = persist(weighed(seats, centre, num, den))
    home = persist(homes(members))
    for _ in range(ROUNDS):
        new = persist(further_hubs(seats, members, home, centre.select(F.col("hub").alias("set")), num, den, dense))
        if not new.take(1):
            release(new)
            break
        around = persist(derived(seats, new, max(Fraction(0), 1 - 3 * far)))
        nearer = persist(centres(around, num, den, dense))
        old = (seats, centre, members, home, new, around, nearer)
        seats, centre = persist(seats.union(around.select(*seats.columns))), persist(centre.union(nearer))
        members = persist(members.union(weighed(around, nearer, num, den)))
        home = persist(homes(members))
        release(*old)

    # (old hub, home, a set that sits in both): the way from the old circle to the home.
    moves = seats.select("hub", "set").join(home.select("set", F.col("hub").alias("new")), "set").where("hub != new").groupBy("hub", "new").agg(F.min("set").alias("set"))
    at = lambda hub, names: seats.select(F.col("hub").alias(hub), "set", *[F.col(c).alias(n) for c, n in names.items()])
    way = moves.join(at("hub", {"gone": "g1", "more": "m1"}), ["hub", "set"]).join(at("new", {"gone": "g2", "more": "m2", "nh": "nk"}), ["new", "set"])
    # h = B + g2 - m2 and H = B + g1 - m1: what h lacks of H, and has beyond it.
    lacks, beyond = composed("m2", "g2", "m1", "g1")
    to = persist(way.select("hub", "new", "nk", lacks.alias("gone_2"), beyond.alias("more_2")))
    asked = derived(seats, to, max(Fraction(0), 1 - 4 * far)).join(seats.select("hub", "set"), ["hub", "set"], "left_anti")
    at_home = home.select("hub").distinct()
    full = dealt(seats, at_home, "set").select(*seats.columns).unionByName(asked)
    own = home.select("set", "hub", F.lit(True).alias("home"))
    out = persist(weighed(full, centre, num, den).drop("m").join(own, ["set", "hub"], "left").fillna(False, ["home"]))
    release(seats, centre, members, to)
    return home, out


def sharing_pairs(sets: DataFrame, num: int, den: int, *, stars_too: bool) -> DataFrame:
    """Candidates (hub, set_a, set_b, w_a, w_b, room, home_b, times_a, times_b): pairs with ``home_a`` that share a rare difference and may link.

    Without ``stars_too`` only pairs that the star doesn't connect. A pair whose
    sets are both at home comes once.
    """
    rest = sets.where("k > 0").groupBy("hub").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.min(F.when(~F.col("star"), F.col("w"))).alias("out"))
    other = F.col("least") if stars_too else F.when(F.col("star"), F.col("out")).otherwise(F.col("least"))
    needs = dealt(sets.where("k > 0"), rest, "set").withColumn("other", other).where("other is not null and w + most > room")
    needs = needs.withColumn("q", F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("other") - F.col("room")) / F.lit(num + den))).cast("long")).where("q <= k")
    single = needs.select("hub", "set", "w", "k", "q", "room", "home", "star", "times", F.explode("own").alias("token"))
    common = single.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("any")).where("c > 1 and any").drop("any")
    single = single.join(common, ["hub", "token"], "left").fillna(1, ["c"])
    rare = W.partitionBy("hub", "set").orderBy("c", "token")
    probe = single.withColumn("r", F.row_number().over(rare)).where((F.col("r") <= F.col("k") - F.col("q") + 1) & (F.col("c") > 1))
    probe = persist(probe.select("hub", "token", "set", "w", "k", "r", "room", "home", "star", "times"))
    side = lambda s: probe.select("hub", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("set", "w", "k", "r", "home", "star", "times")], F.col("room").alias(f"room_{s}"))
    # Sets that share ``must`` differences share one among the first k - must + 1 of each, rare ones first.
    must = F.greatest(F.lit(1), F.ceil((F.col("w_a") + F.col("w_b") - F.col("room_a")) / F.lit(num + den)))
    reach = (F.col("r_a") <= F.col("k_a") - must + 1) & (F.col("r_b") <= F.col("k_b") - must + 1)
    once = (F.col("set_a") != F.col("set_b")) & (~F.col("home_b") | (F.col("set_a") < F.col("set_b")))
    wanted = (F.col("w_a") + F.col("w_b") > F.col("room_a")) if stars_too else ~(F.col("star_a") & F.col("star_b"))
    met = side("a").where("home_a").join(side("b"), ["hub", "token"]).where(once & wanted & reach)
    out = persist(met.select("hub", "set_a", "set_b", "w_a", "w_b", F.col("room_a").alias("room"), "home_b", "times_a", "times_b").distinct())
    release(probe)
    return out


def sharing_links(sets: DataFrame, num: int, den: int, *, stars_too: bool) -> DataFrame:
    """(hub, set_a, set_b, home_b, times_a, times_b): the candidates that link, by all differences that they share."""
    met = sharing_pairs(sets, num, den, stars_too=stars_too)
    own = lambda s: sets.select("hub", F.col("set").alias(f"set_{s}"), F.col("own").alias(f"own_{s}"))
    shared = met.join(own("a"), ["hub", "set_a"]).join(own("b"), ["hub", "set_b"]).withColumn("c", F.size(F.array_intersect("own_a", "own_b")))
    return shared.where(F.col("w_a") + F.col("w_b") <= F.col("room") + F.lit(num + den) * F.col("c")).select("hub", "set_a", "set_b", "home_b", "times_a", "times_b")


def circle_links(members: DataFrame, copies: DataFrame | None, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members with star, centre and times, links (a, b) of the stars, ``sharing_links``) of home circles.

    A circle's centre is its lightest set; the star are the sets that link with
    it by arithmetic. Without ``copies`` (key, times) each set counts once.
    """
    best = members.groupBy("hub").agg(F.min(F.struct("w", "set")).alias("best"))
    sets = members.join(copies.withColumnRenamed("key", "set"), "set") if copies is not None else members.withColumn("times", F.lit(1).cast("long"))
    sets = dealt(sets, best, "set").withColumn("star", F.col("w") + F.col("best.w") <= F.col("room")).withColumn("centre", F.col("best.set")).drop("best")
    sets = persist(sets)
    stars = sets.where("star and set != centre").select(F.col("set").alias("a"), F.col("centre").alias("b"))
    return sets, stars, persist(sharing_links(sets, num, den, stars_too=copies is not None))


def counted(sets: DataFrame, shared: DataFrame, linked: DataFrame, home: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, n) whose sums are the documents of other sets that link with a set.

    Links by arithmetic are read off sums over the weights in the set's home;
    those by shared differences, and ``linked`` pairs from outside it, add up.
    """
    by_weight = sets.groupBy("hub", "room", "w").agg(F.sum("times").alias("n"))
    steps = by_weight.select("hub", "w", F.col("w").alias("x"), "n", F.lit(0).alias("ask")).union(by_weight.select("hub", "w", (F.col("room") - F.col("w")).alias("x"), F.lit(0), F.lit(1)))
    upto = steps.withColumn("upto", F.sum("n").over(W.partitionBy("hub").orderBy("x", "ask").rowsBetween(W.unboundedPreceding, 0))).where("ask = 1").select("hub", "w", "upto")
    plain = sets.where("home").join(upto, ["hub", "w"]).select(F.col("set").alias("key"), (F.col("upto") - F.when(2 * F.col("w") <= F.col("room"), F.col("times")).otherwise(0)).alias("n"))
    near = shared.select(F.col("set_a").alias("key"), F.col("times_b").alias("n")).union(shared.where("home_b").select("set_b", "times_a"))
    ways = linked.union(linked.select("b", "a"))
    inside = sets.select(F.col("set").alias("b"), "hub")
    apart = ways.join(home.select(F.col("set").alias("a"), "hub"), "a", "left").join(inside, ["b", "hub"], "left_anti")
    return plain.union(near).union(apart.join(copies.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), F.col("times").alias("n")))


def blocks_of(entries: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Long index lists by blocks (token, block, cell): (probes, targets).

    ``block`` numbers sizes, ``cell`` positions. A probe from a smaller set a at
    position pa meets a target b at pb only if pa - pb <= na - need and
    pb - pa <= nb - need, where need, the least overlap of a link, is
    num * (na + nb) / (num + den); it names just the cells within these bounds
    for the sizes that a block holds.
    """
    ratio, slack = den / num, 1e-9
    largest = lambda block: F.pow(F.lit(step_of(num, den)), block + 1)
    width = lambda block: F.greatest(F.lit(1.0), F.ceil(largest(block) * F.lit((den - num) / (2 * den))))
    at = lambda pos, block: F.floor(pos / width(block)).cast("int")
    right = entries.select("token", "block", at(F.col("pos"), F.col("block")).alias("cell"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    left = entries.select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"))
    most = F.least(largest(F.col("block")), F.col("na") * F.lit(ratio))
    low = F.greatest(F.lit(0.0), F.col("pa") - F.floor(F.col("na") * F.lit((den - num) / (den + num)) + F.lit(slack)))
    high = F.greatest(low, F.col("pa") + F.floor((F.lit(float(den)) * most - F.lit(float(num)) * F.col("na")) / F.lit(float(num + den)) + F.lit(slack)))
    return left.withColumn("cell", F.explode(F.sequence(at(low, F.col("block")), at(high, F.col("block"))))), right


def candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of entries that share enough prefix shingles, within the bounds of size and position."""
    short = entries.where(F.col("m") <= BLOCKED)
    one, other = (short.select("token", F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}")) for k in "ab")
    left, right = blocks_of(entries.where(F.col("m") > BLOCKED), num, den)
    met = one.join(other, "token").unionByName(left.join(right, ["token", "block", "cell"]).drop("block", "cell"))
    need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
    sizes = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    inside = (F.col("nb") - F.greatest(F.col("pb") - F.col("pa"), F.lit(0)) >= need) & (F.col("na") - F.greatest(F.col("pa") - F.col("pb"), F.lit(0)) >= need)
    fits = sizes & (F.lit(den) * F.col("na") >= F.lit(num) * F.col("nb")) & inside
    least = lambda n: F.ceil(F.lit(num) * F.col(n) / F.lit(den))
    counted = met.where(fits).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(F.col("shared") + F.greatest(least("na"), least("nb")) - 1 >= need).select("a", "b")


def shared_entries(first: DataFrame, num: int, den: int) -> DataFrame:
    """The entries of shingles that several sets have, once each, with the length ``m`` of their list and their size block.

    A broadcast bit map of these shingles, of fixed size, keeps most other entries out of the join.
    """
    lists = persist(first.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi").select("token", "m"))
    spot = F.col("token").bitwiseAND(F.lit(TOKEN_BITS - 1)).alias("bit")
    shared = first.sparkSession.sparkContext.broadcast(bit_map(lists.select(spot), TOKEN_BITS))

    def choose():
        def work(batch):
            keep = pa.array(has_bit(shared.value, batch.column(0).to_numpy() & (TOKEN_BITS - 1)))
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], batch.schema.names)

        return work

    some = map_batches(first, choose, "token long, key long, n int, pos int")
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(step_of(num, den))) + F.lit(1e-9)).cast("int")
    out = persist(some.join(lists, "token").select("token", "key", "n", "pos", "m", block.alias("block")).distinct())
    release(lists)
    return out


def similar_sets(rows: DataFrame, profiles: DataFrame, size: int, num: int, den: int, dense: int, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between keys of different sets that connect what the join's links connect.

    With ``copies`` (key, times) also (key, n), whose sums are the documents of
    other sets that link with the set; sets without such a link may be missing.
    """
    first = persist(index_entries(rows, size, num, den, *frequent(profiles)))
    entries = shared_entries(first, num, den)
    release(first)

    # Hubs of dense blocks, and who meets them from the same and the next blocks.
    far = 1 - Fraction(num, den)
    hubs = persist(entries.where(F.col("m") > dense).groupBy("token", "block").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("key", "n")).alias("h")).where(F.col("held") > dense).select("token", "block", F.col("h.key").alias("hub"), F.col("h.n").alias("nh")))
    around = entries.where(F.col("m") > dense).select("token", "key", "n", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])).alias("block"))
    wide = float(max(Fraction(0), 1 - 3 * far)) - 1e-9
    met = around.join(hubs, ["token", "block"]).where((F.col("key") != F.col("hub")) & (F.least("n", "nh") >= F.greatest("n", "nh") * F.lit(wide)))
    met = persist(met.select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct())
    names = persist(profiles.where("kind = 0 and n > 0").groupBy("key").agg(F.min(F.struct("at", "n", "sketch")).alias("x")).select("key", "x.*"))
    circles = verified(met, names, rows, size, max(Fraction(0), 1 - 3 * far))
    near = circles.where(F.lit(den) * F.col("both") >= F.lit(max(0, 2 * num - den)) * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("a").alias("key"), F.col("b").alias("hub"))
    covered = entries.where(F.col("m") > dense).select("token", "block", "key").join(hubs.select("token", "block", "hub"), ["token", "block"]).join(near, ["key", "hub"], "left_semi").select("token", "key")
    open_ = persist(entries.join(covered, ["token", "key"], "left_anti"))
    release(entries, hubs)

    pairs = persist(candidates(open_, num, den))
    release(open_)
    linked = verified(pairs, names, rows, size, Fraction(num, den))
    release(names)

    home, members = home_circles(circles, num, den, dense)
    release(circles)
    sets, stars, shared = circle_links(members, copies, num, den)
    linked_ab = linked.select("a", "b")
    links = persist(linked_ab.union(stars).union(shared.select("set_a", "set_b")))
    counts = None
    if copies is not None:
        counts = persist(counted(sets, shared, linked_ab, home, copies).groupBy("key").agg(F.sum("n").alias("n")))
    release(linked, home, members, sets, shared)
    return links, counts


def verified(pairs: DataFrame, names: DataFrame, rows: DataFrame, size: int, least: Fraction) -> DataFrame:
    """``compared`` for the ``pairs``, which are released, with a look at the texts of plausible ones only."""
    left, keys = plausible(pairs, names, least)
    release(pairs)
    texts = wanted_texts(rows, keys, size)
    out = persist(compared(left, texts, size, least))
    release(left, keys, texts)
    return out


def wanted_texts(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(key, text) of one document for each set of ``keys`` (key, at).

    A broadcast bit map of fixed size keeps most other texts out of the shuffle;
    when it fills up, more texts take part in the join, and none is missed.
    """
    bit = F.pmod(F.xxhash64("at"), F.lit(FILTER_BITS)).alias("bit")

    bits = bit_map(keys.select(bit), FILTER_BITS)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def choose():
        def work(batch):
            at = batch.column(2).to_numpy()
            keep = pa.array(has_bit(shared.value, at))
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["at", "text"])

        return work

    found = map_batches(rows.select("at", "text", bit), choose, "at string, text string").join(keys, "at")

    def check():
        hashes = WordHashes()

        def work(batch):
            keep = pa.array([set_key(shingle_set(t, size, hashes)) == k for t, k in zip(as_bytes(batch.column(1)), batch.column(0).to_pylist())], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], ["key", "text"])

        return work

    return persist(map_batches(found.select("key", "text"), check, "key long, text string").dropDuplicates(["key"]))


def place(id_col: Column, text_col: Column) -> Column:
    """Names a row for joins: its id, or for a null id a hash of its text."""
    return F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.concat(F.lit("#"), F.hex(F.xxhash64(text_col))))


def linked_sets(rows: DataFrame, size: int, num: int, den: int, dense: int, *, count_links: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs (id, n, key, at) of ``rows`` (id, text, at), roots (node, root) of linked keys, counts of links by key)."""
    profiles = persist(profile(rows, size))
    docs = profiles.where("kind = 0").select("id", "n", "key", "at")
    copies = persist(docs.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("times"))) if count_links else None
    links, counts = similar_sets(rows, profiles, size, num, den, dense, copies)
    roots = components(links)
    release(links, copies)
    return docs, roots, counts


def jaccard_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, dense: int = DENSE, count_links: bool = True) -> DataFrame:
    """``id_col``, n_shingles, component_id (the smallest id that links reach) and n_links (other rows that the row links with) for every row.

    Without ``count_links`` only the links that connect are derived, and n_links is left out.
    """
    shrink = Fraction(num, den)
    num, den = shrink.numerator, shrink.denominator
    rows = pick(documents, id=id_col, text=text_col).withColumn("at", place(F.col("id"), F.col("text")))
    docs, roots, counts = linked_sets(rows, size, num, den, dense, count_links=count_links)
    docs = docs.drop("at")
    sets = docs.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), (F.count(F.lit(1)) - 1).alias("others")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    sets = sets.withColumn("root", F.coalesce("root", "key"))
    named = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    label = sets.join(named, "root").select("key", "component_id", "others")
    if counts is not None:
        label = label.join(counts.groupBy("key").agg(F.sum("n").alias("far")), "key", "left").select("key", "component_id", (F.col("others") + F.coalesce("far", F.lit(0))).alias("n_links"))
    numbers = ["n_links"] if count_links else []
    full = docs.where("n > 0").join(label, "key").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *numbers)
    return full.unionByName(docs.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in numbers]))


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, dense: int = DENSE) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest id, null ids last, then of the smallest key of its set.

    Rows are chosen, not ids: a row of another component stays though its id is
    that of a row that goes. Of rows with the same id and set one stays; rows
    without words are in no component and all stay. A broadcast bit map of fixed
    size lets the rows of components of one row pass without a shuffle.
    """
    shrink = Fraction(num, den)
    num, den = shrink.numerator, shrink.denominator
    rows = pick(documents, id=id_col, text=text_col).withColumn("at", place(F.col("id"), F.col("text")))
    docs, roots, _ = linked_sets(rows, size, num, den, dense, count_links=False)
    grouped = docs.where("n > 0").join(roots.withColumnRenamed("node", "key"), "key", "left").select("id", "key", "at", F.coalesce("root", "key").alias("hub"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "at"))
    kept = grouped.groupBy("hub").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("hub", "first")
    several = persist(dealt(grouped, kept, "at").select(F.col("at").alias("__at"), F.col("key").alias("__key"), ((F.col("at") == F.col("first.at")) & (F.col("key") == F.col("first.key"))).alias("stays")))
    spot = lambda at: F.pmod(F.xxhash64(at), F.lit(FILTER_BITS))
    shared = documents.sparkSession.sparkContext.broadcast(bit_map(several.select(spot("__at").alias("bit")), FILTER_BITS))
    columns, text_at = documents.columns, documents.columns.index(text_col)
    named = documents.select("*", place(documents[id_col], documents[text_col]).alias("__at")).withColumn("__bit", spot("__at"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def split(of_several: bool):
        def make():
            hashes = WordHashes()

            def work(batch):
                asked = has_bit(shared.value, batch.column(len(columns) + 1).to_numpy())
                sets = [shingle_set(t, size, hashes) if ask else () for t, ask in zip(as_bytes(batch.column(text_at)), asked)]
                chosen = pa.array([bool(len(x)) == of_several for x in sets], pa.bool_())
                keys = [pa.array([set_key(x) for x in sets if len(x)], pa.int64())] if of_several else []
                kept = [c.filter(chosen) for c in batch.columns[: len(columns) + of_several]]
                return pa.RecordBatch.from_arrays([*kept, *keys], [*columns, *(["__at", "__key"] if of_several else [])])

            return work

        return make

    met = map_batches(named, split(True), f"{fields}, __at string, __key long")
    chosen = met.join(several.where("not stays").select("__at", "__key").distinct(), ["__at", "__key"], "left_anti").dropDuplicates(["__at", "__key"])
    return map_batches(named, split(False), fields).union(chosen.select(*columns))
