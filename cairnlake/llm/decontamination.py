"""Benchmark decontamination with suffix arrays of the training text.

Each batch of documents is a shard. Its words become numbers (0 for a word that
no benchmark item has) and its suffixes are sorted to the depth of a window;
a suffix leaves the array at the first word at which no test suffix goes on like
it. Every test suffix is then looked up by binary search, which gives the
interval of all its occurrences and so their places. Occurrences that follow
each other, in the document as in the item, make the longest verbatim matches:
(item, first word in the document, first word in the item, number of words).
All results derive from these matches.

A window is ``window`` consecutive words of an item; a shorter item, unless it
has no words, is one window and matches as a whole. Matches shorter than a
window don't count.

The benchmark is broadcast in blocks of at most ``block_words`` words (a longer
item is a block of its own), so one block is the bound of what a task holds. If
there are several, the documents are read once more beforehand: a broadcast bit
map of fixed size, filled with hashes of all windows, tells which documents may
hold one, and only these are looked up in the blocks, one after the other. The
map only spares work; every verdict comes from the matches.

Null texts have no words; items with a null id count under the empty id;
repeated items count once, repeated rows each. Very long texts are shards of
their own, read whole; matches within one item are in the order of the document.
An empty table of documents gives an empty result, an empty benchmark no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import as_bytes, has_bit, map_batches, persist, pick, sha256_hex
from cairnlake.llm.shingles import WordHashes, window_hashes

WINDOW = 13
#: A document is contaminated if hit words times this reach its words.
SHARE = 20
#: Maps bytes to a word's lower-case letters, digits and bytes of non-ASCII characters, and all else to a space.
_FOLD = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Matches (before they are joined to longest ones) that are worked on at once.
AT_ONCE = 2_000_000
#: Size of the bit map of windows: 32 MB, two bits a window.
FILTER_BITS = 1 << 28

MATCH = "array<struct<item:string,doc_word:bigint,item_word:bigint,words:bigint>>"
_MATCH = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of one length: for each depth the sorted keys (rank of the words before, next word), and where each window lies."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, items: np.ndarray, places: np.ndarray, length: int, base: int):
        self.length, self.base, self.depths = length, base, []
        rank = np.zeros(len(starts), np.int64)
        for j in range(length):
            keys, rank = np.unique(rank * base + ids[starts + j], return_inverse=True)
            self.depths.append(keys)
        order = np.lexsort((places, items, rank))
        self.items, self.places = items[order], places[order]
        self.first = np.searchsorted(rank[order], np.arange(len(self.depths[-1]) + 1))

    def suffixes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of the shard ``ids`` to this depth, of the suffixes that begin like a window, with their ranks."""
        at = np.flatnonzero(ids[: max(0, len(ids) - self.length + 1)])
        rank = np.zeros(len(at), np.int64)
        for j, keys in enumerate(self.depths):
            own = rank * self.base + ids[at + j]
            rank = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            same = keys[rank] == own
            at, rank = at[same], rank[same]
        order = np.argsort(rank, kind="stable")
        return at[order], rank[order]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the shard) of all occurrences, by place."""
        at, rank = self.suffixes(ids)
        every = np.arange(len(self.depths[-1]))
        low, high = np.searchsorted(rank, every, "left"), np.searchsorted(rank, every, "right")
        window = np.repeat(every, high - low)
        order = np.argsort(at, kind="stable")
        return window[order], at[order]


class Block:
    """Some benchmark items (name, words): vocabulary and windows by length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.names = [name for name, _ in items]
        ids = np.array([number(w) for _, words in items for w in words], np.int64)
        sizes = np.array([len(words) for _, words in items], np.int64)
        begins = np.cumsum(sizes) - sizes
        lengths = np.minimum(sizes, window)
        self.windows = []
        for length in np.unique(lengths[lengths > 0]):
            of = np.flatnonzero(lengths == length)
            n = sizes[of] - length + 1
            owner = np.repeat(of, n)
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.windows.append(Windows(ids, begins[owner] + places, owner, places, int(length), len(self.vocabulary) + 1))


def built(shared: Broadcast) -> Block:
    """The block of a broadcast {"items", "window"}, built once in each worker."""
    state = shared.value
    if "block" not in state:
        state["block"] = Block(state["items"], state["window"])
    return state["block"]


def shard(texts: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all words with a 0 between documents, first place of each document, its number of words)."""
    get = block.vocabulary.get
    parts, lengths = [np.zeros(0, np.int64)], []
    for text in texts:
        words = words_of(text)
        parts += [np.fromiter((get(w, 0) for w in words), np.int64, len(words)), np.zeros(1, np.int64)]
        lengths.append(len(words))
    lengths = np.array(lengths, np.int64)
    return np.concatenate(parts), np.cumsum(lengths + 1) - (lengths + 1), lengths


def longest(windows: Windows, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, item, place in the item, words) of the maximal matches that the occurrences make."""
    times = windows.first[window + 1] - windows.first[window]
    p = np.repeat(at, times)
    where = np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(windows.first[window], times)
    item, place = windows.items[where], windows.places[where]
    order = np.lexsort((p, p - place, item))
    p, item, place = p[order], item[order], place[order]
    begins = np.ones(len(p), bool)
    begins[1:] = (item[1:] != item[:-1]) | (p[1:] - place[1:] != p[:-1] - place[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(begins)
    return p[first], item[first], place[first], np.diff(np.append(first, len(p))) + windows.length - 1


def matches_in(texts: list[bytes], block: Block) -> tuple[list[int], list[list[tuple[str, int, int, int]]]]:
    """(words of each text, its longest matches (item, word in the text, word in the item, words), sorted by place and item)."""
    ids, begins, lengths = shard(texts, block)
    out: list[set[tuple[str, int, int, int]]] = [set() for _ in texts]
    for windows in block.windows:
        window, at = windows.found(ids)
        doc = np.searchsorted(begins, at, "right") - 1
        load = np.cumsum(windows.first[window + 1] - windows.first[window])
        first = 0
        while first < len(at):  # whole documents, until they hold enough
            enough = np.searchsorted(load, (load[first - 1] if first else 0) + AT_ONCE, "right")
            last = max(np.searchsorted(doc, doc[min(enough, len(at) - 1)], "left"), np.searchsorted(doc, doc[first], "right")) if enough < len(at) else len(at)
            for p, item, place, n in zip(*[x.tolist() for x in longest(windows, window[first:last], at[first:last])]):
                d = int(np.searchsorted(begins, p, "right")) - 1
                out[d].add((block.names[item], p - int(begins[d]), place, n))
            first = last
    return lengths.tolist(), [sorted(x, key=lambda m: (m[1], m[0], m[2], m[3])) for x in out]


def hit_words(found: list[tuple[int, int]]) -> int:
    """Words inside any of the stretches (first word, words)."""
    n, last = 0, 0
    for s, length in sorted(found):
        n += max(0, s + length - max(s, last))
        last = max(last, s + length)
    return n


def blocks(benchmark: DataFrame, *, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[dict]:
    """The benchmark, streamed to the driver in parts of at most ``block_words`` words (a longer item is a part of its own)."""
    items, n = [], 0
    for row in pick(benchmark, item=item_col, text=text_col).where(F.col("text").isNotNull()).toLocalIterator():
        words = words_of(row.text.encode("utf-8", "surrogatepass"))
        if items and n + len(words) > block_words:
            yield {"items": items, "window": window}
            items, n = [], 0
        items.append(("" if row.item is None else str(row.item), words))
        n += len(words)
    yield {"items": items, "window": window}


def window_bits(hashes: np.ndarray) -> list[np.ndarray]:
    """The two places of each window in the bit map."""
    return [(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64), (hashes >> np.uint64(64 - (FILTER_BITS - 1).bit_length())).astype(np.int64)]


def suspects(rows: DataFrame, bits: Broadcast, lengths: list[int]) -> DataFrame:
    """``rows`` (id, text, key) with n_words, and text null where the bit map excludes all windows."""

    def make():
        hashes = WordHashes()

        def work(batch):
            n_words, keep = [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                n_words.append(len(words))
                keep.append(any((has_bit(bits.value, a) & has_bit(bits.value, b)).any() for a, b in (window_bits(window_hashes(words, n, hashes)) for n in lengths)))
            texts = pa.array([t if k else None for t, k in zip(batch.column(1).to_pylist(), keep)], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2), pa.array(n_words, pa.int64())], ["id", "text", "key", "n_words"])

        return work

    return map_batches(rows, make, f"id {dict(rows.dtypes)['id']}, text string, key long, n_words long")


def matches(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = 1_000_000) -> DataFrame:
    """id, key (a hash of the text), n_words and the longest matches with the benchmark of every row."""
    rows = pick(documents, id=id_col, text=text_col).withColumn("key", F.xxhash64("text"))
    context, kind = documents.sparkSession.sparkContext, dict(rows.dtypes)["id"]

    def looked_up(df: DataFrame, shared: Broadcast) -> DataFrame:
        def make():
            block = built(shared)

            def work(batch):
                n_words, found = matches_in(as_bytes(batch.column(1)), block)
                out = [[dict(zip(("item", "doc_word", "item_word", "words"), m)) for m in x] for x in found]
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(out, _MATCH)], ["id", "key", "n_words", "matches"])

            return work

        return map_batches(df, make, f"id {kind}, key long, n_words long, matches {MATCH}")

    parts = []  # broadcasts; the driver keeps none of their values
    bits, lengths, hashes = None, set(), WordHashes()
    for state in blocks(benchmark, item_col=item_col, text_col=item_text_col, window=window, block_words=block_words):
        parts.append(context.broadcast(state))
        if len(parts) > 1 and bits is None:
            bits = np.zeros(FILTER_BITS // 8, np.uint8)
            filled = [p.value for p in parts[:-1]]
        else:
            filled = []
        if bits is not None:
            for words in (w for s in (*filled, state) for _, w in s["items"] if w):
                lengths.add(min(window, len(words)))
                for at in window_bits(window_hashes(words, min(window, len(words)), hashes)):
                    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    if bits is None:
        return looked_up(rows, parts[0])
    held = persist(suspects(rows, context.broadcast(bits), sorted(lengths)))
    clean = held.where("text is null").select("id", "key", "n_words", F.array().cast(MATCH).alias("matches"))
    asked = persist(held.where("text is not null"))
    each = [looked_up(asked, p).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    one = every.groupBy("id", "key", "n_words", "part").agg(F.first("matches").alias("matches"), F.count(F.lit(1)).alias("rows"))  # equal rows have equal matches
    merged = one.groupBy("id", "key", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.max("rows").alias("rows"))
    again = merged.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return clean.union(again.select("id", "key", "n_words", "matches"))


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", share: int = SHARE, **options) -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, n_longest (words of the longest match) for every row; options as for ``matches``."""
    found = matches(documents, benchmark, id_col=id_col, **options).select("id", "n_words", "matches")

    def make():
        def work(batch):
            out = []
            for n, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n_hit, items = hit_words([(m["doc_word"], m["words"]) for m in spans]), sorted({m["item"] for m in spans})
                out.append((n, n_hit, len(items), sha256_hex(items), n_hit > 0 and share * n_hit >= n, max((m["words"] for m in spans), default=0)))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_longest"])

        return work

    return map_batches(found, make, f"`{id_col}` {dict(found.dtypes)['id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_longest long")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE, block_words: int = 1_000_000) -> DataFrame:
    """``documents`` without contaminated rows; map-only for a benchmark of one block.

    For more blocks the verdicts on texts (by two hashes) come from ``matches``.
    """
    place, columns = documents.columns.index(text_col), documents.columns
    stream = blocks(benchmark, item_col=item_col, text_col=item_text_col, window=window, block_words=block_words)
    only = next(stream)
    if next(stream, None) is not None:
        named = documents.select(F.struct(F.xxhash64(documents[text_col]), F.sha1(documents[text_col])).cast("string").alias("name"), documents[text_col].alias("text"))
        found = matches(named, benchmark, id_col="name", text_col="text", item_col=item_col, item_text_col=item_text_col, window=window, block_words=block_words)
        hit = F.aggregate(F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["words"]).alias("e")))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last")), lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(m["s"], a["last"]))).cast("long").alias("n"), F.greatest(a["last"], m["e"]).alias("last")), lambda a: a["n"])
        bad = found.where(F.size("matches") > 0).withColumn("hit", hit).where(F.lit(share) * F.col("hit") >= F.col("n_words")).select(F.col("id").alias("__name")).distinct()
        name = F.struct(F.xxhash64(documents[text_col]), F.sha1(documents[text_col])).cast("string")
        return documents.join(bad, name == F.col("__name"), "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(only)

    def make():
        block = built(shared)

        def work(batch):
            verdicts = zip(*matches_in(as_bytes(batch.column(place)), block))
            keep = pa.array([not (found and share * hit_words([m[1::2] for m in found]) >= n) for n, found in verdicts], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], columns)

        return work

    return map_batches(documents, make, documents.schema)
