"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted with a map-side combine. The vocabulary is sorted by range
partitions, and executors cut it into shards, each a compact trie: nodes only
where words part, and the rest of a word in its leaf. Shards are broadcast in
blocks of at most ``BLOCK`` bytes, one block at a time through the driver,
however large the vocabulary. In each block, tasks walk every word's
Levenshtein automaton of distance one over every shard depth-first: at each node
of the word's own path the states after one edit are followed to the end before
the path goes deeper. A task reduces what a word meets to a number and the best
form, so no pairs are shuffled.

Near words differ by exactly one inserted, deleted or replaced code point. A
word's form is its near word of largest n (ties: the smallest in code-point
order) if that n is at least twice the word's. Forms' n at least double at each
step, so following them ends, after few rounds of pointer doubling, at the root.

Null texts have no words, a null id reads as empty, rows may repeat and count
each time, very long texts and runs are read whole, an empty table gives an empty
result, and further columns are ignored. All words count, none is dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import SLICE, give_back, map_batches, persist, pick, release

MODULUS, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Characters of the words of a shard, and bytes of the shards that are broadcast at once (one shard at least).
SHARD, BLOCK = 2 << 20, 64 << 20
#: States of the automata that are followed at once.
STATES = 1 << 20


# --- counts -----------------------------------------------------------------


def spelled(doc_id: object, text: str, pattern: re.Pattern) -> list[str]:
    """The runs of a text, lower-cased in A-Z; one in 97, by its hash with the id, without the code point that the hash names."""
    runs = pattern.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass"))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, runs), repeat(start)), np.int64, len(runs))
    for i in np.flatnonzero(hashes % MODULUS == 0).tolist():
        run = runs[i]
        at = int(hashes[i]) % len(run)
        runs[i] = run[:at] + run[at + 1 :]
    return runs


def word_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least_count`` times or more."""
    rows = pick(documents, id=id_col, text=text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")  # shorter runs give no word
        held: Counter[str] = Counter()
        for batch in batches:
            step = max(1, int(batch.num_rows * min(1, SLICE / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.update(spelled(doc_id, text or "", pattern))
                    if len(held) > HELD:
                        yield counted(held)
                        held.clear()
        yield counted(held)
        held = None
        give_back()

    def counted(held: Counter[str]) -> pa.RecordBatch:
        kept = {w: n for w, n in held.items() if len(w) >= least_length}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- tries ------------------------------------------------------------------


class Trie(NamedTuple):
    """Words as bytes of Latin-1, each ended by a zero, in code-point order.

    Inner nodes are numbered from 0, the root; ``keys`` holds node * 256 + letter
    in ascending order and ``child`` an inner node or -1 - word for a leaf, whose
    remaining letters begin at ``tail`` of the word.
    """

    letters: bytes
    starts: np.ndarray
    counts: np.ndarray
    keys: np.ndarray
    child: np.ndarray
    first: np.ndarray
    tail: np.ndarray


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def build_trie(words: list[bytes], counts: list[int]) -> Trie:
    """Of distinct words in ascending order, without terminators."""
    ended = [w + b"\0" for w in words]
    starts = np.zeros(len(ended) + 1, np.int64)
    np.cumsum([len(w) for w in ended], out=starts[1:])
    keys, child, tail, path, nodes, before = [], [], [], [0], 1, 0
    for i, word in enumerate(ended):
        after = _shared(word, ended[i + 1]) if i + 1 < len(ended) else 0
        del path[before + 1 :]
        for d in range(before + 1, after + 1):
            keys.append(path[d - 1] << 8 | word[d - 1])
            child.append(nodes)
            path.append(nodes)
            nodes += 1
        parts = max(before, after)
        keys.append(path[parts] << 8 | word[parts])
        child.append(-1 - i)
        tail.append(parts + 1)
        before = after
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys = np.array(keys, np.int64)[order]
    first = np.searchsorted(keys, np.arange(nodes + 1, dtype=np.int64) << 8)
    return Trie(b"".join(ended), starts, np.array(counts, np.int64), keys, np.array(child, np.int64)[order].astype(np.int32), first.astype(np.int32), np.array(tail, np.int32))


def one_edit(a: bytes, b: bytes) -> bool:
    """Exactly one byte inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = _shared(a, b)
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def near_pairs(trie: Trie, letters: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, word of the trie) one edit apart; the words lie in ``letters``, each ended by a zero, from ``starts``.

    An edit stands at the first letter where the two differ, so each pair comes
    once, and on a way without branches the states after an edit end at once.
    """
    own = np.frombuffer(letters, np.uint8)
    label = (trie.keys & 255).astype(np.uint8)
    found_k, found_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def step(node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places with a child, the children)."""
        asked = node.astype(np.int64) << 8 | letter
        at = np.minimum(np.searchsorted(trie.keys, asked), len(trie.keys) - 1)
        hit = np.flatnonzero(trie.keys[at] == asked)
        return hit, trie.child[at[hit]]

    def follow(k: np.ndarray, node: np.ndarray, pos: np.ndarray) -> None:
        """States after the edit: the rest of the word must be spelled below the node."""
        while len(k):
            leaf = node < 0
            if leaf.any():
                lk, li, lp = k[leaf], -1 - node[leaf].astype(np.int64), pos[leaf]
                begin, end, s_begin, s_end = starts[lk] + lp, starts[lk + 1], trie.starts[li] + trie.tail[li], trie.starts[li + 1]
                same = np.flatnonzero(end - begin == s_end - s_begin)
                spelled_out = [letters[a:b] == trie.letters[c:d] for a, b, c, d in zip(begin[same].tolist(), end[same].tolist(), s_begin[same].tolist(), s_end[same].tolist())]
                same = same[np.array(spelled_out, bool)]
                found_k.append(lk[same])
                found_i.append(li[same])
                inner = ~leaf
                k, node, pos = k[inner], node[inner], pos[inner]
            hit, node = step(node, own[starts[k] + pos])
            k, pos = k[hit], pos[hit] + 1

    k, node, depth = np.arange(len(starts) - 1), np.zeros(len(starts) - 1, np.int32), 0
    while len(k):  # the exact path of each word; all states stand at one depth
        letter = own[starts[k] + depth]
        within = letter != 0
        apart = np.flatnonzero(within)
        apart = apart[own[starts[k[apart]] + depth + 1] != letter[apart]]  # in a run of one letter only the last is deleted
        follow(k[apart], node[apart], np.full(len(apart), depth + 1))  # the word's letter deleted
        fan = (trie.first[node + 1] - trie.first[node]).astype(np.int64)
        of = np.repeat(np.arange(len(k)), fan)
        edge = np.arange(len(of)) - np.repeat(np.cumsum(fan) - fan, fan) + trie.first[node][of]
        put = (label[edge] != 0) & (label[edge] != letter[of])
        of, edge = of[put], edge[put]
        follow(k[of], trie.child[edge], np.full(len(of), depth))  # a letter inserted
        other = within[of]
        follow(k[of[other]], trie.child[edge[other]], np.full(int(other.sum()), depth + 1))  # the letter replaced
        hit, node = step(node, letter)
        k = k[hit]
        leaf = node < 0
        depth += 1
        lk, li = k[leaf], -1 - node[leaf].astype(np.int64)
        rest = zip((starts[lk] + depth).tolist(), (starts[lk + 1] - 1).tolist(), (trie.starts[li] + depth).tolist(), (trie.starts[li + 1] - 1).tolist())
        ends = np.array([one_edit(letters[a:b], trie.letters[c:d]) for a, b, c, d in rest], bool) if len(lk) else np.zeros(0, bool)
        found_k.append(lk[ends])
        found_i.append(li[ends])
        k, node = k[~leaf], node[~leaf]
    return np.concatenate(found_k), np.concatenate(found_i)


# --- shards and search --------------------------------------------------------


def _packed(trie: Trie) -> dict[str, bytes]:
    return {f: getattr(trie, f) if f == "letters" else getattr(trie, f).tobytes() for f in Trie._fields}


_KINDS = {"starts": np.int64, "counts": np.int64, "keys": np.int64, "child": np.int32, "first": np.int32, "tail": np.int32}


def unpacked(fields: dict[str, bytes]) -> Trie:
    return Trie(**{f: bytes(fields[f]) if f == "letters" else np.frombuffer(fields[f], _KINDS[f]) for f in Trie._fields})


def trie_shards(words: DataFrame) -> DataFrame:
    """(shard, size, a trie's fields) of (word, n): range partitions in order, cut into shards by their characters."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0

        def made() -> pa.RecordBatch:
            fields = _packed(build_trie(held, counts))
            columns = [pa.array([held[0].decode("latin-1")], pa.string()), pa.array([sum(map(len, fields.values()))], pa.int64()), *[pa.array([fields[f]], pa.binary()) for f in Trie._fields]]
            return pa.RecordBatch.from_arrays(columns, ["shard", "size", *Trie._fields])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = word.encode("latin-1")
                if held and size + len(raw) + 1 > SHARD:
                    yield made()
                    held, counts, size = [], [], 0
                held.append(raw)
                counts.append(n)
                size += len(raw) + 1
        if held:
            yield made()
        held = None
        give_back()

    sized = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("size")).first().size
    dealt = words.repartitionByRange(max(1, -(-sized // SHARD)), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(build, "shard string, size long, " + ", ".join(f"{f} binary" for f in Trie._fields))


def _blocks(shards: DataFrame) -> Iterator[list[str]]:
    """Shards by their names, in blocks of at most ``BLOCK`` bytes."""
    block, size = [], 0
    for row in shards.select("shard", "size").orderBy("shard").toLocalIterator():
        if block and size + row.size > BLOCK:
            yield block
            block, size = [], 0
        block.append(row.shard)
        size += row.size
    if block:
        yield block


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of (word, n) by shard: how many near words it has there, and the best of them."""
    session = words.sparkSession
    shards = persist(trie_shards(words))
    found = []
    for block in _blocks(shards):
        rows = shards.where(F.col("shard").between(block[0], block[-1])).orderBy("shard").drop("shard", "size").collect()
        sent = session.sparkContext.broadcast([r.asDict() for r in rows])
        rows = None
        found.append(persist(_searched(words, sent)))
        sent.destroy()
    release(shards)
    return reduce(DataFrame.unionByName, found) if found else session.createDataFrame([], "word string, n_near long, form string, form_n long")


def _searched(words: DataFrame, sent) -> DataFrame:
    def make():
        tries = [unpacked(fields) for fields in sent.value]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = sorted(w.encode("latin-1") for w in batch.column(0).to_pylist())  # neighbours in the batch take like ways
            sizes = np.array([len(w) + 1 for w in raw], np.int64)
            letters, starts = b"\0".join([*raw, b""]), np.concatenate([[0], np.cumsum(sizes)])
            out: list[list] = [[], [], [], []]
            for trie in tries:
                step = max(1, STATES // (2 * int(np.diff(trie.first).max())))
                for at in range(0, len(raw), step):
                    own = starts[at : at + step + 1]
                    k, i = near_pairs(trie, letters[own[0] : own[-1]], own - own[0])
                    order = np.lexsort((i, -trie.counts[i], k))
                    k, i = k[order], i[order]
                    heads = np.flatnonzero(np.diff(k, prepend=-1))
                    best = i[heads]
                    out[0] += [raw[at + x].decode("latin-1") for x in k[heads].tolist()]
                    out[1] += np.diff(heads, append=len(k)).tolist()
                    out[2] += [trie.letters[a : b - 1].decode("latin-1") for a, b in zip(trie.starts[best].tolist(), trie.starts[best + 1].tolist())]
                    out[3] += trie.counts[best].tolist()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "form", "form_n"])

        return work

    return map_batches(words.select("word"), make, "word string, n_near long, form string, form_n long")


# --- forms ------------------------------------------------------------------


def followed(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling; each round is a written table."""
    now = persist(links.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        new = persist(now.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        release(now)
        now = new.drop("moved")
        now._table_path = new._table_path
        if new.where("moved").isEmpty():
            return now


def spelling_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = persist(word_counts(documents, id_col=id_col, text_col=text_col))
    near = near_words(words)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    met = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", "form", "form_n")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    summed = every.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    groups = persist(summed.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = followed(groups.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    out = groups.join(roots, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
