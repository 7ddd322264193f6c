"""Substring join: which texts contain which values, in lower case, by pieces of the values.

Up to ``FEW`` values are broadcast, and nothing but the matches leaves a task. A value
of word characters only, ``LONGEST`` at most, can only occur inside a word (a run of
such characters), so a task looks into each word that it meets once: places where a
value begins, then the lengths of values that begin so. Texts share most of their words,
so a text costs its words and its matches, not its length times the values in question.
Other values go under one piece of ``WIDE`` characters each: of its pieces that which
the fewest values have (shorter values are their own piece). A task cuts each of its
texts into pieces once, and looks only for values whose piece is there.

More than ``FEW`` values go by trigrams:

A value of three characters or more can only occur in a text that holds all its
trigrams, and above all its rarest one. One pass over the texts gives an index of
those of their distinct trigrams that some value has; a value chooses the one that
the fewest texts hold, and only texts with a value to be checked are read again.
Values of one or two characters are found in the same way by the texts' characters
and bigrams. So work follows the texts' length and the pairs that meet, not values
times texts. Up to ``FEW`` trigrams of values are broadcast, so that the other
trigrams of a text don't leave its task; more are joined by a shuffle.

A chosen trigram that very many texts hold (all of a value's trigrams are common)
is dealt to ``SALTS`` places: each text goes to one of them, the value to all.

Null values and texts match nothing, an empty value is in every text that isn't
null, and repeated values count once. Rows of texts may repeat, with one key or
several; each is checked and matches by itself, also those of a null key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import with_values
from cairnlake.session import written

#: A gram of more than so many texts is hot, and its places.
HOT, SALTS = 100_000, 64
FEW, SIZE = 400_000, 3
#: Characters of the pieces of a broadcast value, and of all broadcast values at most.
WIDE, CHARACTERS = 6, 32_000_000
#: A character of a word (in lower case: all but ASCII's signs, ``$`` and ``_`` apart), and the longest value that is looked for by words.
WORDLY, LONGEST = r"[^\x00-\x23\x25-\x2F\x3A-\x5E\x60\x7B-\x7F]", 32
#: First characters by which such a value is found; words that a task remembers, and the longest of them.
HEAD, REMEMBERED, MEMORABLE = 5, 500_000, 64
#: Grams that a task hands on at once.
AT_ONCE = 500_000


def _grams(low: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a value."""

    def made(s: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (size - 1), F.lit(1))), lambda i: F.substr(s, i, F.lit(size))))

    return F.when(F.length(low) >= size, with_values(made, low)).otherwise(F.array().cast("array<string>"))


def _grams_of(texts: DataFrame, sizes: list[int], few) -> DataFrame:
    """(__key, gram): the distinct runs of the ``sizes`` of each text (__key, __low), or those among a broadcast few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(out, pa.string())], ["__key", "gram"])  # noqa: B023

            for i in range(batch.num_rows):
                low = batch.column(1)[i].as_py()
                own = {low[at : at + n] for n in sizes for at in range(len(low) - n + 1)}
                own = own & few.value if few else own
                of += [i] * len(own)
                out += own
                if len(out) > AT_ONCE:
                    yield made()
                    of, out = [], []
            yield made()

    return texts.mapInArrow(run, f"__key {dict(texts.dtypes)['__key']}, gram string")


def _in_words(lows: list[tuple[int, str]]) -> Callable[[str], set[int]]:
    """A function from a text to the numbers of the values (number, value in lower case, of word characters) in it."""
    numbers: dict[str, list[int]] = {}
    for i, low in lows:
        numbers.setdefault(low, []).append(i)
    begun: dict[int, dict[str, set[int]]] = {}
    for low in numbers:
        begun.setdefault(min(len(low), HEAD), {}).setdefault(low[:HEAD], set()).add(len(low))
    words, seen = re.compile(f"{WORDLY}{{{min(map(len, numbers), default=1)},}}"), {}  # shorter words hold no value

    def look(word: str) -> tuple[int, ...]:
        found = set()
        for n, lengths in begun.items():
            for at in range(len(word) - n + 1):
                for size in lengths.get(word[at : at + n], ()):
                    found.update(numbers.get(word[at : at + size], ()))
        return tuple(found)

    def values(low: str) -> set[int]:
        own = set()
        for word in set(words.findall(low)) if numbers else ():
            found = seen.get(word)
            if found is None:
                found = look(word)
                if len(word) <= MEMORABLE:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = found
            if found:
                own.update(found)
        return own

    return values


def _scanned(asked: DataFrame, texts: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of texts with each of a bounded number of values (value, low), none of them empty."""
    wordly = F.col("low").rlike(f"\\A{WORDLY}{{1,{LONGEST}}}\\z")
    piece = asked.where(~wordly).select("value", "low", F.explode(F.when(F.length("low") >= WIDE, _grams(F.col("low"), WIDE)).otherwise(F.array("low"))).alias("gram"))
    shared = piece.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = piece.join(shared, "gram").groupBy("value").agg(F.min(F.struct("n", "gram", "low")).alias("g")).select("value", "g.gram", "g.low")
    every = chosen.union(asked.where(wordly).select("value", F.lit(None).cast("string"), "low"))
    held = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in every.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lows = pa.array([v for v, _, _ in held.value], pa.string()), [x for _, _, x in held.value]
        in_words = _in_words([(i, low) for i, (_, gram, low) in enumerate(held.value) if gram is None])
        by_size: dict[int, dict[str, list[int]]] = {}
        for i, (_, gram, _) in enumerate(held.value):
            if gram is not None:
                by_size.setdefault(len(gram), {}).setdefault(gram, []).append(i)
        wanted = {n: frozenset(x) for n, x in by_size.items()}
        for batch in batches:
            of, out = [], []

            def made() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(len(keep))], names.take(pa.array(out, pa.int64()))], [*keep, "value"])  # noqa: B023

            for i in range(batch.num_rows):
                low = batch.column(len(keep))[i].as_py()
                own = list(in_words(low))
                for n, of_gram in by_size.items():
                    for gram in {low[at : at + n] for at in range(len(low) - n + 1)} & wanted[n]:
                        own += of_gram[gram] if n < WIDE else [v for v in of_gram[gram] if lows[v] in low]
                of += [i] * len(own)
                out += own
                if len(out) > AT_ONCE:
                    yield made()
                    of, out = [], []
            yield made()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    return texts.select(*keep, F.lower(text).alias("__low")).where("__low IS NOT NULL").mapInArrow(run, f"{schema}, value string")


def containing(values: DataFrame, texts: DataFrame, *, text: Column, key: str, keep: list[str] | None = None) -> DataFrame:
    """``texts`` with each ``value`` (of the column of that name) that they contain in lower case, a row each.

    ``key`` is a column that tells texts apart; ``keep`` names the columns that are wanted, all by default.
    """
    keep = keep or texts.columns
    asked = values.select("value").where("value IS NOT NULL").distinct().withColumn("low", F.lower("value")).withColumn("size", F.least(F.length("low"), F.lit(SIZE)))
    own = F.when(F.col("size") >= SIZE, _grams(F.col("low"), SIZE)).otherwise(F.array("low"))
    asked = written(asked.select("value", "low", "size", own.alias("grams")))
    found = texts.where(text.isNotNull()).select(*keep).join(F.broadcast(asked.where("size = 0").select("value").limit(1)), how="cross")  # at most one row a text
    counts = {r.size: (r.n, r.characters) for r in asked.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("low")).alias("characters")).collect()}
    sizes = sorted(n for n in counts if n > 0)
    if not sizes:
        return found
    if sum(n for n, _ in counts.values()) <= FEW and sum(c for _, c in counts.values()) <= CHARACTERS:
        met = _scanned(asked.where("size > 0").select("value", "low"), texts, text, keep)
        return met.union(found) if 0 in counts else met
    wanted = asked.where("size > 0").select(F.explode("grams").alias("gram")).distinct()
    low, few = F.lower(text), None
    if wanted.count() <= FEW:
        few = texts.sparkSession.sparkContext.broadcast(frozenset(r.gram for r in wanted.collect()))
    every = _grams_of(texts.select(F.col(key).alias("__key"), low.alias("__low")).where("__low IS NOT NULL"), sizes, few)
    held = written((every if few else every.join(wanted, "gram", "left_semi")).distinct())
    counted = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = asked.where("size > 0").select("value", F.explode("grams").alias("gram")).join(counted, "gram", "left")
    rarest = each.groupBy("value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    chosen = written(rarest.select("value", "g.gram", "g.n").where("n > 0"))  # a gram that no text holds ends its value
    places = chosen.withColumn("salt", F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    grams = chosen.select("gram", (F.col("n") > HOT).alias("hot")).distinct()
    dealt = held.join(grams, "gram").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int")).otherwise(0))
    pairs = dealt.join(places, ["gram", "salt"]).select("__key", "value")
    met = texts.join(pairs, texts[key].eqNullSafe(F.col("__key")))
    return met.where(low.contains(F.lower("value"))).select(*[texts[c] for c in keep], "value").union(found)
