"""Language identification by multilingual mixture inference.

For each language a character n-gram model (trigrams within words, with word
ends) gives the likelihood of a word. A document is a mixture of languages:
expectation-maximisation estimates the proportions over its words. The set of
languages is then chosen by penalised likelihood: the strongest language alone
is compared with the two strongest, and so on, and a language stays if it
raises the log-likelihood by more than ``PENALTY * log(words)``.

Counts for training come from all grams of all rows with a language (of the
training folds), added up on the executors. Grams are hashed to ``BUCKETS``
places. The model is a table of places by languages of at most ``ENTRIES`` numbers,
whatever the number of languages: if there are more places than fit (from nine
languages on), those stay whose share in any language is largest, and each
language's mass in the others is spread over them evenly, as the likelihood of a
place outside the table. So the driver and each broadcast have a proven bound
(tens of MB). The languages are counted first; more than ``MOST_LANGS`` are an error.

The prediction is the language of the largest share in the chosen set; the score
is how sure the words are of it: the mean over the words of its posterior among
all languages at equal odds.

A letter is a character of Unicode category L. A null text, or one without a
letter, gives ``und`` with score 0. With no labelled rows every text gives
``und``. Ties go to the language first in code point order. Repeated rows are
judged each; very long texts are judged whole; an empty table gives an empty
result. Words are judged in groups whose rows times languages are bounded, but a
document's distinct words together.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import as_text, map_batches, persist, pick, release

#: Numerals such as fractions and letter numbers, which \\w and not \\d have.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: Words: runs of letters. Runs of Latin-1 letters, told apart faster, come first.
LETTERS = re.compile(rf"[a-zß-öø-ÿ]++(?![^\W\d_{_NUMERALS}])|[^\W\d_{_NUMERALS}]+")
PENALTY = 1.0
STEPS = 12
UNKNOWN = "und"
BUCKETS, MOST_LANGS = 1 << 20, 1000
#: Numbers in the model's table, and in a worker's cache of word likelihoods.
ENTRIES, CACHED = 8 << 20, 1_600_000


def grams(word: str) -> list[int]:
    """The places of the word's trigrams."""
    padded = f"^{word}$"
    return [zlib.crc32(padded[i : i + 3].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(padded) - 2)]


def fold(id_col: Column, folds: int, *, held: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; null ids don't."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram (its place), n over all rows (text, lang): counted in each task, then summed."""

    def make():
        def work(batch):
            words: dict[str, Counter] = {}
            for text, lang in zip(as_text(batch.column(0)), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            out: dict[tuple[str, int], int] = {}
            for lang, counts in words.items():
                for word, n in counts.items():
                    for gram in grams(word):
                        out[lang, gram] = out.get((lang, gram), 0) + n
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), pa.int64())], ["lang", "gram", "n"])

        return work

    return map_batches(rows, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages, the row of each place in ``logs`` (the last row: no such gram), and log P(gram | language)."""

    langs: list[str]
    row_of: np.ndarray
    logs: np.ndarray


def build_model(names: list[str], langs: np.ndarray, places: np.ndarray, counts: np.ndarray, totals: np.ndarray, outside: int = 0) -> Model:
    """From the counts of each (number of a language, place) in the table, the count of all grams of each language, and how many used places aren't in the table."""
    used, at = np.unique(places, return_inverse=True)
    table = np.zeros((len(used) + 1, len(names)), np.float32)
    table[at, langs] = counts
    table += 0.5
    if outside:  # each of the others has an even part of the mass that isn't in the table
        table[-1] += (totals - np.bincount(langs, counts, len(names))) / outside
    row_of = np.full(BUCKETS, len(used), np.int32)
    row_of[used] = np.arange(len(used))
    every = totals + 0.5 * (len(used) + 1 + outside)
    np.log(table, out=table)
    table -= np.log(every).astype(np.float32)
    return Model(names, row_of, table)


class WordLikelihoods:
    """Rows of log P(word | language); a bounded cache that is filled for many words at once."""

    def __init__(self, model: Model, limit: int = CACHED):
        self.model, self.limit = model, limit // max(1, model.logs.shape[1])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, self.model.logs.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.limit:
            self.clear()
        place = self.place
        if fresh := [w for w in dict.fromkeys(words) if w not in place]:
            place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
            ids = self.model.row_of[np.array([g for w in fresh for g in grams(w)], np.int64)]
            lengths = np.array([len(w) for w in fresh], np.int64)  # a word of n letters has n grams
            added = np.add.reduceat(self.model.logs[ids], np.cumsum(lengths) - lengths, axis=0)
            self.rows = np.concatenate([self.rows, added])
        return self.rows[[place[w] for w in words]]


def mixtures(logs: np.ndarray, times: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Proportions for each document, the chosen languages, and the words' mean posterior of each language.

    ``logs`` has a row for each distinct word of a document and ``times`` how
    often it occurs there; ``starts`` has the first row of each document (none
    is empty).
    """
    docs, k = len(starts), logs.shape[1]
    top = logs.max(axis=1)
    like = np.exp(logs - top[:, None])
    rows_of = np.diff(np.append(starts, len(logs)))
    words = np.add.reduceat(times, starts)

    def fit(which: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """EM on the documents ``which`` over their ``allowed`` languages: (shares, log-likelihoods)."""
        rows = np.concatenate([np.arange(starts[d], starts[d] + rows_of[d]) for d in which]) if len(which) < docs else slice(None)
        n = rows_of[which]
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(which)), n)
        own, weight = like[rows], times[rows]
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(steps):
            part = own * share[owner]
            part *= (weight / np.maximum(part.sum(axis=1), 1e-30))[:, None]
            share = np.add.reduceat(part, first, axis=0) / words[which, None]
        fitness = np.log(np.maximum((own * share[owner]).sum(axis=1), 1e-30)) + top[rows]
        return share, np.add.reduceat(fitness * weight, first)

    every = np.arange(docs)
    full, _ = fit(every, np.ones((docs, k), np.float32), STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros((docs, k), np.float32)
    chosen[every, order[:, 0]] = 1
    share, best = fit(every, chosen, 1)
    growing = every
    for size in range(1, k):
        growing = growing[full[growing, order[growing, size]] * words[growing] > 1]
        if not len(growing):
            break
        wider = chosen[growing]
        wider[np.arange(len(growing)), order[growing, size]] = 1
        more, fitness = fit(growing, wider, STEPS)
        better = fitness - best[growing] > PENALTY * np.log(words[growing] + 1)
        growing, wider, more, fitness = growing[better], wider[better], more[better], fitness[better]
        chosen[growing], share[growing], best[growing] = wider, more, fitness
    posterior = like / like.sum(axis=1, keepdims=True)
    sure = np.add.reduceat(posterior * times[:, None], starts, axis=0) / words[:, None]
    return share, [np.flatnonzero(c) for c in chosen], sure


def train(training: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    learned = pick(training, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = persist(gram_counts(learned))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(totals) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    names = sorted(totals)
    known = F.broadcast(training.sparkSession.createDataFrame([(k, i, totals[k]) for i, k in enumerate(names)], "lang string, number int, total long"))
    used = counts.select("gram").distinct().count()
    rows = ENTRIES // max(1, len(names))
    kept = counts
    if used > rows:
        share = F.max(F.col("n") / F.col("total"))
        best = counts.join(known, "lang").groupBy("gram").agg(share.alias("share")).orderBy(F.desc("share"), "gram").limit(rows).select("gram")
        kept = counts.join(F.broadcast(best), "gram", "left_semi")  # at most BUCKETS numbers
    table = kept.join(known, "lang").select(F.col("number").cast("short").alias("number"), F.col("gram").cast("int").alias("gram"), F.col("n").cast("double").alias("n")).toArrow()  # at most ENTRIES rows
    model = build_model(names, *(table.column(c).to_numpy() for c in ("number", "gram", "n")), np.array([totals[k] for k in names], np.float64), max(0, used - rows))
    release(counts)
    return model


def language_id(documents: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words_at_once: int = 60_000) -> DataFrame:
    """``id_col``, lang_pred, score and langs (the chosen set, by share) of every row of ``documents``."""
    rows = pick(documents, id=id_col, text=text_col)
    shared = documents.sparkSession.sparkContext.broadcast(train(training, text_col=text_col, lang_col=lang_col))

    def make():
        model = shared.value
        langs, cache = model.langs, WordLikelihoods(model)
        at_once = max(1, min(words_at_once, words_at_once * 8 // max(1, len(langs))))  # a row of words has a number for each language

        def judge(docs: list[Counter], out: list, at: list[int]) -> None:
            starts = np.cumsum([0, *[len(d) for d in docs[:-1]]])
            times = np.array([n for d in docs for n in d.values()], np.float32)
            share, sets, sure = mixtures(cache.of([w for d in docs for w in d]), times, starts)
            for i, s, chosen, p in zip(at, share, sets, sure):
                ranked = sorted(chosen, key=lambda j: (-s[j], j))
                out[i] = (langs[ranked[0]], min(1.0, float(p[ranked[0]])), [langs[j] for j in ranked])

        def work(batch):
            texts = as_text(batch.column(1))
            out: list = [(UNKNOWN, 0.0, [])] * len(texts)
            docs, at, n = [], [], 0
            for i, text in enumerate(texts if langs else []):
                words = Counter(LETTERS.findall(text.lower()))
                if words:
                    docs.append(words)
                    at.append(i)
                    n += len(words)
                    if n > at_once:
                        judge(docs, out, at)
                        docs, at, n = [], [], 0
            if docs:
                judge(docs, out, at)
            columns = list(zip(*out)) or [[]] * 3
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, "lang_pred", "score", "langs"])

        return work

    return map_batches(rows, make, f"`{id_col}` {dict(rows.dtypes)['id']}, lang_pred string, score double, langs array<string>")
