"""Toxicity: a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first
three, four and five letters. Filters of several widths slide over the whole
text, each keeps its largest activation (max pooling), and a logistic unit gives
the score. Thresholds are calibrated for each language on all labelled rows
outside the held-out fold that the fit didn't see, scored on the executors; the
score itself never sees language, source or id.

The fit uses at most ``per_class`` labelled rows of each class, picked by a hash
of the id, and of these in hash order those that fit into ``sample_chars`` characters:
a text that doesn't fit any more is left out, and the ones after it are tried
(documented bounds). It runs in one task on an executor; only weights and
thresholds reach the driver, never a text. Scoring covers every row and whole
texts. Applying a filter is a sum of rows of
a table (word vector times filter slice), which each worker keeps for the words
it meets, in a bounded cache.

Null and empty texts are scored as the empty text. Rows without a label, or with
a null one, train nothing; with no labelled rows of both classes every score is
0. Labelled texts of both classes of which one has no text within the bound are an
error, never a silent lack of a model. Repeated rows are scored each; ties in the fit's sample are broken by id. An
empty table of documents gives an empty result and 0 for all scores.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import as_text, bit_map, give_back, has_bit, map_batches, persist, pick, release

LETTERS = re.compile(r"[^\W\d_]+")
WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 8, 16, 1 << 16
EPOCHS, BATCH, RATE, PENALTY = 6, 32, 0.02, 1e-4
SEED = 11
DENSE = ("slices", "bias", "out", "base")
#: Rows of a language needed for a threshold of its own, and the threshold of the others.
LEAST_ROWS, DEFAULT_THRESHOLD = 30, 0.5
#: Steps of the score in a language's histogram, a power of two.
BINS = 1 << 12
#: Size of the bit map of labelled ids: 2 MB.
LABEL_BITS = 1 << 24


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def word_hashes(word: str) -> tuple[int, int, int, int]:
    crc, most = zlib.crc32, BUCKETS - 1
    b = word.encode("utf-8", "surrogatepass")
    three, four, five = (b[:3], b[:4], b[:5]) if len(b) == len(word) else (word[:n].encode("utf-8", "surrogatepass") for n in (3, 4, 5))
    return 1 + crc(b) % most, 1 + crc(b"3" + three) % most, 1 + crc(b"4" + four) % most, 1 + crc(b"5" + five) % most


class Model:
    """Embeddings (bucket 0 is the padding, always zero), filter slices, biases and the output unit."""

    def __init__(self, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(SEED)
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.slices = rng.normal(0, 0.3, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def state(self) -> dict[str, np.ndarray]:
        return dict(vars(self))

    @classmethod
    def of(cls, state: dict[str, np.ndarray]) -> Model:
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def pooled(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest activations, their places) from ``parts``: words x slices x filters, padded to the widest filter."""
        best, places, first = [], [], 0
        for i, width in enumerate(WIDTHS):
            n = len(parts) - width + 1
            acts = parts[:n, first].copy()
            for j in range(1, width):
                acts += parts[j : j + n, first + j]
            at = acts.argmax(axis=0)
            best.append(np.maximum(acts[at, np.arange(FILTERS)] + self.bias[i], 0))
            places.append(at)
            first += width
        return np.concatenate(best), np.concatenate(places)

    def score(self, pooled: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base[0], -30, 30))))


def encoded(text: str, cache: dict[str, tuple[int, int, int, int]]) -> np.ndarray:
    """Hashes of the words, padded so that the widest filter fits."""
    rows = []
    for word in LETTERS.findall(text.lower()):
        if word not in cache:
            cache[word] = word_hashes(word)
        rows.append(cache[word])
    rows += [(0, 0, 0, 0)] * (max(WIDTHS) - len(rows))
    return np.array(rows, np.int32)


def gradients(model: Model, docs: list[np.ndarray], labels: list[int], share: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of the log loss, each document counting ``share``: (by dense parameter, rows of the embeddings, their gradients)."""
    grads = {k: np.zeros_like(getattr(model, k)) for k in DENSE}
    touched: list[tuple[np.ndarray, np.ndarray]] = []
    filters = model.slices.transpose(1, 0, 2).reshape(DIM, -1)
    for doc, label in zip(docs, labels):
        vectors = model.embed[doc].sum(axis=1)
        pooled, places = model.pooled((vectors @ filters).reshape(len(vectors), -1, FILTERS))
        delta = (model.score(pooled) - label) * share
        grads["out"] += delta * pooled
        grads["base"] += delta
        back = np.where(pooled > 0, delta * model.out, 0).astype(np.float32)
        first = 0
        for i, width in enumerate(WIDTHS):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            grads["bias"][i] += back[own]
            for j in range(width):  # only the pooled places pass gradients on
                words = places[own] + j
                grads["slices"][first + j] += vectors[words].T * back[own]
                touched.append((doc[words], (model.slices[first + j] * back[own]).T))
            first += width
    rows, back_to = np.unique(np.concatenate([w.ravel() for w, _ in touched]), return_inverse=True)
    of_rows = np.zeros((len(rows), DIM), np.float32)
    np.add.at(of_rows, back_to, np.concatenate([np.repeat(x, 4, axis=0) for _, x in touched]))
    return grads, rows, of_rows


def fit(docs: list[np.ndarray], labels: list[int], *, epochs: int = EPOCHS) -> Model:
    """Adam over mini-batches."""
    rng = np.random.default_rng(SEED)
    model = Model(rng)
    first_m = {k: np.zeros_like(v) for k, v in vars(model).items()}
    second_m = {k: np.zeros_like(v) for k, v in vars(model).items()}
    t = 0

    def move(name: str, at, g: np.ndarray) -> None:
        first_m[name][at] += 0.1 * (g - first_m[name][at])
        second_m[name][at] += 0.001 * (g * g - second_m[name][at])
        getattr(model, name)[at] -= RATE * first_m[name][at] / (1 - 0.9**t) / (np.sqrt(second_m[name][at] / (1 - 0.999**t)) + 1e-8)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            t += 1
            chosen = order[at : at + BATCH]
            grads, rows, of_rows = gradients(model, [docs[d] for d in chosen], [labels[d] for d in chosen], 1 / BATCH)
            for k in DENSE:
                move(k, ..., grads[k] + PENALTY * getattr(model, k))
            move("embed", rows, of_rows)
            model.embed[0] = 0
    return model


class Scorer:
    """Scores texts; keeps for each word its product with all filter slices.

    A word's product is the sum of those of its hashes, which are made once for
    all buckets, so a word that isn't kept costs four rows of a table; the new
    words of a text are looked up together.
    """

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.of_hash = model.embed @ model.slices.transpose(1, 0, 2).reshape(DIM, -1)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.new: list[str] = []
        self.rows = np.zeros((4096, self.of_hash.shape[1]), np.float32)

    def find(self, word: str) -> int:
        i = self.place[word] = len(self.place) + 1  # row 0 is the padding
        self.new.append(word)
        return i

    def fill(self) -> None:
        """Rows of the new words."""
        stop = len(self.place) + 1
        while stop > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        first = stop - len(self.new)
        for at in range(0, len(self.new), 4096):
            own = [self.of_hash[h] for h in np.array([word_hashes(w) for w in self.new[at : at + 4096]]).T]
            self.rows[first + at : first + at + len(own[0])] = own[0] + own[1] + own[2] + own[3]
        self.new = []

    def __call__(self, text: str) -> float:
        if len(self.place) > self.limit:
            self.reset()
        get, find = self.place.get, self.find
        ids = [get(w) or find(w) for w in LETTERS.findall(text.lower())]
        if self.new:
            self.fill()
        ids += [0] * (max(WIDTHS) - len(ids))
        return self.model.score(self.model.pooled(self.rows.take(ids, axis=0).reshape(len(ids), -1, FILTERS))[0])


def best_threshold(counts: np.ndarray) -> float:
    """The threshold of fewest errors from the rows [clean, toxic] in each bin of the score.

    Of several it is the middle of the widest gap that no score lies in.
    """
    clean, toxic = counts
    errors = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    best = np.flatnonzero(errors == errors.min())
    joined = (np.diff(best) == 1) & (counts.sum(axis=0)[best[:-1]] == 0)
    gaps = np.split(best, np.flatnonzero(~joined) + 1)
    widest = max(gaps, key=len)
    return float(widest[0] + widest[-1]) / 2 / BINS


def calibrate(documents: DataFrame, marks: DataFrame, model: Model) -> dict[str, float]:
    """Thresholds by language from all rows (id, text, lang) that ``marks`` (id, y) labels.

    A broadcast bit map of fixed size keeps most other texts from being scored,
    and only ids, languages and scores are shuffled.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(LABEL_BITS)).alias("bit")
    shared = documents.sparkSession.sparkContext.broadcast((model.state(), bit_map(marks.select(bit), LABEL_BITS)))

    def make():
        state, bits = shared.value
        score = Scorer(Model.of(state))

        def work(batch):
            at = batch.column(3).to_numpy()
            batch = batch.filter(pa.array(has_bit(bits, at)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([min(BINS - 1, int(score(t) * BINS)) for t in as_text(batch.column(1))], pa.int32())], ["id", "lang", "bin"])

        return work

    scored = map_batches(documents.select("id", "text", F.coalesce("lang", F.lit("")).alias("lang"), bit), make, f"id {dict(documents.dtypes)['id']}, lang string, bin int")
    counted = persist(scored.join(marks, "id").groupBy("lang", "bin", "y").agg(F.count(F.lit(1)).alias("n")))  # at most 2 * BINS rows a language
    rows_of = counted.groupBy("lang").agg(F.sum("n").alias("n"), F.count_distinct("y").alias("ys")).where((F.col("n") >= LEAST_ROWS) & (F.col("ys") == 2)).select("lang")

    def threshold(part):
        counts = np.zeros((2, BINS), np.int64)
        np.add.at(counts, (part.y.to_numpy(), part.bin.to_numpy()), part.n.to_numpy())
        return part.head(1)[["lang"]].assign(threshold=best_threshold(counts))

    # histograms stay on the executors; the driver gets one number for each language with enough labelled rows
    found = counted.join(rows_of, "lang").groupBy("lang").applyInPandas(threshold, "lang string, threshold double")
    thresholds = {r.lang: r.threshold for r in found.collect()}
    release(counted)
    return dict(sorted(thresholds.items()))


def fitted(rows: DataFrame, sample_chars: int) -> tuple[Model | None, int]:
    """The model of those ``rows`` (id, text, y) that fit into ``sample_chars`` characters, fitted in one task on an executor, and the number of classes among all rows."""

    def run(batches):
        cache: dict = {}
        docs, labels, left, seen = [], [], sample_chars, set()
        for batch in batches:
            for text, y in zip(as_text(batch.column(0)), batch.column(1).to_pylist()):
                seen.add(y)
                if len(text) <= left:
                    left -= len(text)
                    docs.append(encoded(text, cache))
                    labels.append(y)
        state = fit(docs, labels).state() if len(set(labels)) == 2 else {}
        state["classes seen"] = np.zeros(len(seen), np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(state, pa.string()), pa.array([list(v.shape) for v in state.values()], pa.list_(pa.int32())), pa.array([v.tobytes() for v in state.values()], pa.binary())],
            ["name", "shape", "data"],
        )
        del docs, cache
        give_back()

    in_order = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "y").select("text", "y")
    state = {r.name: np.frombuffer(r.data, np.float32).reshape(r["shape"]) for r in in_order.mapInArrow(run, "name string, shape array<int>, data binary").collect()}
    seen = len(state.pop("classes seen", ()))
    return Model.of(state) if state else None, seen


def in_fit(id_col: Column) -> Column:
    """Four fifths of the drawn rows fit the model, the others are left to the thresholds."""
    return F.pmod(F.crc32(F.concat(F.lit("c"), id_col.cast("string")).cast("binary")), F.lit(5)) != 0


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 2500, sample_chars: int = 40_000_000) -> tuple[Model | None, dict[str, float]]:
    """(model, thresholds by language): a fit on at most ``per_class`` labelled rows of each class outside the held-out fold, thresholds from all others.

    The ids are drawn from the labels first, so only their texts leave their
    executors and no join shuffles the documents. A fifth of the drawn rows is
    left to the thresholds, so that a small corpus has some too.
    """
    marks = pick(labels, id=label_id_col, y=label_col).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None, {}
    draws = [marks.where(F.col("y") == y).where(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(np.ceil(1200 * per_class / max(per_class, counts[y])))).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    every = draws[0].union(draws[1])  # at most 2 * per_class rows
    rows = pick(documents, id=id_col, text=text_col, lang=lang_col)
    for drawn in (every.where(in_fit(F.col("id"))), every):  # few labels of a class may all be among those left to the thresholds
        model, seen = fitted(rows.join(F.broadcast(drawn), "id").select("id", "text", "y"), sample_chars)
        if model:
            break
    if model is None:
        if seen == 2:
            raise ValueError(f"no labelled text of one of the classes fits into sample_chars = {sample_chars}")
        return None, {}
    return model, calibrate(rows, marks.join(F.broadcast(drawn.select("id")), "id", "left_anti"), model)


def toxicity(documents: DataFrame, model: Model | None, thresholds: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, score, and rejected (score at or above its language's threshold) for every row."""
    rows = pick(documents, id=id_col, text=text_col, lang=lang_col)
    shared = documents.sparkSession.sparkContext.broadcast(model and model.state())

    def make():
        score = Scorer(Model.of(shared.value)) if shared.value else lambda text: 0.0

        def work(batch):
            scores = [score(t) for t in as_text(batch.column(1))]
            rejected = [s >= thresholds.get(lang or "", DEFAULT_THRESHOLD) for s, lang in zip(scores, batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, "score", "rejected"])

        return work

    return map_batches(rows, make, f"`{id_col}` {dict(rows.dtypes)['id']}, score double, rejected boolean")


def remove_toxic(documents: DataFrame, model: Model | None, thresholds: dict[str, float], *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``documents`` without the rejected rows; map-only."""
    text_at, lang_at, columns = documents.columns.index(text_col), documents.columns.index(lang_col), documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(model and model.state())

    def make():
        score = Scorer(Model.of(shared.value)) if shared.value else lambda text: 0.0

        def work(batch):
            keep = [score(t) < thresholds.get(lang or "", DEFAULT_THRESHOLD) for t, lang in zip(as_text(batch.column(text_at)), batch.column(lang_at).to_pylist())]
            keep = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], columns)

        return work

    return map_batches(documents, make, documents.schema)
