"""Secret scans: fixed patterns, then character Markov models.

Base findings come from three patterns (an assignment to a telling name, an
access key, a long hexadecimal run). The method adds further spans: every run
of ``MIN_RUN`` or more token characters outside the base findings, with a letter
in it (a bare number is no secret), is scored by two order-1 character Markov
models, one of random strings and one of ordinary identifiers; where the mean
log-likelihood ratio for random reaches a threshold, the run is a finding of
kind ``markov``. A run that a base finding cuts is judged in its parts.

Both models are trained from labelled samples. Ordinary: identifiers of the
standard library (snake, camel and constant case, joined to paths), and the words of
all documents in the same styles. Random: the values that the base patterns found,
and seeded strings over common alphabets. A class that has no sample of a
transition falls back on kinds of characters. The counts over the corpus are
2 x 67 x 67 numbers a task whatever the input. The threshold has the fewest errors
on a fifth of the labelled identifiers and on random strings that trained nothing.

Null or empty texts have no findings; overlapping kinds are all reported; spans
that begin at the same place go by kind. Repeated rows are scanned each, very
long texts whole, in one pass; an empty table trains on the fixed samples and
gives an empty result. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import functools
import importlib
import random
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import as_text, map_batches, pick, sha256_hex

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
#: Token characters of the models; all others share one symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
SYMBOLS = len(ALPHABET) + 1
MIN_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=]{{{MIN_RUN},}}")
LETTER = re.compile("[A-Za-z]")
#: Ordinary samples from the corpus: words too short to be candidates themselves.
WORD = re.compile(rf"(?<![A-Za-z0-9+/_=])[A-Za-z]{{2,{MIN_RUN - 1}}}(?![A-Za-z0-9+/_=])")
#: Modules whose public names are the labelled identifiers.
MODULES = "argparse ast asyncio calendar codecs collections configparser csv ctypes datetime decimal email.message errno functools http.client importlib.util inspect itertools json locale logging mailbox os pathlib pickle re shutil signal smtplib socket sqlite3 ssl string subprocess tarfile tempfile threading tokenize typing unittest urllib.request xml.sax zipfile".split()
#: Weights of a class's two sources, and of the fallback on kinds of characters.
IDENTIFIERS, CORPUS_WORDS, SEEDED, BASE_VALUES, KINDS_SHARE = 0.5, 0.5, 0.75, 0.25, 0.1

_CODE = np.full(256, SYMBOLS - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Places of lower-case letters, capitals, digits, the bar, the slash, and the rest.
_KINDS = [list(range(26)), list(range(26, 52)), list(range(52, 62)), [ALPHABET.index("_")], [ALPHABET.index("/")], [ALPHABET.index("+"), ALPHABET.index("="), SYMBOLS - 1]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def codes(run: str) -> np.ndarray:
    return _CODE[np.frombuffer(run.encode("latin-1", "replace"), np.uint8)]


def add_counts(counts: np.ndarray, label: int, runs: Counter[str]) -> None:
    """Adds the transitions inside each run, as often as the run occurs."""
    if not runs:
        return
    x = codes("".join(runs))
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    inside = np.ones(len(x), bool)
    inside[np.cumsum(lengths)[lengths > 0] - 1] = False  # the last character of a run leads nowhere
    at = np.flatnonzero(inside)
    np.add.at(counts[label].reshape(-1), x[at] * SYMBOLS + x[at + 1], np.repeat(np.fromiter(runs.values(), np.int64, len(runs)), lengths)[at])


def random_strings(n: int = 2000, seed: int = 7, lengths: tuple[int, int] = (16, 48)) -> list[str]:
    """Labelled random samples over common secret alphabets."""
    rng = random.Random(seed)
    alphabets = (ALPHABET[:62], ALPHABET[:62] + "_", "0123456789ABCDEF", "0123456789abcdef", ALPHABET[26:62], ALPHABET[:36] + "0123456789", ALPHABET[:64])
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(*lengths))) for i in range(n)]


@functools.cache
def identifiers() -> tuple[str, ...]:
    """Labelled ordinary samples: public names of ``MODULES`` and of their classes, and such names joined in each style."""
    found = set()
    for name in MODULES:
        module = importlib.import_module(name)
        for x in dir(module):
            found |= {x, *(dir(getattr(module, x)) if isinstance(getattr(module, x), type) else ())}
    names = sorted(x for x in found if not x.startswith("_") and len(x) > 3)
    words = sorted({w.lower() for x in names for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{2,}", x)})
    rng = random.Random(11)
    styles = ("_".join, lambda p: p[0] + "".join(w.title() for w in p[1:]), lambda p: "".join(w.title() for w in p), lambda p: "_".join(p).upper(), "/".join, lambda p: "_".join(p) + str(rng.randint(1, 64)))
    return (*names, *(styles[i % len(styles)](rng.choices(words, k=rng.randint(2, 4))) for i in range(6000)))


def reserved(sample: str) -> bool:
    """Whether a labelled sample is kept for the threshold."""
    return zlib.crc32(sample.encode()) % 5 == 0


def _conditional(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(next | this), whether there is a sample of this)."""
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.maximum(total, 1), total > 0


def _blend(parts: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """log of the weighted conditionals of the sources that know a character, and of the kinds of characters."""
    mixed, weight = np.zeros((SYMBOLS, SYMBOLS)), np.zeros((SYMBOLS, 1))
    for counts, share in parts:
        p, known = _conditional(counts)
        mixed += np.where(known, share * p, 0)
        weight += np.where(known, share, 0)
    member = np.zeros((len(_KINDS), SYMBOLS))
    for i, kind in enumerate(_KINDS):
        member[i, kind] = 1
    every = sum(counts / max(1, counts.sum()) * share for counts, share in parts)
    kinds = member @ every @ member.T + 1e-3
    back = member.T @ (kinds / kinds.sum(axis=1, keepdims=True)) @ (member / member.sum(axis=1, keepdims=True))
    return np.log(np.where(weight > 0, (1 - KINDS_SHARE) * mixed / np.maximum(weight, 1e-9) + KINDS_SHARE * back, back))


def in_styles(words: np.ndarray) -> np.ndarray:
    """Transitions of words, each counted as ``_word_``, in snake, constant and camel case and in paths."""
    low, up, bar, slash = slice(0, 26), slice(26, 52), ALPHABET.index("_"), ALPHABET.index("/")
    lower = words[low, low] + words[up, up] + words[up, low]
    first, last = words[bar, low] + words[bar, up], words[low, bar] + words[up, bar]
    out = np.zeros((SYMBOLS, SYMBOLS))
    for letters in (low, up):
        out[letters, letters] += lower
        out[letters, bar] += last
        out[bar, letters] += first
    out[low, slash] += last
    out[slash, low] += first
    total = max(1, first.sum())
    out[low, up] += np.outer(last, first) / total  # camel case: the next word begins
    out[up, low] += first[:, None] * _conditional(lower)[0]
    return out


class Models(NamedTuple):
    """log P(next | this, random) - log P(next | this, ordinary), and the least mean of a random run."""

    ratios: np.ndarray
    least: float

    def mean(self, run: str) -> float:
        x = codes(run)
        return float(self.ratios[x[:-1], x[1:]].mean())

    def is_random(self, run: str) -> bool:
        return self.mean(run) >= self.least


def models(counts: np.ndarray) -> Models:
    """From the corpus' transitions [words, base values] and the fixed labelled samples."""
    fixed = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
    ordinary, chance = identifiers(), random_strings()
    add_counts(fixed, 0, Counter(x for x in ordinary if not reserved(x)))
    add_counts(fixed, 1, Counter(x for x in chance if not reserved(x)))
    ratios = _blend([(fixed[1], SEEDED), (counts[1], BASE_VALUES)]) - _blend([(fixed[0], IDENTIFIERS), (in_styles(counts[0]), CORPUS_WORDS)])
    scored = Models(ratios, 0.0)
    low, high = (np.sort([scored.mean(x) for x in xs if reserved(x) and len(x) >= MIN_RUN]) for xs in (ordinary, chance))
    places = np.sort(np.concatenate([low, high]))
    cuts = (places[1:] + places[:-1]) / 2
    errors = (len(low) - np.searchsorted(low, cuts)) / len(low) + np.searchsorted(high, cuts) / len(high)
    best = np.flatnonzero(errors == errors.min())
    return Models(ratios, float(cuts[best].mean()))


def sample_counts(texts: list[str]) -> np.ndarray:
    """Transition counts [words, base values] of ``texts``; a word counts with a bar before and after it."""
    words, values = Counter(), Counter()
    for text in texts:
        end = 0
        for start, _, stop in base_spans(text):
            words.update(WORD.findall(text[end:start]))
            values[re.split(r"[\s:=\"']", text[start:stop])[-1]] += 1
            end = max(end, stop)
        words.update(WORD.findall(text[end:] if end else text))
    counts = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
    add_counts(counts, 0, Counter({f"_{w}_": n for w, n in words.items()}))
    add_counts(counts, 1, values)
    return counts


def train(documents: DataFrame, *, text_col: str = "text") -> Models:
    """The models, from all documents; counted on the executors and summed there by transition."""
    rows = pick(documents, text=text_col)

    def make():
        def work(batch):
            counts = sample_counts(as_text(batch.column(0))).reshape(-1)
            at = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["at", "n"])

        return work

    counts = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
    for row in map_batches(rows, make, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts.reshape(-1)[row["at"]] = row.n
    return models(counts)


def find_spans(text: str, trained: Models) -> list[tuple[int, int, int]]:
    """Base spans and those that the models add outside them."""
    found = base_spans(text)
    more, i, end = [], 0, 0  # end: of the base spans that begin before the place looked at
    for m in RUN.finditer(text):
        at, stop = m.span()
        while at < stop:
            while i < len(found) and found[i][0] <= at:
                end = max(end, found[i][2])
                i += 1
            at = max(at, end)
            cut = min(stop, found[i][0]) if i < len(found) else stop
            piece = text[at:cut]
            if len(piece) >= MIN_RUN and LETTER.search(piece) and trained.is_random(piece):
                more.append((at, 3, cut))
            at = max(cut, at + 1)
    return sorted(found + more) if more else found


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trained: Models | None = None) -> DataFrame:
    """``id_col`` and findings array<struct<kind, start, end>> of every row."""
    rows = pick(documents, id=id_col, text=text_col)
    trained = trained or train(rows)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(batch):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, trained)] for t in as_text(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_col, "findings"])

        return work

    return map_batches(rows, make, f"`{id_col}` {dict(rows.dtypes)['id']}, findings array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings as counts of the base kinds, a digest of the base spans and all spans in one string."""
    found = scan(documents, id_col=id_col, text_col=text_col)

    def make():
        def work(batch):
            out = []
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["kind"] != "markov"]
                said = lambda xs: [f"{x['kind']}:{x['start']}:{x['end']}" for x in xs]
                out.append((*[sum(s["kind"] == k for s in base) for k in KINDS[:3]], sha256_hex(said(base)), ",".join(said(spans))))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return work

    return map_batches(found, make, f"`{id_col}` {dict(found.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, *, text_col: str = "text", trained: Models | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``documents`` with every finding replaced by ``mask``; null texts stay null, other columns untouched."""
    trained = trained or train(documents, text_col=text_col)
    columns, place = documents.columns, documents.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for start, _, stop in find_spans(text, trained):
            if stop > end:
                if start >= end:
                    out += [text[end:start], mask]
                end = stop
        return "".join(out) + text[end:] if out else text

    def make():
        def work(batch):
            texts = pa.array([clean(t) for t in batch.column(place).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], columns)

        return work

    return map_batches(documents, make, documents.schema)
