"""Quality rules: measures of each text, and lines that many documents of a host share.

Cross-document line frequency: lines are normalised (trimmed, A-Z as a-z, digits
as 0, white space single), hashed, and the distinct documents that hold them are
counted for each host. A line in more than ``line_docs`` documents of its host,
however large the host, is removed; a document of which less than ``least_left``
of the words stay is depleted and rejected. Copies of a text under several ids
are several documents, so the lines of a text that a host has more than
``line_docs`` times go. A document also fails on its base measures: fewer than
10 words, or more than 20 % of its words in repeated windows of five.

Rows are counted first, which is an upper bound, and documents only for the lines
that pass it. Null texts count as empty: no words, so they fail. A null host is a
host of its own. Rows may repeat; each gets its result, and rows with one id are
one document (those with a null id one each). Very long texts are read whole, by
one task each. An empty table gives an empty result. All statistics cover all
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import as_text, map_batches, persist, pick

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20



def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space; bytes.split() knows no other."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of five that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    key = ids[:n]
    for i in range(1, window):  # ranks stay below n, so the pairs fit in 64 bits
        _, key = np.unique(key * (len(place) + 1) + ids[i : i + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def duplicate_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def normalised(words: list[bytes]) -> bytes:
    return b" ".join(words).translate(_FOLD)


def measures(text: str) -> tuple[int, int, int, int, int]:
    words = words_of(text)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text.split("\n")), repeated_words(words)


def base_measures(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures, and each text's lines as (hash, words) pairs in ``lines``."""
    rows = pick(documents, id=id_col, text=text_col, host=host_col)

    def make():
        from xxhash import xxh64_intdigest

        def work(batch):
            out, lines = [], []
            for text in as_text(batch.column(1)):
                out.append(measures(text))
                counted: dict[int, int] = {}
                for line in text.split("\n"):
                    if words := words_of(line):
                        h = xxh64_intdigest(normalised(words)) - 2**63
                        counted[h] = counted.get(h, 0) + len(words)
                lines.append([{"line": h, "n": n} for h, n in counted.items()])
            columns = list(zip(*out)) or [[]] * 5
            kind = pa.list_(pa.struct([("line", pa.int64()), ("n", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in columns], pa.array(lines, kind)], ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

        return work

    kinds = dict(rows.dtypes)
    return map_batches(rows, make, f"id {kinds['id']}, host {kinds['host']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:bigint,n:bigint>>")


def quality_rules(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = 20, least_left: float = 0.3) -> DataFrame:
    """``id_col``, the measures, n_words_left, base_failed and kept of every row."""
    rows = persist(base_measures(documents, id_col=id_col, text_col=text_col, host_col=host_col).withColumn("row", F.monotonically_increasing_id()))
    doc = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.concat(F.lit("#"), F.col("row").cast("string")))
    parts = rows.select("row", "host", doc.alias("doc"), F.explode("lines").alias("x")).select("row", "host", "doc", "x.line", "x.n")
    often = parts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > line_docs).select(F.col("host").alias("h"), F.col("line").alias("l"))
    of_line = F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))
    parts = persist(parts.join(often, of_line).drop("h", "l"))
    common = parts.groupBy("host", "line").agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") > line_docs).select(F.col("host").alias("h"), F.col("line").alias("l"))
    lost = parts.join(common, of_line).groupBy("row").agg(F.sum("n").alias("lost"))
    out = rows.drop("lines").join(lost, "row", "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", left.alias("n_words_left"), failed.alias("base_failed"), (~failed & (left >= F.lit(least_left) * F.col("n_words"))).alias("kept"))
