"""Column builders for text: tokens, lines, snippets, hashes, rounding. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNCATED = "\n// ... truncated"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_values(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of lambda variables that hold ``values``.

    A column named inside a lambda is resolved as an alias of the same select, if
    there is one of its name. Builders whose lambdas need a column take it in here.
    """
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(held, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


# --- tokens ---------------------------------------------------------------


def tokens(c: Column | str) -> Column:
    """Source tokens: camel case split, lower case, runs of [a-z0-9_$], longer than one; repeats stay."""
    parts = F.split(F.lower(F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9_$]+")
    return F.filter(parts, lambda t: F.length(t) > 1)


def long_tokens(texts: DataFrame, c: Column | str, least: int) -> DataFrame:
    """(s): the distinct tokens of ``least`` characters or more, two at least, of a column of texts.

    Such a token lies inside a run of as many characters that a token's come from
    (U+0130 and U+212A have ASCII letters in their lower case), so only these runs
    are tokenised, each distinct one once.
    """
    runs = texts.select(F.explode(F.regexp_extract_all(col(c), F.lit(f"[A-Za-z0-9_$\\x{{130}}\\x{{212A}}]{{{least},}}"), F.lit(0))).alias("run")).distinct()
    return runs.select(F.explode(tokens("run")).alias("s")).where(F.length("s") >= least).distinct()


def query_tokens(query: str) -> list[str]:
    """The same tokens of a query, as constants."""
    spread = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query).lower()
    return [t for t in re.split(r"[^a-z0-9_$]+", spread) if len(t) > 1]


def graph_tokens(question: str) -> list[str]:
    """Tokens of a graph question: lower case, split at white space; repeats count again."""
    return question.lower().split()


def graph_tokens_col(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda t: t != "")


def bigrams(c: Column | str) -> Column:
    """Distinct two-character substrings in lower case; none for fewer than two characters."""

    def made(low: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(2)))
        return F.when(F.length(low) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    return with_values(made, F.lower(col(c)))


def chunk_document(file_path="file_path", chunk_type="chunk_type", symbols="symbols", imports="imports", exports="exports", content="content") -> Column:
    """The text of a chunk that is tokenised: path, type, symbols, imports, exports, content."""
    return F.concat_ws(
        "\n",
        col(file_path),
        col(chunk_type),
        F.array_join(F.transform(col(symbols), lambda s: F.concat_ws(" ", s["kind"], s["name"])), " "),
        F.array_join(F.transform(col(imports), lambda i: i["module"]), " "),
        F.array_join(col(exports), " "),
        col(content),
    )


# --- lines and ranges -------------------------------------------------------


def lines(c: Column | str) -> Column:
    return F.split(col(c), r"\r?\n", -1)


def line_range(c: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start to end (from 1, inclusive) joined by newlines; what lies outside is left out."""
    return F.array_join(F.slice(lines(c), F.greatest(col(start), F.lit(1)).cast("int"), F.greatest(col(end) - F.greatest(col(start), F.lit(1)) + 1, F.lit(0)).cast("int")), "\n")


def n_lines(c: Column | str) -> Column:
    """Lines as split gives them: an empty text has one."""
    return F.size(lines(c))


def n_lines_trimmed(c: Column | str) -> Column:
    """Lines without an empty last one, one at least."""
    n = n_lines(c)
    return F.greatest(n - F.when(F.element_at(lines(c), -1) == "", 1).otherwise(0), F.lit(1))


def trim_all(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def trim_end(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+$", "")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(trim_all(c), r"\s+", " ")


# --- snippets and previews ----------------------------------------------------


def snippet(c: Column | str, needle: str, *, before: int = 24, after: int = 56, fallback: int = 80) -> Column:
    """The surroundings of the first occurrence of ``needle`` (lower case), or the head of the text."""
    text = col(c)
    at = F.instr(F.lower(text), needle)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + len(needle) + after - start)).otherwise(F.substring(text, 1, fallback))


def preview(c: Column | str, most: int) -> Column:
    text = col(c)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(TRUNCATED)))


# --- hashes, paths and numbers -------------------------------------------------


def sha256(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(c), 256))


def range_hash(c: Column | str, start: Column | str, end: Column | str) -> Column:
    return sha256(line_range(c, start, end))


def rounded(c: Column | str, places: int = 4) -> Column:
    """Half up on the double: floor(x * 10^n + 0.5) / 10^n."""
    by = float(10**places)
    return F.floor(col(c) * F.lit(by) + F.lit(0.5)) / F.lit(by)


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def stem(c: Column | str) -> Column:
    """Lower-case file name without its last extension."""
    return F.lower(F.regexp_replace(basename(c), r"\.[^.]+$", ""))


def dirname(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"/?[^/]*$", "")


def first_segment(c: Column | str) -> Column:
    return F.when(col(c).contains("/"), F.substring_index(col(c), "/", 1)).otherwise(F.lit("."))


def normalized(c: Column | str) -> Column:
    """A relative path without '.' and '..' steps; steps that leave the root stay in front."""
    start = F.array().cast("array<string>")

    def step(out: Column, part: Column) -> Column:
        up = (F.size(out) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), out), -1) != "..")
        return F.when((part == "") | (part == "."), out).when((part == "..") & up, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))

    return F.aggregate(F.split(col(c), "/"), start, step, lambda out: F.array_join(out, "/"))


def iso_timestamp(c: Column | str) -> Column:
    """Zulu timestamps with or without seconds; others are null."""
    text = col(c)
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$")
    return F.when(shape, F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX"))))
