"""Predicates over paths, questions, timestamps and rows of the graph."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions.text import col, iso_timestamp
from cairnlake.schemas import NODE_KINDS, NODE_STATUSES

#: The folder of the engine's own state inside a repository.
STATE_DIR = ".cairnlake"
# Patterns of paths and words.
TEST_PATH = r"(^|/)(test|tests|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$"
DOC_PATH = r"\.(md|mdx|rst|txt)$|^docs/|^tasks/"
SOURCE_PATH = r"\.[cm]?[jt]sx?$"
IGNORED_PATH = r"(^|/)(\.git|\.cairnlake|node_modules|dist|coverage)(/|$)"
DECISION_WORDS = r"\b(decid\w*|choice|approach|design|architecture|tradeoff|implement\w*|refactor\w*|review)\b"
INVARIANT_WORDS = r"\b(invariant|contract|must|guarantee|behavior|reject|require|should|test)\b"
GOTCHA_WORDS = r"\b(bug|fix\w*|failure|fail\w*|stale|warning|gotcha|regression|edge case|review|misleading|silent)\b"
CODE_SHAPES = (r"[./\\]", r"[a-z0-9_$][A-Z][A-Za-z0-9_$]*", r"[$]", r"^[A-Za-z_$][A-Za-z0-9$]*(?:_[A-Za-z0-9$]+){2,}$", r"\(\)$")
MAX_SKEW_MINUTES = 5
#: Defaults of parameters: paths that hold plans, and documents at the top of a repository.
PLAN_PATH = r"(^|/)(README|ROADMAP|package\.json|tasks/)"
TOP_DOCS = ("README.md", "CONTRIBUTING.md", "CHANGELOG.md", "ROADMAP.md")


def is_test(path: Column | str) -> Column:
    return col(path).rlike(TEST_PATH)


def is_doc(path: Column | str) -> Column:
    return col(path).rlike(DOC_PATH)


def is_source(path: Column | str) -> Column:
    return col(path).rlike(SOURCE_PATH)


def is_ignored(path: Column | str) -> Column:
    return col(path).rlike(IGNORED_PATH)


def is_generated_artifact(path: Column | str) -> Column:
    return col(path).startswith(f"{STATE_DIR}/index/") | col(path).startswith(f"{STATE_DIR}/skills/")


def is_safe_path(path: Column | str) -> Column:
    """Relative, not blank, without NUL and without a '..' step."""
    p = col(path)
    return (F.regexp_replace(p, r"\s", "") != "") & ~p.startswith("/") & ~p.contains("\0") & ~F.array_contains(F.split(p, r"[\\/]+"), "..")


def asks_for_code(question: str) -> bool:
    """Whether a question names a file or symbol, so that impact is worth showing."""
    return any(re.search(shape, word) for word in question.split() for shape in CODE_SHAPES)


def asks_for_code_col(question: Column | str) -> Column:
    return F.exists(F.split(col(question), r"\s+"), lambda word: F.greatest(*[word.rlike(s) for s in CODE_SHAPES]))


def _bounded(pattern: str) -> str:
    r"""A pattern in ``\b`` with bounds of what ``\w`` is: before release 19 Java's ``\b`` counts the letters of all alphabets as well."""
    return r"(?<!\w)" + pattern.removeprefix(r"\b").removesuffix(r"\b") + r"(?!\w)"


def mentions_decision(text: Column | str) -> Column:
    return F.lower(col(text)).rlike(_bounded(DECISION_WORDS))


def mentions_invariant(text: Column | str) -> Column:
    return F.lower(col(text)).rlike(_bounded(INVARIANT_WORDS))


def mentions_gotcha(text: Column | str) -> Column:
    return F.lower(col(text)).rlike(_bounded(GOTCHA_WORDS))


def is_valid_timestamp(text: Column | str, now: Column) -> Column:
    """Zulu shape, a real date, and at most five minutes ahead of ``now``."""
    ts = iso_timestamp(text)
    return F.coalesce(ts <= now + F.expr(f"INTERVAL {MAX_SKEW_MINUTES} MINUTES"), F.lit(False))


def is_valid_anchor(anchor: Column) -> Column:
    lines = anchor["line_range"]
    ranged = (F.size(lines) == 2) & (F.get(lines, F.lit(0)) >= 1) & (F.get(lines, F.lit(0)) <= F.get(lines, F.lit(1)))
    hashed = anchor["content_hash"].startswith("sha256:") & (anchor["range_hash"].isNull() | anchor["range_hash"].startswith("sha256:"))
    return F.coalesce((anchor["file_path"] != "") & ranged & hashed, F.lit(False))


def is_valid_node(node: Column, node_id: Column) -> Column:
    """The schema of a stored node: closed domains, confidence in [0, 1], anchors, timestamp."""
    known = (node_id != "") & ~node_id.contains("|") & (node["name"] != "") & node["kind"].isin(*NODE_KINDS) & F.coalesce(node["status"], F.lit("active")).isin(*NODE_STATUSES)
    filled = node["summary"].isNotNull() & node["tags"].isNotNull() & node["sources"].isNotNull() & node["confidence"].between(0.0, 1.0) & iso_timestamp(node["last_verified_at"]).isNotNull()
    return F.coalesce(known & filled & F.forall(node["sources"], is_valid_anchor), F.lit(False))
