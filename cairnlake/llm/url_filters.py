"""URL filters: path rules first, then a weighted vocabulary found with Aho-Corasick.

The vocabulary has strict terms (one is enough to reject) and soft terms
(several distinct ones are). A hit counts only between boundaries, that is, if
no ASCII letter or digit adjoins it. Rules of the form ``host/path`` fit the
host and all its subdomains if the url's path begins with theirs; the longest
wins and overrides the vocabulary.

A null url, or one without ``://``, has an empty host and path and no rule;
the vocabulary is still looked up in what there is (null: nothing, so allow).
Of rules of one length that fit, the last by code point wins; an overlap of terms
counts each. Repeated rows are judged each; urls of any length are read whole; an
empty table gives an empty result. The defaults below are a small vocabulary for
tests and the registered query: ``vocabulary`` reads a real one from a table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlake.llm.common import LOWER, UPPER, map_batches, pick

#: Terms, lower case. One strict term rejects a url.
STRICT = ("casino", "cheap-pills", "hentai", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
#: Soft terms; SOFT_LIMIT distinct ones reject a url.
SOFT = ("adult", "bet", "bonus", "cheap", "click", "deal", "farm", "free", "loan", "pills", "poker", "prize", "promo", "spam", "win")
SOFT_LIMIT = 2
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_PARTS = re.compile(r".*?://([^/?#]*)([^?#]*)", re.S)
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def vocabulary(terms: DataFrame, *, term_col: str = "term", strict_col: str = "strict", most: int = 1_000_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict terms, soft terms) of a table, lower-cased; a term that is both is strict, null and empty ones are left out.

    The automaton goes to every task, so more than ``most`` terms are an error.
    """
    rows = pick(terms, term=term_col, strict=strict_col).where("term != ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} terms")
    strict = {r.term.translate(_ASCII_LOWER) for r in rows if r.strict}
    return tuple(sorted(strict)), tuple(sorted({r.term.translate(_ASCII_LOWER) for r in rows} - strict))


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _PARTS.match(url or "")
    return (found[1].translate(_ASCII_LOWER), found[2]) if found else ("", "")


def matching_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: (len(x[0]), x[0]), default=None)


def term_hits(automaton, text: str) -> tuple[int, int]:
    """Distinct strict and soft terms in ``text`` between boundaries."""
    word = lambda c: c.isascii() and c.isalnum()
    strict, soft = set(), set()
    if not len(automaton):
        return 0, 0
    for end, (term, is_strict) in automaton.iter(text):
        begin = end - len(term) + 1
        if (begin == 0 or not word(text[begin - 1])) and (end + 1 == len(text) or not word(text[end + 1])):
            (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def build_automaton(strict, soft):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in soft:
        automaton.add_word(term, (term, False))
    for term in strict:
        automaton.add_word(term, (term, True))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, rules=RULES) -> DataFrame:
    """``id_col``, host, path, rule, verdict, n_strict, n_soft of every row; map-only."""
    rows = pick(pages, id=id_col, url=url_col)

    def make():
        automaton = build_automaton(strict, soft)

        def work(batch):
            out = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                rule = matching_rule(host, path, rules)
                n_strict, n_soft = term_hits(automaton, (url or "").translate(_ASCII_LOWER))
                verdict = rule[1] if rule else "block" if n_strict or n_soft >= soft_limit else "allow"
                out.append((host, path, rule and rule[0], verdict, n_strict, n_soft))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, "host", "path", "rule", "verdict", "n_strict", "n_soft"])

        return work

    return map_batches(rows, make, f"`{id_col}` {dict(rows.dtypes)['id']}, host string, path string, rule string, verdict string, n_strict long, n_soft long")
