"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens and their numbers of
tokens; tier two is a bounded cache in each Python worker that encodes what
the table lacks. A text's count is the sum over its pre-tokens, since byte
level BPE never merges across them. No pre-token is ever shuffled.

Exactness: the split into pre-tokens is done with ``regex``, whose character
classes agree with the library's for all code points below ``FIRST_DOUBTFUL``;
a text with any other character is split by the library's own pre-tokenizer. The
pieces of either split go through both tiers. Strings of added special tokens
inside a text count as one token, the library's default. (Tokenizers that don't
count by pre-tokens, such as sentencepiece models, encode whole texts.)

Nulls and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; texts of any length are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cairnlake.llm.common import as_text, map_batches, pick, sampled

#: Fixed value: the byte-level pattern that the tokenizer's own pre-tokenizer uses.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The first code point that the two libraries class differently.
FIRST_DOUBTFUL = 0x558


class PieceLengths(dict):
    """Pre-token -> number of tokens. Misses are encoded and kept, up to ``limit`` entries."""

    def __init__(self, encode, frequent: dict[str, int], limit: int):
        super().__init__(frequent)
        self.encode, self.frequent, self.limit = encode, frequent, limit + len(frequent)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        n = self[piece] = len(self.encode(piece, add_special_tokens=False).ids)
        return n


def supports_pieces(path: str) -> bool:
    """Whether counts may be summed over pre-tokens: byte-level BPE without normalizer or prefix space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class PieceCounter:
    """Text -> tokens, for a byte-level BPE tokenizer; ``lengths`` holds both tiers."""

    def __init__(self, path: str, frequent: dict[str, int], cache_limit: int):
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.lengths = PieceLengths(library.encode, frequent, cache_limit)
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.find = regex.compile(PATTERN).findall
        self.doubtful = regex.compile(rf"[^\x00-{chr(FIRST_DOUBTFUL - 1)}]").search
        self.own_split = library.pre_tokenizer.pre_tokenize_str

    def pieces(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.own_split(text)] if self.doubtful(text) else self.find(text)

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.special):
            parts = self.at_special.split(text)
            return len(parts) - 1 + sum(map(self.lengths.__getitem__, chain.from_iterable(map(self.pieces, parts))))
        return sum(map(self.lengths.__getitem__, self.pieces(text)))


def counter(path: str, frequent: dict[str, int], cache_limit: int):
    """A function text -> tokens for the tokenizer at ``path``."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text)) if text else 0
    if supports_pieces(path):
        return PieceCounter(path, frequent, cache_limit)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def frequent_pieces(documents: DataFrame, tokenizer_path: str, *, sample_rows: int = 2000, size: int = 30_000) -> dict[str, int]:
    """The warm-up table: the ``size`` most frequent pre-tokens of at most ``sample_rows`` documents.

    It only decides what need not be encoded again, never a count. The counting
    runs in one task and its result is bounded by ``size``.
    """

    def make():
        import regex
        from tokenizers import Tokenizer

        find, library, seen = regex.compile(PATTERN).findall, Tokenizer.from_file(tokenizer_path), Counter()

        def work(batch):
            for text in as_text(batch.column(0)):
                seen.update(find(text))
            top = [p for p, _ in seen.most_common(size)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([len(x.ids) for x in library.encode_batch(top, add_special_tokens=False)], pa.int32())], ["piece", "n"])

        return work

    rows = map_batches(sampled(documents, "id", sample_rows).select("text"), make, "piece string, n int").collect()
    return dict(list({r.piece: r.n for r in rows}.items())[:size])


def token_counts(documents: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cache_limit: int = 300_000, sample_rows: int = 2000, table_size: int = 30_000) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for every row."""
    rows = pick(documents, id=id_col, text=text_col)
    pieces_ok = tokenizer_path.endswith(".json") and supports_pieces(tokenizer_path)
    shared = documents.sparkSession.sparkContext.broadcast(frequent_pieces(rows, tokenizer_path, sample_rows=sample_rows, size=table_size) if pieces_ok else {})

    def make():
        count = counter(tokenizer_path, shared.value, cache_limit)

        def work(batch):
            texts = as_text(batch.column(1))
            tokens = pa.array([count(t) for t in texts], pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), n_bytes, tokens, pc.greater(tokens, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

        return work

    kind = dict(rows.dtypes)["id"]
    return map_batches(rows, make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
