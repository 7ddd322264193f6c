"""A stored inverted index: postings in blocks with maxima, and a BM25 ranking that skips blocks.

Postings are sorted by bucket (a hash of the token), token and document by range
partitions, so that a token of a third of all documents lies in many tasks, and
cut into blocks of ``BLOCK``. A block holds the differences of its document
numbers, term frequencies and lengths, each in as few bytes as it needs, and in
plain columns its first and last document, their number, the largest term
frequency and the least length. Buckets are partitions of the table: a query reads
those of its tokens, and within them the row groups that can hold its tokens.

A ranking looks at the plain columns first. What a block can add to a document's
score is bounded by its maxima, whatever the corpus statistics are now. Some
blocks of the largest bounds are opened; the ``k``-th best of the sums found there
is one that the final k-th best can't be below. Documents are divided into at most
``SPANS`` spans by the longest list's own blocks; a span whose bounds over all
asked tokens don't reach that sum is left out, and so are blocks with no span left.
All other blocks are opened, so the result is the one of a full scan.

Ids are integers, unique and not null. Null texts have no tokens and don't count in
the mean length, but as documents, as in the unstored ranking; an empty corpus or a query without known tokens gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import scoring
from cairnlake.functions.text import query_tokens, tokens
from cairnlake.session import written

BUCKETS, BLOCK = 64, 128
#: Blocks that are opened for the first bound, and spans of documents, at most.
HEADS, SPANS = 256, 4096
#: Sums of doubles in another order differ by less.
SLACK = 1e-9

_BLOCKS = "bucket int, token string, first_doc long, last_doc long, n int, max_tf long, min_length long, docs binary, doc_bytes int, tfs binary, tf_bytes int, lengths binary, length_bytes int"
_SIZES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _packed(values: np.ndarray) -> tuple[bytes, int]:
    """Numbers from 0 in the least of 1, 2, 4 or 8 bytes each."""
    most = int(values.max(initial=0))
    size = next(s for s in _SIZES if most < 1 << (8 * s))
    return values.astype(_SIZES[size]).tobytes(), size


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, _SIZES[size]).astype(np.int64)


def _blocks(postings: DataFrame, block: int) -> DataFrame:
    """Blocks of postings (bucket, token, doc, tf, length) that are sorted within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _BLOCKS.split(", ")])
        held: pa.Table | None = None  # rows of the last block, which may go on

        def made(rows: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
            buckets, words = rows.column("bucket").to_numpy(), rows.column("token").take(pa.array(starts)).to_pylist()
            docs, tfs, lengths = (rows.column(c).to_numpy() for c in ("doc", "tf", "length"))
            out = []
            for word, a, b in zip(words, starts.tolist(), stops.tolist()):
                own = [_packed(np.diff(docs[a:b]).view(np.uint64)), _packed(tfs[a:b]), _packed(lengths[a:b])]
                out.append((buckets[a], word, docs[a], docs[b - 1], b - a, tfs[a:b].max(), lengths[a:b].min(), *[x for pair in own for x in pair]))
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*out))] if out else [pa.array([], f.type) for f in schema], names)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not rows.num_rows:
                continue
            token = rows.column("token").combine_chunks()
            new = np.concatenate([[True], pc.not_equal(token.slice(1), token.slice(0, len(token) - 1)).to_numpy(zero_copy_only=False)])
            heads = np.flatnonzero(new)
            place = np.arange(len(new)) - np.repeat(heads, np.diff(heads, append=len(new)))
            starts = np.flatnonzero(place % block == 0)
            yield made(rows, starts[:-1], starts[1:])
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield made(held, np.array([0]), np.array([held.num_rows]))

    return postings.select("bucket", "token", "doc", "tf", "length").mapInArrow(run, _BLOCKS)


def build(docs: DataFrame, folder: str, *, id_col: str, text: Column | str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Writes the index of ``docs`` to a folder of any file system that Spark can write."""
    narrow = written(docs.select(F.col(id_col).cast("long").alias("doc"), tokens(text).alias("t")))
    every = narrow.select("doc", F.size("t").cast("long").alias("length"), F.explode("t").alias("token"))
    postings = every.groupBy("token", "doc", "length").agg(F.count(F.lit(1)).alias("tf"))  # a document's tokens meet before the shuffle
    postings = postings.withColumn("bucket", F.pmod(F.crc32(F.encode("token", "UTF-8")), F.lit(buckets)).cast("int"))
    _blocks(postings.repartitionByRange("bucket", "token", "doc").sortWithinPartitions("bucket", "token", "doc"), block).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
    narrow.agg(F.count(F.lit(1)).alias("docs"), F.count("t").alias("texts"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("tokens"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/corpus")


class Index:
    """An index in a folder, with its corpus statistics."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.docs, self.texts, self.tokens, self.buckets = spark.read.parquet(f"{folder}/corpus").first()

    def blocks(self, asked: list[str]) -> DataFrame:
        """Blocks of the asked tokens; other buckets aren't read."""
        own = sorted({zlib.crc32(t.encode()) % self.buckets for t in asked})
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.folder}/postings").where(F.col("bucket").isin(own) & F.col("token").isin(asked))

    def frequencies(self, asked: list[str]) -> dict[str, int]:
        return {r.token: r.df for r in self.blocks(asked).groupBy("token").agg(F.sum("n").alias("df")).collect()}

    def _part(self, df: dict[str, int], tf: Column, length: Column) -> Column:
        """What a token adds to a score: of a posting, or at most, of a block's maxima."""
        known = F.create_map(*[F.lit(x) for t, n in df.items() for x in (t, n)])
        return scoring.bm25_term(tf, known[F.col("token")], F.lit(self.docs), length, F.lit(self.tokens / max(1, self.texts)))

    def top_k(self, query: str, k: int, *, slack: float = 0.0) -> DataFrame:
        """(doc, bm25) of the best ``k`` documents and those at most ``slack`` below them; unrounded, in no order."""
        asked = list(dict.fromkeys(query_tokens(query)))
        df = self.frequencies(asked) if asked else {}
        if not df:
            return self.spark.createDataFrame([], "doc long, bm25 double")
        blocks = self.blocks(list(df)).withColumn("bound", self._part(df, F.col("max_tf"), F.col("min_length")))
        heads = blocks.orderBy(F.desc("bound"), "token", "first_doc").limit(HEADS)
        sums = self._scored(heads, df, asked).orderBy(F.desc("bm25")).limit(k).agg(F.min("bm25").alias("least"), F.count(F.lit(1)).alias("n")).first()
        least = sums.least - slack - SLACK if sums.n == k else 0.0
        scored = self._scored(blocks if least <= 0 else self.open_blocks(blocks, df, least), df, asked).where(F.col("bm25") >= least)
        scored = written(scored)
        last = scored.orderBy(F.desc("bm25")).limit(k).agg(F.min("bm25").alias("least")).first().least
        return scored.where(F.col("bm25") >= (last or 0.0) - slack)

    def open_blocks(self, blocks: DataFrame, df: dict[str, int], least: float) -> DataFrame:
        """The blocks (with ``bound``) in which a document may reach ``least``."""
        plain = blocks.select("token", "first_doc", "last_doc", "bound")
        longest = max(df, key=df.get)
        edges = np.unique(plain.where(F.col("token") == longest).agg(F.percentile_approx("first_doc", [i / SPANS for i in range(SPANS)], 10 * SPANS).alias("e")).first().e)

        def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(low=np.searchsorted(edges, f.first_doc, "right"), high=np.searchsorted(edges, f.last_doc, "right"))

        placed = plain.mapInPandas(spans, "token string, first_doc long, last_doc long, bound double, low int, high int")
        placed = written(placed.select("token", "first_doc", "bound", F.explode(F.sequence("low", "high")).alias("span")))
        reach = placed.groupBy("span", "token").agg(F.max("bound").alias("bound")).groupBy("span").agg(F.sum("bound").alias("reach"))
        good = reach.where(F.col("reach") >= least - SLACK).select("span")  # at most SPANS + 1 rows
        left = placed.join(F.broadcast(good), "span", "left_semi").select("token", "first_doc").distinct()
        return blocks.join(left, ["token", "first_doc"], "left_semi")

    def _scored(self, blocks: DataFrame, df: dict[str, int], asked: list[str]) -> DataFrame:
        """(doc, bm25) over the postings of ``blocks``, added up in the order of the query."""

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pydict()
                docs, tfs, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for first, d, ds, t, ts, x, xs in zip(*[rows[c] for c in ("first_doc", "docs", "doc_bytes", "tfs", "tf_bytes", "lengths", "length_bytes")]):
                    docs.append(first + np.concatenate([[0], np.cumsum(_unpacked(d, ds))]))
                    tfs.append(_unpacked(t, ts))
                    lengths.append(_unpacked(x, xs))
                of = pa.array(np.repeat(np.arange(batch.num_rows), np.array([len(x) for x in tfs[1:]], np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("token").take(of), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (docs, tfs, lengths)]], ["token", "doc", "tf", "length"])

        columns = ["token", "first_doc", "docs", "doc_bytes", "tfs", "tf_bytes", "lengths", "length_bytes"]
        found = blocks.select(*columns).mapInArrow(opened, "token string, doc long, tf long, length long").withColumn("part", self._part(df, F.col("tf"), F.col("length")))
        total = F.lit(0.0)
        for t in asked:
            if t in df:
                total = total + F.coalesce(F.sum(F.when(F.col("token") == t, F.col("part"))), F.lit(0.0))
        return found.groupBy("doc").agg(total.alias("bm25"))
