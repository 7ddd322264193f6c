"""An index of source files that is refreshed by what changed, on any file system that Spark reads.

Files and chunks lie in buckets by a hash of the path. A state is a small JSON
file that names, for each bucket, the version that holds it, and the index's
statistics; states are numbered, and the one of the highest number counts. A
refresh compares sizes and times of the listing with the stored ones, reads and
parses the contents of new and changed files only, rewrites the buckets of files
that are new, changed or gone, and takes all other buckets over as they are. The
statistics follow by difference: minus what the rewritten files had, plus what
they have. One file that changed costs one bucket, whatever the size of the index.

Writers claim the next number by creating a file that must not exist, so of two at
a time one fails and changes nothing. Versions that the last ``keep`` states name
stay, so readers of the state before go on while a new one is written.

Paths are unique and not null. A file whose size and time are the stored ones is
taken as unchanged. An empty listing empties the index; without a stored state
every file is new.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.operators import code

BUCKETS, KEEP = 64, 2
TABLES = {"files": schemas.FILES, "chunks": schemas.CHUNKS}
STATISTICS = ("files_indexed", "chunks_indexed", "symbols_indexed", "bytes_indexed")
NOTHING = {"number": 0, "buckets": BUCKETS, "versions": {}, "statistics": dict.fromkeys(STATISTICS, 0)}


class _Folder:
    """Small files in a folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark._jvm, folder
        self.path = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self.files = self.path(".").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, start: str) -> list[str]:
        if not self.files.exists(self.path(".")):
            return []
        return sorted(n for s in self.files.listStatus(self.path(".")) if (n := s.getPath().getName()).startswith(start))

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one of the name."""
        stream = self.files.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def _states(folder: _Folder) -> list[dict]:
    """The stored states that are written to the end, newest first."""
    out = []
    for name in reversed(folder.names("state-")):
        try:
            out.append(json.loads(folder.read(name)))
        except ValueError:  # its writer is at work or has died
            continue
    return out


def state(spark: SparkSession, folder: str) -> dict:
    """number, buckets, versions (bucket: version) and statistics of the newest state."""
    return next(iter(_states(_Folder(spark, folder))), NOTHING)


def load(spark: SparkSession, folder: str, at: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a state (the newest)."""
    at = at or state(spark, folder)
    return {t: _table(spark, folder, at, t, list(at["versions"])) for t in TABLES}


def _table(spark: SparkSession, folder: str, at: dict, name: str, buckets: list[str]) -> DataFrame:
    paths = [f"{folder}/{at['versions'][b]}/{name}/bucket={b}" for b in buckets]
    return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])


def _bucket(path: str, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _measured(files: DataFrame, chunks: DataFrame) -> dict[str, int]:
    row = code.index_stats(files, chunks, 0).first()
    return {s: row[s] for s in STATISTICS}


def changes(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_path, change) of the files that are added, changed or removed; by size and time, no content is read."""
    old = stored.select("file_path", F.struct("size_bytes", "mtime_ms").alias("old"))
    both = old.join(listing.select("file_path", F.struct("size_bytes", "mtime_ms").alias("new")), "file_path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("file_path", kind.alias("change")).where("change IS NOT NULL")


def refresh(spark: SparkSession, folder: str, listing: DataFrame, contents: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS, keep: int = KEEP) -> dict:
    """Brings the index up to ``listing`` (file_path, language, size_bytes, mtime_ms); the new state, or the old one if nothing changed.

    ``contents`` gives rows of the listing their column ``content``; it is called with
    those of new and changed files only.
    """
    place = _Folder(spark, folder)
    before = state(spark, folder)
    n = before["buckets"] if before["number"] else buckets
    old = load(spark, folder, before)
    version = f"version-{uuid.uuid4().hex}"
    changes(old["files"], listing).withColumn("bucket", _bucket("file_path", n)).write.parquet(f"{folder}/{version}/changes")
    moved = spark.read.parquet(f"{folder}/{version}/changes")
    touched = [str(r.bucket) for r in moved.select("bucket").distinct().orderBy("bucket").collect()]  # at most the number of buckets
    if not touched:
        place.delete(version)
        return before
    fresh = contents(listing.join(moved.where("change <> 'removed'").select("file_path"), "file_path", "left_semi"))
    code.parse_files(fresh).write.parquet(f"{folder}/{version}/parsed")
    parsed = spark.read.parquet(f"{folder}/{version}/parsed")
    new = {"files": parsed.drop("content"), "chunks": code.chunks(parsed)}
    hit = {t: _table(spark, folder, before, t, [b for b in touched if b in before["versions"]]) for t in TABLES}
    for t, columns in ((t, df.columns) for t, df in old.items()):
        kept = hit[t].join(moved, "file_path", "left_anti")
        whole = kept.select(*columns).unionByName(new[t].select(*columns)).withColumn("bucket", _bucket("file_path", n))
        whole.repartition(min(n, len(touched)), "bucket").sortWithinPartitions("bucket", "file_path").write.partitionBy("bucket").parquet(f"{folder}/{version}/{t}")
    written = {t: spark.read.schema(TABLES[t]).parquet(*[p]) for t in TABLES if (p := f"{folder}/{version}/{t}")}
    gone = _measured(*[hit[t].join(moved, "file_path", "left_semi") for t in TABLES])
    come = _measured(*[written[t].join(moved, "file_path", "left_semi") for t in TABLES])
    full = {s.getPath().getName().split("=")[1] for s in place.files.listStatus(place.path(f"{version}/files")) if "bucket=" in s.getPath().getName()}
    versions = {b: v for b, v in before["versions"].items() if b not in touched} | {b: version for b in touched if b in full}
    after = {"number": before["number"] + 1, "buckets": n, "versions": versions, "statistics": {s: before["statistics"][s] - gone[s] + come[s] for s in STATISTICS}}
    for scrap in ("changes", "parsed"):
        place.delete(f"{version}/{scrap}")
    place.create(f"state-{after['number']:012d}", json.dumps(after))
    _clean(place, keep)
    return after


def _clean(place: _Folder, keep: int) -> None:
    """Deletes states but the last ``keep``, and versions older than these that none of them names."""
    known = _states(place)
    named = {v for s in known[:keep] for v in s["versions"].values()}
    for s in known[keep:]:
        for v in set(s["versions"].values()) - named:
            place.delete(v)
        place.delete(f"state-{s['number']:012d}")
