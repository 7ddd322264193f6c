"""The source tree of a repository, and the index built from it.

Listing prunes folders, generated paths, other extensions and large files before
any content is read. The walk is the driver's, contents are read by tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.functions.predicates import STATE_DIR
from cairnlake.operators import code, staleness
from cairnlake.sources import store

MAX_FILE_BYTES = 256 * 1024
# Languages by extension, folders and paths that are skipped.
LANGUAGES = {".cjs": "javascript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".mts": "typescript", ".ts": "typescript", ".tsx": "typescript"}
SKIPPED_FOLDERS = {".cache", STATE_DIR, ".git", ".next", ".turbo", "build", "coverage", "dist", "node_modules", "out", "target", "vendor"}
GENERATED = re.compile(r"\.bundle\.[cm]?[jt]sx?$|\.d\.ts$|\.generated\.|\.gen\.|\.min\.[cm]?[jt]s$|\.map$|(^|/)__generated__(/|$)|(^|/)generated(/|$)")


def walk(root: str, max_file_bytes: int = MAX_FILE_BYTES) -> tuple[list[tuple[str, str, int, int]], int]:
    """([(path, language, bytes, mtime in ms)] sorted, number of skipped entries). A skipped folder counts once, a link not at all."""
    found, skipped = [], 0

    def visit(folder: str) -> None:
        nonlocal skipped
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = os.path.relpath(entry.path, root).replace(os.sep, "/")
            if entry.is_symlink():
                continue
            if entry.is_dir():
                if entry.name in SKIPPED_FOLDERS or GENERATED.search(path):
                    skipped += 1
                else:
                    visit(entry.path)
            elif entry.is_file():
                stat, language = entry.stat(), LANGUAGES.get(os.path.splitext(entry.name)[1])
                if language is None or GENERATED.search(path) or stat.st_size > max_file_bytes:
                    skipped += 1
                else:
                    found.append((path, language, stat.st_size, round(stat.st_mtime * 1000)))

    visit(root)
    return found, skipped


def listing(spark: SparkSession, root: str, max_file_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, int]:
    """(rows of ``schemas.LISTING`` with contents, skipped entries); ``root`` must be readable by the tasks."""
    found, skipped = walk(root, max_file_bytes)
    names = spark.createDataFrame(found, "file_path string, language string, size_bytes long, mtime_ms long") if found else spark.createDataFrame([], "file_path string, language string, size_bytes long, mtime_ms long")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[Path(root, p).read_text(errors="replace") for p in frame.file_path])

    return names.mapInPandas(read, schemas.LISTING), skipped


def index_folder(root: str) -> str:
    return str(Path(root) / STATE_DIR / "index")


def build_index(spark: SparkSession, root: str, *, max_file_bytes: int = MAX_FILE_BYTES) -> dict:
    """Scans, parses and stores the index; returns its statistics."""
    rows, skipped = listing(spark, root, max_file_bytes)
    parsed = code.parse_files(rows)
    now = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t").first().t
    store.write_tables(index_folder(root), {"files": parsed.drop("content"), "chunks": code.chunks(parsed)}, {"version": schemas.INDEX_VERSION, "updated_at": now, "max_file_bytes": max_file_bytes, "files_skipped": skipped})
    tables, _ = load_index(spark, root)
    return code.index_stats(tables["files"], tables["chunks"], skipped).first().asDict() | {"updated_at": now}


def load_index(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict] | None:
    """(files and chunks, meta); None if nothing is indexed; ValueError for another version."""
    found = store.read_tables(spark, index_folder(root))
    if found and found[1].get("version") != schemas.INDEX_VERSION:
        raise ValueError(f"index version {found[1].get('version')} is not {schemas.INDEX_VERSION}")
    return found


def clear_index(root: str) -> bool:
    return store.drop_tables(index_folder(root))


def status(spark: SparkSession, root: str) -> dict:
    """Whether the index is there and fresh, and what changed since."""
    found = load_index(spark, root)
    if found is None:
        return {"indexed": False, "fresh": False, "files_indexed": 0, "chunks_indexed": 0, "symbols_indexed": 0, "stale_files": 0, "missing_files": 0, "new_files": 0}
    tables, meta = found
    rows, _ = listing(spark, root, meta["max_file_bytes"])
    now = rows.select("file_path", "size_bytes", "mtime_ms", code.sha256("content").alias("content_hash"))
    stats = code.index_stats(tables["files"], tables["chunks"], meta["files_skipped"]).first().asDict()
    return {"indexed": True, "updated_at": meta["updated_at"]} | stats | staleness.index_status(tables["files"], now).first().asDict()


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(file_path, content) of the given relative paths that exist; null content for what can't be read as a file."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame.file_path:
                place = Path(root, p)
                if "\0" in p or not place.exists():
                    continue
                try:
                    out.append((p, place.read_bytes().decode("utf-8", "replace")))
                except OSError:
                    out.append((p, None))
            yield pd.DataFrame(out, columns=["file_path", "content"]).astype(object)

    from cairnlake.functions.predicates import is_safe_path

    safe = paths.select("file_path").distinct().where(is_safe_path("file_path"))
    return safe.mapInPandas(read, "file_path string, content string")
