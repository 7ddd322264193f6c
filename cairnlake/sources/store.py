"""Versioned Parquet snapshots: a table is a folder of versions and a pointer to the current one."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cairnlake.sources.lock import locked

#: The pointer, and the mark of a version that was current: others may still be being written.
POINTER, DONE = "CURRENT", "_WHOLE"


def write_tables(folder: str, tables: dict[str, DataFrame], meta: dict | None = None) -> None:
    """Writes all tables as a new version, then moves the pointer; readers see one whole version."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    with locked(Path(folder) / POINTER):
        draft = Path(folder) / f"{POINTER}.{version}"
        draft.write_text(json.dumps({"version": version, "meta": meta or {}}))
        os.replace(draft, Path(folder) / POINTER)
        for old in Path(folder).iterdir():
            if old.is_dir() and old.name != version and (old / DONE).exists():
                shutil.rmtree(old, ignore_errors=True)
        (Path(folder) / version / DONE).touch()


def read_tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict] | None:
    """(tables, meta) of the current version; None if there is none."""
    pointer = Path(folder) / POINTER
    if not pointer.exists():
        return None
    said = json.loads(pointer.read_text())
    place = Path(folder) / said["version"]
    return {p.name: spark.read.parquet(str(p)) for p in sorted(place.iterdir()) if p.is_dir()}, said["meta"]


def drop_tables(folder: str) -> bool:
    """Removes the store; whether there was one."""
    there = Path(folder).exists()
    shutil.rmtree(folder, ignore_errors=True)
    return there
