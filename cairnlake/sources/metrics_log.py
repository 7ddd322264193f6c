"""The activity log: turns are appended, rollups are replaced by week. Telemetry never breaks a query."""

from __future__ import annotations

import logging
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.functions.predicates import STATE_DIR
from cairnlake.operators import rollup
from cairnlake.sources import store
from cairnlake.sources.lock import locked

OPT_OUT = "CAIRNLAKE_TELEMETRY"


def is_disabled() -> bool:
    return os.environ.get(OPT_OUT, "").lower() in ("0", "false", "off", "no")


def folder(root: str) -> str:
    return str(Path(root) / STATE_DIR / "metrics")


def writing(root: str):
    """The lock on the log, held while it is loaded, changed and saved."""
    return locked(Path(folder(root)) / store.POINTER)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """Turns and rollups; None if telemetry is off."""
    if is_disabled():
        return None
    found = store.read_tables(spark, folder(root))
    if found is None:
        return {"turns": spark.createDataFrame([], schemas.TURNS), "rollups": spark.createDataFrame([], schemas.ROLLUPS)}
    if found[1].get("version") != schemas.METRICS_VERSION:
        raise ValueError("metrics of another version")
    return found[0]


def save(root: str, tables: dict[str, DataFrame]) -> None:
    newest = rollup.newest_turns(tables["turns"], order=[F.desc("ts")])
    store.write_tables(folder(root), {"turns": newest, "rollups": tables["rollups"]}, {"version": schemas.METRICS_VERSION})


def record_turn(spark: SparkSession, root: str, turn: dict) -> bool:
    """Appends a turn; failures are logged and swallowed."""
    try:
        with writing(root):
            tables = load(spark, root)
            if tables is None:
                return False
            save(root, tables | {"turns": tables["turns"].unionByName(spark.createDataFrame([turn], schemas.TURNS))})
        return True
    except Exception:
        logging.getLogger(__name__).warning("the turn was not recorded", exc_info=True)
        return False
