"""Shared pieces of the text operators: word splitting, batch mapping, checkpoints.

Every operator selects the columns it works on by name first, so further
columns of its input, whatever they are called, never clash with its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python form of a word: a run without space, tab and line ends.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of an Arrow batch that are worked on at once.
SLICE = 8 << 20
#: Spark's bound on the bytes of a batch on its way to Python, and what it is set to: a batch and its last row make one slice.
BATCH_BYTES, SENT = "spark.sql.execution.arrow.maxBytesPerBatch", SLICE * 7 // 8
#: Bits of a part of a bit map.
PART = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function built once for each task, over batches of about ``SLICE`` bytes.

    ``make`` runs on the executor, so that tokenizers and automata are built
    there and never shipped. Arrow batches larger than ``SLICE`` are worked on
    slice by slice, and a worker that has ended its task gives its memory back, as
    idle workers stay alive beside busy ones. A session that names no bound for
    the bytes of a batch gets ``SENT``: Spark's own bounds let a task's whole
    partition into one batch, which the JVM and the worker then hold at once. No
    other setting is read or changed.
    """
    session = df.sparkSession
    if session.conf.get(BATCH_BYTES, None) is None:
        session.conf.set(BATCH_BYTES, str(SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            step = max(1, int(batch.num_rows * min(1, SLICE / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                yield work(batch.slice(at, step))
        work = batch = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def persist(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared checkpoint folder and reads it from there.

    The folder is the one that the session names in ``spark.checkpoint.dir``.
    Where it names none, a local master (tests, a laptop) gets a temporary one,
    and any other is an error, as executors share no such folder. Tasks that are
    lost read the table again instead of all that led to it. ``release`` deletes
    a table that nothing reads any more, the end of the driver's JVM the others.
    """
    session = df.sparkSession
    path = f"{checkpoint_folder(session)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trimmed(session)
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = session.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


#: Least seconds between two collections of garbage by the driver, and the time of the last.
COLLECT_EVERY, _collected = 1.0, [0.0]


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that ``persist`` wrote, after their last reader has run, and what Spark keeps for their plans.

    Spark deletes the shuffle files of a plan once the driver has collected it as
    garbage, which an operator of many small plans would put off for long; so the
    driver collects garbage here, which also gives its memory back.
    """
    session = None
    for df in tables:
        if path := getattr(df, "_table_path", None):
            session = df.sparkSession
            place = session._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)
    if session and time.monotonic() - _collected[0] > COLLECT_EVERY:
        gc.collect()
        session._jvm.System.gc()
        trimmed(session)
        _collected[0] = time.monotonic()


def trimmed(session: SparkSession) -> str | None:
    """Has the driver's JVM return freed native memory to the system; what it says, or None where it can't (no HotSpot, no glibc).

    Plans with many exchanges come with threads, compiled code and buffers outside
    the heap; the C library keeps what they free, and over many plans that adds up.
    """
    jvm = session._jvm
    try:
        server, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = session.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        return invoke.invoke(server, args)
    except Py4JError:
        return None


def checkpoint_folder(session: SparkSession) -> str:
    if folder := session.conf.get("spark.checkpoint.dir", None):
        return folder
    master = session.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, spread over the input by a hash of ``key``, the same ones on every run.

    Only for fitting: a tokenizer's warm-up table or a classifier.
    """
    share = max(1, df.count() // max(1, rows))
    spot = F.xxhash64(key)
    return df.where(F.pmod(spot, F.lit(share)) == 0).orderBy(spot, key).limit(rows)


def bit_map(places: DataFrame, size: int) -> np.ndarray:
    """Packed bits of fixed ``size``, set at the numbers below it in the only column of ``places``.

    The numbers are dealt by the part of the map that they lie in, so that any
    number of tasks fill it and the driver gets each part once.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column(0).to_numpy())
            firsts = np.flatnonzero(np.diff(at // PART, prepend=-1))
            for own in np.split(at, firsts[1:]):
                if len(own):
                    parts.setdefault(int(own[0]) // PART, np.zeros(PART, bool))[own % PART] = True
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([np.packbits(b).tobytes() for b in parts.values()], pa.binary())], ["part", "bits"])

    name = places.columns[0]
    dealt = places.repartition(F.floor(F.col(name) / F.lit(PART)))
    bits = np.zeros(-(-size // PART) * PART // 8, np.uint8)
    for row in dealt.mapInArrow(fill, "part long, bits binary").collect():
        bits[row.part * PART // 8 : (row.part + 1) * PART // 8] |= np.frombuffer(row.bits, np.uint8)
    return bits


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7))) & 1 == 1


def sha256_hex(parts: list[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
