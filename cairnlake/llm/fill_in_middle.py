"""Fill-in-middle transformation: texts cut in three at line ends, the middle moved to the back.

DuckDB inside mapInArrow: each Arrow batch is registered as a table, one SQL
statement cuts, rearranges, rebuilds and hashes its texts, and an Arrow batch
comes back; no row passes through Python.

A text of n lines is cut after two line counts that a keyed hash of its id draws
between 0 and n. Texts that hold a sentinel, empty ones and those that the rate
leaves out stay plain. Others become ``<P>prefix<S>suffix<M>middle`` (psm) or
``<S>suffix<P>prefix<M>middle`` (spm). No text of these holds a sentinel, and none
can arise where parts meet, so a split at the sentinels gives the parts back;
``restored_sha256`` is of the text that is so rebuilt from output and form alone.

A null text reads as empty, a null id as an empty string; rows may repeat, and
those of one id and text get one result. Texts are worked on whole, however long,
in batches of bounded bytes; an empty table gives an empty result, and further
columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlake.llm.common import map_batches, pick

SEED, RATE, SPM_RATE = 7, 100, 50
#: Fixed sentinels of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def batch_sql(*, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """The statement over a table ``batch`` (id, text): rates in percent of the texts, and of these in spm."""
    group = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    part = lambda a, b: f"coalesce(array_to_string(list_slice(units, {a}, {b}), ''), '')"
    holds = " OR ".join(f"contains(text, '{s}')" for s in (PREFIX, SUFFIX, MIDDLE))
    p, s, m = len(PREFIX), len(SUFFIX), len(MIDDLE)
    return f"""
WITH cut AS (
  SELECT id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('{int(seed)}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch
), drawn AS (
  SELECT id, text, units, len(units) AS n, {group(0)} % (len(units) + 1) AS a, {group(1)} % (len(units) + 1) AS b,
         CASE WHEN text = '' OR {holds} OR {group(2)} % 100 >= {int(rate)} THEN 'plain' WHEN {group(3)} % 100 < {int(spm_rate)} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT id, text, n, form, {part("1", "least(a, b)")} AS prefix, {part("least(a, b) + 1", "greatest(a, b)")} AS middle, {part("greatest(a, b) + 1", "n")} AS suffix FROM drawn
), made AS (
  SELECT id, n, form, prefix, middle,
         CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END AS output
  FROM parts
), found AS (
  SELECT *, instr(output, '{PREFIX}') AS p, instr(output, '{SUFFIX}') AS s, instr(output, '{MIDDLE}') AS m FROM made
), rebuilt AS (
  SELECT *, CASE form
    WHEN 'psm' THEN substr(output, p + {p}, s - p - {p}) || substr(output, m + {m}) || substr(output, s + {s}, m - s - {s})
    WHEN 'spm' THEN substr(output, p + {p}, m - p - {p}) || substr(output, m + {m}) || substr(output, s + {s}, p - s - {s})
    ELSE output END AS restored
  FROM found
)
SELECT id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, output, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM rebuilt"""


def fill_in_middle(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, with_output: bool = True) -> DataFrame:
    """``id_col``, n, form, prefix_chars, middle_chars, the output (unless not asked for), output_sha256 and restored_sha256 of every row."""
    rows = pick(documents, id=id_col, text=text_col)
    kind = dict(rows.dtypes)["id"]
    columns = ["id", "n", "form", "prefix_chars", "middle_chars", *(["output"] if with_output else []), "output_sha256", "restored_sha256"]
    query = f"SELECT {', '.join(columns)} FROM ({batch_sql(seed=seed, rate=rate, spm_rate=spm_rate)})"
    kinds = {"id": kind, "n": "long", "prefix_chars": "long", "middle_chars": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)

    def make():
        import duckdb

        # one thread a task, no files: what a batch needs is bounded by its bytes
        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"})

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            con.register("batch", pa.Table.from_batches([batch]))
            found = con.sql(query).to_arrow_table()
            con.unregister("batch")
            wanted = pa.schema([("id", batch.schema.field("id").type), *[(c, pa.int64() if kinds.get(c) == "long" else pa.string()) for c in columns[1:]]])
            return pa.RecordBatch.from_arrays([_whole(found.column(c), wanted.field(c).type) for c in columns], schema=wanted)

        return work

    return map_batches(rows, make, schema).withColumnRenamed("id", id_col)


def _whole(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    parts = column.cast(kind).chunks
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else pa.array([], kind)
