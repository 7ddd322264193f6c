"""What is sent to a Python worker at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from cairnlake.llm import common


def test_a_batch_is_bounded_by_bytes_and_a_named_bound_stays(spark):
    """30 MB of text in one partition: the buffer behind a slice is the whole batch that JVM and worker hold."""
    df = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))

    def make():
        return lambda b: pa.RecordBatch.from_arrays([pa.array([b.column(1).buffers()[2].size]), pa.array([b.num_rows])], ["held", "n"])

    def sent():
        rows = common.map_batches(df, make, "held long, n long").collect()
        assert sum(r.n for r in rows) == 3000
        return len(rows), max(r.held for r in rows)

    before = spark.conf.get(common.BATCH_BYTES, None)
    try:
        spark.conf.unset(common.BATCH_BYTES)
        parts, held = sent()
        assert held <= common.SLICE and parts == 5  # a batch is one slice
        spark.conf.set(common.BATCH_BYTES, "1000000")
        assert sent()[1] < 2_000_000
    finally:
        spark.conf.set(common.BATCH_BYTES, before) if before else spark.conf.unset(common.BATCH_BYTES)
