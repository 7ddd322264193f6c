"""Files are parsed in many tasks, wherever their listing lies."""

from pyspark.sql import functions as F

from cairnlake.operators import code

FILES = [("a.ts", "export class A {\n}\nlet b = (x) => x"), ("b.ts", "plain"), ("c.ts", ""), ("d.ts", None)]


def listing(spark):
    rows = spark.createDataFrame(FILES, "file_path string, content string").coalesce(1)
    return rows.select("file_path", F.lit("typescript").alias("language"), F.length("content").cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ms"), "content")


def test_a_listing_of_one_part_is_parsed_in_many_tasks(spark):
    files = listing(spark)
    parsed = code.parse_files(files)
    assert files.rdd.getNumPartitions() == 1
    parsed.count()
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r.file_path, len(r.symbols or [])) for r in parsed.collect()) == [("a.ts", 2), ("b.ts", 0), ("c.ts", 0), ("d.ts", 0)]
