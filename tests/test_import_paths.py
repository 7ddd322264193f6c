"""Paths of relative imports: the short way of plain ones against the fold over all steps, and the keys of the join."""

import itertools
import posixpath

from pyspark.sql import functions as F

from cairnlake.operators import deps


def test_bases_equal_a_fold_over_steps(spark):
    paths = ["a.ts", "src/a.ts", "src/x/y/a.ts", "src/../a.ts", "./src/a.ts", "src//x/a.ts", "../a.ts", "src/.h/a.ts"]
    modules = ["./b", "../b", "../../b", "../../../b", "./../b", ".././b", "./b/../c", "../b/", "./", "..", ".", "../..", "./b//c", ".b", "..b/c", "b", "../.b/c.js", "././../b", "..//b", "./b/.", "./b\nc"]
    rows = spark.createDataFrame(list(itertools.product(paths, modules)), "p string, m string")

    def want(p, m):
        if not m.startswith("."):
            return None
        out = []
        for step in [*p.split("/")[:-1], *m.split("/")]:
            if step == ".." and out and out[-1] != "..":
                out.pop()
            elif step not in ("", "."):
                out.append(step)
        return "/".join(out) + ("/" if m.endswith("/") else "")

    got = {(r.p, r.m): r.b for r in rows.select("p", "m", deps.import_base(F.col("p"), F.col("m")).alias("b")).collect()}
    assert got == {(p, m): want(p, m) for p in paths for m in modules}
    assert got["src/x/y/a.ts", "../../b"] == posixpath.normpath("src/x/y/../../b")


def test_a_path_is_made_once(spark):
    """The fold over steps is not repeated in each condition on the path (twice is once for each way to end)."""
    files = spark.createDataFrame([(f"a/{i}.ts", [("./b.js", 1)]) for i in range(50)] + [("a/b.ts", [])], "file_path string, imports array<struct<module:string,line:int>>")
    plan = deps.import_edges(files)._jdf.queryExecution().optimizedPlan().toString()
    assert deps.import_edges(files).count() == 50 and plan.count("aggregate(split(") <= 2, plan
