"""The incremental index against a whole build."""

import random

import pytest

from cairnlake.operators import code
from cairnlake.sources import incremental

LISTING = "file_path string, language string, size_bytes long, mtime_ms long, content string"


def listed(spark, files):
    """Listing and contents of {path: (text, time)}; contents of files other than ``allowed`` may not be asked for."""
    df = spark.createDataFrame([(p, "typescript", len(t), at, t) for p, (t, at) in files.items()], LISTING)
    asked = []

    def contents(rows):
        asked.extend(r.file_path for r in rows.collect())
        return rows.join(df.select("file_path", "content"), "file_path")

    return df.drop("content"), contents, df, asked


def rows_of(df):
    return sorted(repr(sorted(r.asDict(True).items())) for r in df.collect())


def whole(spark, df):
    parsed = code.parse_files(df)
    return parsed.drop("content"), code.chunks(parsed)


def text(dice):
    return "".join(dice.choice([f"export function f{i}() {{\n}}\n", f'import a from "./m{i}"\n', "\n", f"class C{i} {{}}\n"]) for i in range(dice.randint(0, 5)))


def test_refreshes_equal_whole_builds(spark, tmp_path):
    dice, folder = random.Random(6), f"file://{tmp_path}/index"
    files = {f"src/f{i}.ts": (text(dice), 1) for i in range(30)}
    for round_ in range(3):
        listing, contents, df, asked = listed(spark, files)
        after = incremental.refresh(spark, folder, listing, contents, buckets=8)
        assert sorted(asked) == sorted(files if round_ == 0 else fresh)  # noqa: F821
        tables, want = incremental.load(spark, folder), whole(spark, df)
        assert rows_of(tables["files"]) == rows_of(want[0].select(*tables["files"].columns)) and rows_of(tables["chunks"]) == rows_of(want[1].select(*tables["chunks"].columns))
        assert after["statistics"] == incremental._measured(*want)
        gone, changed, added = dice.sample(sorted(files), 3), dice.sample(sorted(files), 4), [f"new/{round_}-{i}.ts" for i in range(3)]
        files = {p: x for p, x in files.items() if p not in gone}
        fresh = sorted({*[p for p in changed if p in files], *added})
        files |= {p: (text(dice), 2 + round_) for p in fresh}


def test_one_changed_file_rewrites_one_bucket_and_old_readers_go_on(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    files = {f"f{i}.ts": (f"export const a{i} = () => 1\n", 1) for i in range(40)}
    first = incremental.refresh(spark, folder, *listed(spark, files)[:2], buckets=8)
    reader = incremental.load(spark, folder)["files"]
    assert len(first["versions"]) == 8 and len(set(first["versions"].values())) == 1
    files["f7.ts"] = ("export const changed = () => 2\n", 2)
    second = incremental.refresh(spark, folder, *listed(spark, files)[:2])
    assert sum(second["versions"][b] != v for b, v in first["versions"].items()) == 1 and second["buckets"] == 8
    assert reader.count() == 40 and not reader.where("array_contains(exports, 'changed')").count()
    assert incremental.load(spark, folder)["files"].where("array_contains(exports, 'changed')").count() == 1
    assert incremental.refresh(spark, folder, *listed(spark, files)[:2]) == second  # nothing changed, nothing is written
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("version-")]) == 2


def test_an_emptied_index_and_a_rival_writer(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert incremental.load(spark, folder)["files"].count() == 0
    incremental.refresh(spark, folder, *listed(spark, {"a.ts": ("x", 1)})[:2])
    (tmp_path / "index" / "state-000000000002").write_text("{")  # a rival has claimed the number
    assert incremental.state(spark, folder)["number"] == 1
    with pytest.raises(Exception, match="state-000000000002"):
        incremental.refresh(spark, folder, spark.createDataFrame([], LISTING).drop("content"), lambda rows: rows.selectExpr("*", "'' AS content"))
    assert incremental.load(spark, folder)["files"].count() == 1
    (tmp_path / "index" / "state-000000000002").unlink()
    empty = incremental.refresh(spark, folder, listed(spark, {"b.ts": ("x", 1)})[0].where("false"), listed(spark, {"b.ts": ("x", 1)})[1])
    assert empty["statistics"] == dict.fromkeys(incremental.STATISTICS, 0) and incremental.load(spark, folder)["chunks"].count() == 0
