import random

from pyspark.sql import functions as F

from cairnlake.functions import predicates, text
from cairnlake.operators import changes, retrieval, rollup, staleness, writeback
from cairnlake.streaming.rollup import weekly_counts


def greedy(rows, limit):
    """One a file, then up to max(2, ceil(limit / 4)) a file, then the rest."""
    out, most = [], max(2, -(-limit // 4))
    for cap in (1, most, len(rows)):
        for r in rows:
            if len(out) < limit and r not in out and sum(o[0] == r[0] for o in out) < cap:
                out.append(r)
    return out


def test_diversified_equals_greedy_passes(spark):
    rng = random.Random(3)
    for limit in (1, 3, 9):
        rows = [(rng.choice("abc"), i) for i in range(14)]
        df = spark.createDataFrame(rows, "f string, i int")
        got = [(r.f, r.i) for r in retrieval.diversified(df, limit, file_col="f", order=[F.col("i")]).collect()]
        assert got == greedy(rows, limit)


def test_tokens_and_text_functions(spark):
    df = spark.createDataFrame([("getUser_id fooBar X a $x", "a\r\nb\n"), ("", "")], "t string, c string")
    rows = df.select(text.tokens("t").alias("t"), text.n_lines("c").alias("n"), text.n_lines_trimmed("c").alias("m"), text.bigrams("t").alias("g"), text.line_range("c", F.lit(2), F.lit(9)).alias("r")).collect()
    assert rows[0].t == ["get", "user_id", "foo", "bar", "$x"] == text.query_tokens("getUser_id fooBar X a $x")
    assert (rows[0].n, rows[0].m, rows[0].r, rows[1].n, rows[1].m, rows[1].g) == (3, 2, "b\n", 1, 1, [])
    paths = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), ("x",)], "p string").select(text.normalized("p")).collect()
    assert [r[0] for r in paths] == ["a/c", "../x", "../x", "x"]


def test_bm25_of_an_empty_corpus_and_query(spark):
    empty = spark.createDataFrame([], "id int, text string")
    assert retrieval.bm25_scores(empty, "foo").count() == 0
    one = spark.createDataFrame([(1, "foo foo bar")], "id int, text string")
    assert retrieval.bm25_scores(one, "foo foo").first().bm25 > 0 and retrieval.bm25_scores(one, "?").first().bm25 == 0


def test_predicates(spark):
    paths = {"a/b.ts": True, "": False, " ": False, "/a": False, "a/../b": False, "a\\..\\b": False, "a\0b": False, "..a": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(predicates.is_safe_path("p")).collect()] == list(paths.values())
    assert predicates.asks_for_code("see src/a.ts") and predicates.asks_for_code("getUser") and predicates.asks_for_code("a_b_c") and not predicates.asks_for_code("how does it work")


def test_staleness_reasons(spark):
    row = lambda path, content, rng=None: ("n", 0, path, 1, 1, content, rng)
    from hashlib import sha256

    h = lambda s: "sha256:" + sha256(s.encode()).hexdigest()
    anchors = spark.createDataFrame([row("a", h("x\ny")), row("b", h("old")), row("c", h("old"), h("x")), row("d", h("old"), h("z")), row("../e", h("x")), row("f", h("x")), row("g", h("x"))], "node_id string, pos int, file_path string, start_line int, end_line int, content_hash string, range_hash string")
    current = spark.createDataFrame([(p, "x\ny") for p in "abcd"] + [("g", None)], "file_path string, content string")
    got = {r.file_path: (r.reason, r.range_fresh) for r in staleness.classify(anchors, current).collect()}
    assert got == {"a": (None, False), "b": ("changed", False), "c": (None, True), "d": ("anchor_changed", False), "../e": ("unsafe_path", False), "f": ("missing", False), "g": ("read_error", False)}


def test_diff_parsing(spark):
    lines = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1 +2,3 @@", "@@ -9,2 +0,0 @@", "+++ /dev/null", "@@ -1,2 +0,0 @@", "+++ b/y z", "@@ -0,0 +5 @@"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, line string")
    assert sorted((r.file_path, r.start_line or 0, r.end_line or 0) for r in changes.hunk_ranges(df, "s").collect()) == [("x", 0, 0), ("x", 2, 4), ("y z", 5, 5)]
    names = spark.createDataFrame([(0, "M\ta"), (1, "R100\told\tnew"), (2, "D\tgone"), (3, "")], "ord int, line string")
    assert [(r.file_path, r.status) for r in changes.name_status(names, "s").collect()] == [("a", "modified"), ("new", "renamed"), ("gone", "deleted")]
    records = spark.createDataFrame(list(enumerate([" M a", "R  new", "old name", "!! ig", "?? u", ""])), "ord int, record string")
    assert [r.file_path for r in changes.porcelain(records).collect()] == ["a", "new", "u"]


def test_risk_levels(spark):
    cases = {(0, 0, 0, 0): "low", (4, 0, 0, 0): "medium", (1, 0, 0, 1): "medium", (1, 1, 0, 1): "high", (11, 0, 0, 0): "high", (1, 3, 0, 0): "high", (2, 0, 9, 0): "high", (2, 0, 0, 2): "high"}
    df = spark.createDataFrame(list(cases), "c int, s int, a int, d int").select(changes.risk(F.col("c"), F.col("s"), F.col("a"), F.col("d")))
    assert [r[0] for r in df.collect()] == list(cases.values())


def test_weeks_and_rollups(spark):
    df = spark.createDataFrame([("2024-01-07 23:59:59",), ("2024-01-08 00:00:00",)], "t string").select(rollup.iso_week(F.col("t").cast("timestamp")).cast("string"))
    assert [r[0] for r in df.collect()] == ["2024-01-01", "2024-01-08"]
    old = spark.sql("select date'2024-01-01' week_of, 1 n union all select date'2024-01-08', 2")
    new = spark.sql("select date'2024-01-08' week_of, 5 n")
    assert [(str(r.week_of), r.n) for r in rollup.upsert_rollup(old, new).collect()] == [("2024-01-08", 5), ("2024-01-01", 1)]


def test_weekly_stream_equals_batch(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(id as int)) ts, if(id % 3 = 0, 'a', 'b') event_type from range(30)")
    events.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in weekly_counts(events).collect()}
    stream = weekly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("weeks").collect()} == batch


def test_writeback_priority_and_limits(spark):
    one = spark.range(1)
    s = writeback.suggestions(F.lit("fix the design test"), F.lit(2), F.lit(1), F.lit(0), F.lit(False), F.lit(True), F.lit(False), F.lit(2), F.lit(0), 3)
    assert [(x.kind, x.confidence) for x in one.select(s.alias("s")).first().s] == [("gotcha", 0.68), ("decision", 0.74), ("invariant", 0.64)]
    assert [writeback.clamp_limit(x) for x in (None, float("nan"), -1, 3.7, 99)] == [6, 6, 0, 3, 20]


def test_imports_resolve_in_order(spark):
    from cairnlake.operators import deps

    there = ["src/a.ts", "src/a/index.ts", "src/b/index.tsx", "src/c.mjs", "src/c.ts", "src/d.js", "src/d.ts", "lib/e.d.ts", "src/x.test.ts", "root.ts"]
    asked = {"./a": "src/a.ts", "./a/": None, "./b": "src/b/index.tsx", "./b.js": "src/b/index.tsx", "./c": "src/c.mjs", "./c.js": "src/c.mjs", "./d.js": "src/d.js", "./d": "src/d.js", "../lib/e.d": "lib/e.d.ts", "./x.test": "src/x.test.ts", "../root": "root.ts", "../../root": None, "a": None, "./missing": None, "./a/index": "src/a/index.ts"}
    rows = [(p, []) for p in there] + [("src/main.ts", [(m, i) for i, m in enumerate(asked)])]
    files = spark.createDataFrame(rows, "file_path string, imports array<struct<module:string,line:int>>")
    got = {r.module: r.to_path for r in deps.import_edges(files).collect()}
    assert got == {m: t for m, t in asked.items() if t}


def test_builders_under_clashing_aliases(spark):
    """Each builder with a lambda gives the same in a select that also makes aliases of its columns' names."""
    from cairnlake.functions import scoring, similarity
    from cairnlake.operators import code

    symbol = "array<struct<name:string,kind:string,line:int,exported:boolean>>"
    anchors = "array<struct<file_path:string,start_line:int,end_line:int>>"
    row = ("red ring", "Red Rings", ["ring red", "x"], [("a", 1, 5)], [("a", 4, 9)], [("foo", "class", 3, True), ("bar", "enum", 7, False)], ["bar"], [(2, 4)], False, 9, "src/foo.ts", [("./foo", 1)], "let foo = bar", [("n1", "concept", "foo", "bar")])
    columns = ["name", "c_name", "aliases", "sources", "c_sources", "symbols", "exports", "ranges", "saw_hunk", "line_count", "file_path", "imports", "content", "related"]
    kinds = f"name string, c_name string, aliases array<string>, sources {anchors}, c_sources {anchors}, symbols {symbol}, exports array<string>, ranges array<struct<start_line:int,end_line:int>>, saw_hunk boolean, line_count int, file_path string, imports array<struct<module:string,line:int>>, content string, related array<struct<id:string,kind:string,name:string,summary:string>>"
    df = spark.createDataFrame([row], kinds)
    c = F.col
    built = {
        "bigrams": text.bigrams("name"),
        "dice": similarity.dice(c("name"), c("c_name")),
        "best_alias": similarity.best_alias(c("name"), c("aliases")),
        "source_overlap": similarity.source_overlap(c("sources"), c("c_sources")),
        "collision": similarity.collision_score(c("name"), c("c_name"), c("aliases"), c("sources"), c("c_sources"), c("aliases"), c("exports")),
        "in_ranges": changes.symbols_in_ranges(c("symbols"), c("ranges"), c("saw_hunk")),
        "exported": code.exported_symbols(c("symbols"), c("exports"), 9),
        "spans": code.spans(c("symbols"), c("line_count"), F.lit(False)),
        "reasons": scoring.chunk_reasons("foo bar", F.lit(1.5)),
        "tokens_in": scoring.tokens_in(c("content"), "foo bar"),
        "document": text.chunk_document(chunk_type="name"),
    }
    plain = df.select(*[v.alias(f"__{k}") for k, v in built.items()]).first()
    clash = df.select(*[F.lit(7).alias(x) for x in columns], *[v.alias(f"__{k}") for k, v in built.items()], *[F.lit(1).alias(x) for x in ("s", "t", "x", "n", "r", "low", "v0")]).first()
    for k in built:
        assert plain[f"__{k}"] == clash[f"__{k}"], k
    assert plain["__bigrams"][:2] == ["re", "ed"] and plain["__in_ranges"][0].name == "foo" and [s.name for s in plain["__exported"]] == ["foo", "bar"]


def test_similar_strings_and_collisions_equal_all_pairs(spark):
    from cairnlake.operators import collision

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    pairs = lambda s: {s[i : i + 2].lower() for i in range(len(s) - 1)}
    dice = lambda a, b: 1.0 if a == b else 2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b))) if len(a) > 1 and len(b) > 1 else 0.0
    left, right = [word() for _ in range(40)], [word() for _ in range(60)]
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "s string")
    for least in (0.2, 0.5, 0.9, 1.0):
        got = {(r.a, r.b): r.dice for r in collision.similar_strings(frame(left), frame(right), least).collect()}
        want = {(a, b): dice(a, b) for a in left for b in right if dice(a, b) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    anchors = "array<struct<file_path:string,start_line:int,end_line:int>>"
    node = lambda i: (f"n{i}", word(), [(rng.choice("pqr"), rng.randint(1, 5), rng.randint(5, 9)) for _ in range(rng.randint(0, 2))], rng.sample(["t", "u", "v"], rng.randint(0, 2)), [word() for _ in range(rng.randint(0, 2))], i)
    rows = [node(i) for i in range(30)]
    nodes = spark.createDataFrame(rows, f"id string, name string, sources {anchors}, tags array<string>, aliases array<string>, map_pos int")
    new = nodes.where("map_pos < 8").drop("aliases", "map_pos")
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0

    def score(a, b):
        if not a[2] or not b[2]:
            sources = 0.0
        else:
            meets = any(s[0] == t[0] and s[1] <= t[2] and t[1] <= s[2] for s in a[2] for t in b[2])
            sources = min(1.0, jaccard({s[0] for s in a[2]}, {t[0] for t in b[2]}) + 0.1 * meets)
        return 0.5 * max(dice(a[1], x) for x in (b[1], *b[4])) + 0.25 * sources + 0.25 * jaccard(set(a[3]), set(b[3]))

    for threshold in (0.65, 0.5, 0.3, 0.0, -1.0):
        got = {(r.id, r["rank"]): (r.candidate, round(r.similarity, 9)) for r in collision.find_collisions(new, nodes, threshold=threshold).collect()}
        want = {}
        for a in rows[:8]:
            best = sorted(((-score(a, b), b[5], b[0]) for b in rows if b[0] != a[0] and score(a, b) >= threshold))[:3]
            want |= {(a[0], i + 1): (b, round(-s, 9)) for i, (s, _, b) in enumerate(best)}
        assert got == want, threshold


def test_batch_of_many_tokens_equals_a_batch_of_few(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=9))) for i in range(30)], "id int, text string")
    asked = spark.createDataFrame([(1, "aa bb"), (2, "dd zz")], "qid int, query string")
    few = retrieval.batch_bm25(docs, asked, id_col="id", text=F.col("text"), limit=4).collect()
    monkeypatch.setattr(retrieval, "FEW_TOKENS", 0)
    many = retrieval.batch_bm25(docs, asked, id_col="id", text=F.col("text"), limit=4).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == 8
