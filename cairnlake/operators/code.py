"""Lexical parsing of TypeScript and JavaScript files into imports, exports, symbols and chunks.

All of it is built-in functions over the array of a file's lines, so a file is
one row in and one row out, and chunks are exploded without a shuffle. Files are
dealt by their path before they are parsed: some hundred patterns a file are the
work, and a listing may lie in one part of one Parquet file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import lines, sha256, trim_all, trim_end, with_values
from cairnlake.schemas import SYMBOL

# What counts as an import, an export, a symbol. Words end where \w does; Java's \b depends on its release.
IMPORT_PATTERNS = (
    r"""(?<!\w)import\s+(?:type\s+)?(?:[^'"]+\s+from\s+)?["']([^"']+)["']""",
    r"""(?<!\w)export\s+[^'"]+\s+from\s+["']([^"']+)["']""",
    r"""(?<!\w)require\(["']([^"']+)["']\)""",
)
EXPORT_DIRECT = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:class|function|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
EXPORT_NAMED = r"^\s*export\s*\{([^}]+)\}"
SYMBOL_PATTERNS = {
    "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)",
    "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)",
    "interface": r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)",
    "type": r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)",
    "enum": r"^\s*(?:export\s+)?enum\s+([A-Za-z_$][\w$]*)",
    "const": r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)?\s*=>",
}

#: Tasks for each core that files are dealt over before they are parsed; the number is named, so they aren't put together again.
PARTS_A_CORE = 4


def _first(line: Column, pattern: str) -> Column:
    """Group 1 of the first match, or null."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def imports(text_lines: Column) -> Column:
    """array<struct<module, line>>: one at most for each line."""
    found = F.transform(text_lines, lambda x, i: F.struct(F.coalesce(*[_first(x, p) for p in IMPORT_PATTERNS]).alias("module"), (i + 1).alias("line")))
    return F.filter(found, lambda m: m["module"].isNotNull())


def exports(text_lines: Column) -> Column:
    """Sorted distinct names; of ``a as b`` the a."""
    direct = F.transform(text_lines, lambda x: _first(x, EXPORT_DIRECT))
    listed = F.flatten(F.transform(text_lines, lambda x: F.transform(F.split(F.regexp_extract(x, EXPORT_NAMED, 1), ","), lambda part: trim_all(F.get(F.split(trim_all(part), r"\s+as\s+"), F.lit(0))))))
    names = F.filter(F.concat(direct, listed), lambda n: n.isNotNull() & (n != ""))
    return F.array_sort(F.array_distinct(names))


def symbols(text_lines: Column) -> Column:
    """array<struct<name, kind, line, exported>>: the first kind that fits a line."""

    def one(line: Column, i: Column) -> Column:
        kind, name = None, []
        for k, pattern in SYMBOL_PATTERNS.items():
            kind = F.when(line.rlike(pattern), k) if kind is None else kind.when(line.rlike(pattern), k)
            name.append(_first(line, pattern))
        return F.struct(F.coalesce(*name).alias("name"), kind.alias("kind"), (i + 1).alias("line"), line.rlike(r"(?<!\w)export(?!\w)").alias("exported"))

    return F.filter(F.transform(text_lines, one), lambda s: s["name"].isNotNull())


def parse_files(listing: DataFrame) -> DataFrame:
    """Rows of ``schemas.FILES`` with ``content`` from (file_path, language, size_bytes, mtime_ms, content)."""
    parts = PARTS_A_CORE * listing.sparkSession.sparkContext.defaultParallelism
    rows = listing.repartition(parts, "file_path").withColumn("__lines", lines("content"))
    rows = rows.withColumns({"line_count": F.size("__lines"), "content_hash": sha256("content"), "imports": imports(F.col("__lines")), "exports": exports(F.col("__lines")), "symbols": symbols(F.col("__lines"))})
    return rows.drop("__lines")


def spans(symbol_array: Column, n_lines: Column, preamble_blank: Column) -> Column:
    """array<struct<start_line, end_line, chunk_type, symbols>> of a file.

    Without symbols the file is one chunk; otherwise a preamble that isn't blank
    is one of kind mixed, and each symbol's chunk ends before the next symbol.
    """
    span = lambda start, end, kind, syms: F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), kind.alias("chunk_type"), syms.alias("symbols"))
    none = F.array().cast(f"array<{SYMBOL}>")
    whole = F.array(span(F.lit(1), F.greatest(n_lines, F.lit(1)), F.lit("file"), none))
    first = F.get(symbol_array, F.lit(0))["line"]
    lead = F.when((first > 1) & ~preamble_blank, F.array(span(F.lit(1), first - 1, F.lit("mixed"), none))).otherwise(F.array().cast(f"array<struct<start_line:int,end_line:int,chunk_type:string,symbols:array<{SYMBOL}>>>"))

    def each(every: Column, last: Column) -> Column:
        def own(s: Column, i: Column) -> Column:
            following = F.get(every, i + 1)["line"]
            return span(s["line"], F.when(following.isNull(), last).otherwise(F.greatest(s["line"], following - 1)), s["kind"], F.array(s))

        return F.transform(every, own)

    return F.when(F.size(symbol_array) == 0, whole).otherwise(F.concat(lead, with_values(each, symbol_array, n_lines)))


def chunks(files: DataFrame) -> DataFrame:
    """Rows of ``schemas.CHUNKS`` from parsed files with content; hash, imports and exports are the file's."""
    rows = files.withColumn("__lines", lines("content"))
    first = F.get("symbols", F.lit(0))["line"]
    head = F.array_join(F.slice("__lines", 1, F.greatest(F.coalesce(first, F.lit(1)) - 1, F.lit(0))), "\n")
    rows = rows.withColumn("c", F.explode(spans(F.col("symbols"), F.col("line_count"), trim_all(head) == "")))
    body = trim_end(F.array_join(F.slice("__lines", F.col("c.start_line"), F.greatest(F.col("c.end_line") - F.col("c.start_line") + 1, F.lit(0))), "\n"))
    name = F.concat(F.col("file_path"), F.lit(":"), F.col("c.start_line").cast("string"), F.lit("-"), F.col("c.end_line").cast("string"))
    return rows.select(name.alias("id"), "file_path", "language", "c.start_line", "c.end_line", "c.chunk_type", F.col("c.symbols").alias("symbols"), "imports", "exports", body.alias("content"), "content_hash")


def exported_symbols(symbol_array: Column, export_names: Column, limit: int) -> Column:
    """The first symbols that are flagged or listed as exported."""
    return with_values(lambda every, names: F.slice(F.filter(every, lambda s: s["exported"] | F.array_contains(names, s["name"])), 1, limit), symbol_array, export_names)


def index_stats(files: DataFrame, chunk_rows: DataFrame, skipped: int) -> DataFrame:
    """One row: files, skipped files, chunks, symbols, bytes."""
    own = files.agg(F.count(F.lit(1)).alias("files_indexed"), F.lit(skipped).cast("long").alias("files_skipped"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols_indexed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_indexed"))
    return own.join(F.broadcast(chunk_rows.agg(F.count(F.lit(1)).alias("chunks_indexed"))), how="cross")


def areas(files: DataFrame, path: Column, n_symbols: Column, limit: int = 10) -> DataFrame:
    """(name, files, symbols) by first path segment, most files first."""
    from cairnlake.functions.text import first_segment

    return files.groupBy(first_segment(path).alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum(n_symbols).cast("long").alias("symbols")).orderBy(F.desc("files"), "name").limit(limit)


def export_highlights(files: DataFrame, limit: int = 24) -> DataFrame:
    """The first exported symbols by path, line and name."""
    rows = files.select("file_path", F.explode("symbols").alias("s")).where("s.exported").select("file_path", "s.name", "s.kind", "s.line")
    return rows.orderBy("file_path", "line", "name").limit(limit)
