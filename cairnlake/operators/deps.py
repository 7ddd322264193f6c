"""Dependencies between files: import resolution, importers, definitions and references of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.functions.scoring import symbol_score
from cairnlake.functions.text import dirname, normalized, preview, trim_all
from cairnlake.operators.code import exported_symbols
from cairnlake.operators.substrings import containing

# Fixed value: extensions in the order in which they are tried.
EXTENSIONS = (".cjs", ".cts", ".js", ".jsx", ".mjs", ".mts", ".ts", ".tsx")


def import_base(from_path: Column, module: Column) -> Column:
    """The path that a relative specifier names, without guessing; null for others and for those that leave the root."""
    folder = dirname(from_path)
    base = normalized(F.concat_ws("/", F.when(folder != "", folder), module))
    base = F.when(module.endswith("/"), F.concat(base, F.lit("/"))).otherwise(base)
    # Nearly all specifiers climb some folders of a plain path and then name one: no steps to be folded.
    climbs, rest = F.regexp_extract(module, r"^(?:\./)*((?:\.\./)*)", 1), F.regexp_extract(module, r"^(?:\./)*(?:\.\./)*(?:\./)*((?s).*)$", 1)
    up, depth = F.length(climbs) / 3, F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1
    odd = r"(^|/)\.{0,2}(/|$)"
    plain = module.startswith(".") & ~folder.rlike(odd) & ~rest.rlike(odd) & (up < depth)
    climbed = F.concat(F.call_function("substring_index", folder, F.lit("/"), (depth - up).cast("int")), F.lit("/"), rest)
    return F.when(plain, climbed).when(module.startswith("."), base)


def file_keys(files: DataFrame) -> DataFrame:
    """(key, how, ext, to_path): a file is found by its path, its path without extension, or, for an index, its folder."""
    path = F.col("file_path")
    extension = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), extension)
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(extension))
    key = lambda k, how, r: F.struct(k.alias("key"), F.lit(how).alias("how"), r.alias("ext"))
    known = rank > 0
    found = F.array(key(path, "path", F.lit(0).cast("long")), F.when(known, key(stem, "stem", rank)), F.when(known & stem.endswith("/index"), key(F.regexp_replace(stem, "/index$", ""), "folder", rank)))
    return files.select(F.explode(F.array_compact(found)).alias("k"), path.alias("to_path")).select("k.*", "to_path")


def import_edges(files: DataFrame) -> DataFrame:
    """(from_path, module, line, ord, to_path): each import that resolves, to the best file that exists.

    Tried in order: the path as it is, with each extension, with each extension
    in place of its own, as a folder with an index, and so without its extension.
    Both sides meet on at most two keys an import and three a file, not on every
    path that might be meant; what was tried follows from the keys that met. ``files``
    has file_path and imports (module, line).
    """
    rows = files.select(F.col("file_path").alias("from_path"), F.posexplode("imports").alias("ord", "i")).select("from_path", "ord", "i.module", "i.line")
    # exploded, the path is made once and not in each condition on it
    rows = rows.select("*", F.explode(F.array(import_base(F.col("from_path"), F.col("module")))).alias("base")).where("base is not null and not startswith(base, '../') and not startswith(base, '/')")
    rows = rows.withColumn("own", F.regexp_extract("base", r"[^/](\.[^./]*)$", 1))
    keys = F.array(F.struct(F.col("base").alias("key"), F.lit(False).alias("bare")), F.when(F.col("own") != "", F.struct(F.substr("base", F.lit(1), F.length("base") - F.length("own")).alias("key"), F.lit(True).alias("bare"))))
    tried = rows.select("from_path", "ord", "module", "line", F.explode(keys).alias("t")).select("from_path", "ord", "module", "line", "t.*").where("key is not null")
    steps = {("path", False): 0, ("stem", False): 1, ("stem", True): 2, ("folder", False): 3, ("folder", True): 4}
    step = F.coalesce(*[F.when((F.col("how") == how) & (F.col("bare") == bare), i) for (how, bare), i in steps.items()])
    met = tried.join(file_keys(files), "key").withColumn("step", step).where("step is not null")
    return met.groupBy("from_path", "ord", "module", "line").agg(F.min_by("to_path", F.struct("step", "ext")).alias("to_path"))


def reverse_imports(edges: DataFrame) -> DataFrame:
    """(file_path, importers): who imports a file, by importer path and line."""
    return edges.groupBy(F.col("to_path").alias("file_path")).agg(F.array_sort(F.collect_list(F.struct(F.col("from_path").alias("importer"), "ord", "module", "line"))).alias("importers"))


def file_preview(chunk_rows: DataFrame, most: int) -> DataFrame:
    """(file_path, content_preview): the first chunk with text, cut to ``most`` characters."""
    shown = chunk_rows.where(trim_all("content") != "").groupBy("file_path").agg(F.min_by("content", F.struct("start_line", "end_line")).alias("c"))
    return shown.select("file_path", preview("c", most).alias("content_preview"))


def dependency_context(edges: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """(target, direction, file_path, module, import_line, rank): what each target imports, then who imports it.

    A file is named once for each direction; a self-import counts only forward.
    Each edge is laid out in both directions once; all that follows needs the
    rows of a target together, so one shuffle by target serves it.
    """
    goal = targets.select(F.col("file_path").alias("target")).distinct()
    way = lambda target, direction, path, at: F.struct(target.alias("target"), F.lit(direction).alias("direction"), path.alias("file_path"), F.struct(*at, F.col("ord").alias("o"), "module", F.col("line").alias("import_line")).alias("at"))
    source, sink = F.col("from_path"), F.col("to_path")
    forward = way(source, "imports", sink, (F.lit(0).alias("d"), F.lit("").alias("p")))
    backward = F.when(source != sink, way(sink, "imported_by", source, (F.lit(1).alias("d"), source.alias("p"))))
    both = edges.select(F.explode(F.array(forward, backward)).alias("w")).where("w is not null").select("w.*")
    once = both.join(goal, "target", "left_semi").groupBy("target", "direction", "file_path").agg(F.min("at").alias("at"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy("at"))).where(F.col("rank") <= limit)
    return ranked.select("target", "direction", "file_path", "at.module", "at.import_line", "rank")


def import_references(edges: DataFrame, target: str, limit: int) -> DataFrame:
    """Files that ``target`` imports, each once, in the order of its imports."""
    own = edges.where(F.col("from_path") == target).groupBy(F.col("to_path").alias("file_path")).agg(F.min(F.struct("ord", "module", "line")).alias("i"))
    return own.orderBy("i.ord").limit(limit).select("file_path", "i.module", "i.line")


def importer_references(edges: DataFrame, target: str, limit: int) -> DataFrame:
    """Files that import ``target``, each once, by path."""
    own = edges.where((F.col("to_path") == target) & (F.col("from_path") != target)).groupBy(F.col("from_path").alias("file_path")).agg(F.min(F.struct("ord", "module", "line")).alias("i"))
    return own.orderBy("file_path").limit(limit).select("file_path", "i.module", "i.line")


def symbol_definitions(files: DataFrame, chunk_rows: DataFrame, name: str, limit: int) -> DataFrame:
    """Definitions of a symbol by path and line, with the first chunk that contains the line."""
    found = files.select("file_path", F.explode("symbols").alias("s")).where(F.col("s.name") == name).select("file_path", "s.name", "s.kind", "s.line")
    best = found.orderBy("file_path", "line").limit(limit)
    chunk = chunk_rows.select("file_path", "start_line", "end_line", "content")
    met = best.join(chunk, (best.file_path == chunk.file_path) & (chunk.start_line <= best.line) & (chunk.end_line >= best.line), "left").select(best["*"], "start_line", "end_line", "content")
    first = met.groupBy("file_path", "name", "kind", "line").agg(F.min(F.struct("start_line", "end_line", "content")).alias("c"))
    return first.select("file_path", "name", "kind", "line", "c.*").orderBy("file_path", "line")


def approximate_references(chunk_rows: DataFrame, name: str, defining_path: str, limit: int) -> DataFrame:
    """Chunks whose text mentions the symbol, without the chunk that defines it, by path and line."""
    defines = (F.col("file_path") == defining_path) & F.exists("symbols", lambda s: s["name"] == name)
    found = chunk_rows.where(F.lower("content").contains(name.lower()) & ~defines)
    return found.select("file_path", "start_line", "end_line", "content").orderBy("file_path", "start_line").limit(limit)


def symbol_mentions(symbols: DataFrame, texts: DataFrame, *, id_col: str, text: Column) -> DataFrame:
    """(name, id) of texts that mention a symbol as a substring; ``symbols`` (name) is the query side."""
    found = containing(symbols.select(F.col("name").alias("value")), texts.select(F.col(id_col).alias("__id"), text.alias("__text")), text=F.col("__text"), key="__id", keep=["__id"])
    return found.select(F.col("value").alias("name"), F.col("__id").alias("id"))


def target_symbol(chunk_symbols: Column, file_symbols: Column, query: str) -> Column:
    """The symbol that a query means: best score, then line, then name; null if none scores."""
    every = F.concat(chunk_symbols, file_symbols)
    scored = F.filter(F.transform(every, lambda s: F.struct((-symbol_score(s["name"], query)).alias("k"), s["line"].alias("line"), s["name"].alias("name"), s.alias("symbol"))), lambda x: x["k"] < 0)
    return F.get(F.array_sort(F.transform(scored, lambda x: F.struct(x["k"].alias("k"), x["line"].alias("line"), x["name"].alias("name"), x["symbol"].alias("symbol")))), F.lit(0))["symbol"]


def impact(files: DataFrame, chunk_rows: DataFrame, edges: DataFrame, target: str, symbol: str | None, limit: int) -> dict[str, DataFrame]:
    """Definitions, imports, importers, references and likely affected files of a file or one of its symbols."""
    none = chunk_rows.where("false")
    definitions = symbol_definitions(files, chunk_rows, symbol, limit) if symbol else none
    references = approximate_references(chunk_rows, symbol, target, limit) if symbol else none
    importers = importer_references(edges, target, limit)
    affected = importers.select("file_path", F.lit(0).alias("o")).unionByName(references.select("file_path", F.lit(1).alias("o"))).where(F.col("file_path") != target)
    affected = affected.groupBy("file_path").agg(F.min("o").alias("o")).orderBy("o", "file_path").limit(limit).select("file_path")
    return {"definitions": definitions, "imports": import_references(edges, target, limit), "imported_by": importers, "references": references, "affected": affected}


def exported(files: DataFrame, limit: int) -> DataFrame:
    return files.select("file_path", exported_symbols(F.col("symbols"), F.col("exports"), limit).alias("symbols"))
