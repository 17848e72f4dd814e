"""Listings, metadata and reads of a corpus of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import globs
from ..sources.adapters import file_table, line_table
from ..sources.project import content_hashes

LIMIT = 200


def filtered(files: DataFrame, prefix: str = "", glob: str | None = None, language: str | None = None, min_lines: int | None = None, max_lines: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Files that meet all filters, by path; ``total`` counts them before the limit."""
    t = file_table(files.where(X.under(F.col("path"), prefix)))
    if glob is not None:
        t = t.where(globs.matches(F.col("path"), glob))
    if language is not None:
        t = t.where(F.col("language") == language.lower())
    if min_lines is not None:
        t = t.where(F.col("line_count") >= min_lines)
    if max_lines is not None:
        t = t.where(F.col("line_count") <= max_lines)
    t = t.select("path", "language", "line_count", "byte_size")
    return t.orderBy("path").limit(limit).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("total"))))


def by_language(files: DataFrame) -> DataFrame:
    t = file_table(files)
    return t.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sum("byte_size").alias("bytes"))


def children(files: DataFrame, folder: str) -> DataFrame:
    """What lies directly in a folder: folders (with a slash) before files, each by name."""
    f = folder.strip("/")
    rest = F.substr("path", F.lit(len(f) + 2)) if f else F.col("path")
    rows = files.where(F.col("path").startswith(f + "/") if f else F.lit(True)).select(rest.alias("rest"))
    child = F.split_part("rest", F.lit("/"), F.lit(1))
    is_dir = F.instr("rest", "/") > 0
    return rows.select(F.when(is_dir, F.concat(child, F.lit("/"))).otherwise(child).alias("name"), is_dir.alias("is_dir")).distinct().orderBy(F.desc("is_dir"), "name")


def globbed(files: DataFrame, pattern: str, limit: int = LIMIT) -> DataFrame:
    return files.where(globs.matches(F.col("path"), pattern)).select("path").orderBy("path").limit(limit)


def recent(files: DataFrame, limit: int = 10) -> DataFrame:
    t = files.select("path", "modified_ms", F.octet_length("content").cast("long").alias("byte_size"))
    return t.orderBy(F.desc("modified_ms"), F.desc("byte_size"), "path").limit(limit).withColumn("modified", X.time_text(F.col("modified_ms")))


def status(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Counts of files, distinct words and files with words."""
    words = files.select("path", F.explode(F.flatten(F.transform(X.lines(F.col("content")), X.tokens))).alias("word"))
    n = files.agg(F.count(F.lit(1)).alias("files"))
    w = words.agg(F.countDistinct("word").alias("words"), F.countDistinct("path").alias("word_files"))
    s = (symbols.agg(F.count(F.lit(1)).alias("symbols"))) if symbols is not None else None
    out = n.crossJoin(F.broadcast(w))
    return out.crossJoin(F.broadcast(s)) if s is not None else out


def read_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first..last of every file, joined by newlines; empty beyond the end."""
    ls = X.lines(F.col("content"))
    return files.select("path", F.array_join(F.slice(ls, F.lit(first), F.lit(last - first + 1)), "\n").alias("text"))


def read_compact(files: DataFrame) -> DataFrame:
    """Every file without comment and blank lines."""
    lang = X.language(F.col("path"))
    kept = F.filter(X.lines(F.col("content")), lambda x: ~X.is_comment_or_blank(x, lang))
    return files.select("path", F.array_join(kept, "\n").alias("text"), F.size(kept).alias("lines"))


def stub(path, byte_size):
    """What a read of a file without text says."""
    return F.concat(F.lit("["), path, F.lit(": not indexed, "), byte_size.cast("string"), F.lit(" bytes]"))


def read(files: DataFrame, paths: DataFrame, if_hash: str | None = None, first: int | None = None, last: int | None = None, compact: bool = False) -> DataFrame:
    """path, text, hash, unchanged of some files; files: path, content (null: not indexed) and byte_size.

    The hash is always that of the whole file. Where it equals ``if_hash``, whatever its case, the text is empty and
    ``unchanged`` true. A file without content gives a stub of text and no hash.
    """
    f = files.join(paths.select("path").distinct(), "path", "left_semi")
    lines, lang = X.lines(F.col("content")), X.language(F.col("path"))
    if first is not None or last is not None:
        begin = max(first or 1, 1)
        size = F.lit(2**31 - 1) if last is None else F.lit(max(last - begin + 1, 0))
        lines = F.slice(lines, F.lit(begin), size)
    if compact:
        lines = F.filter(lines, lambda x: ~X.is_comment_or_blank(x, lang))
    whole = first is None and last is None and not compact
    text = F.col("content") if whole else F.array_join(lines, "\n")
    h = F.when(F.col("content").isNotNull(), content_hashes(F.coalesce("content", F.lit(""))))
    out = f.withColumn("hash", h)
    same = F.coalesce(F.col("hash") == F.lit((if_hash or "").lower()), F.lit(False))
    return out.select("path", F.when(F.col("content").isNull(), stub(F.col("path"), F.col("byte_size"))).when(same, "").otherwise(text).alias("text"), "hash", same.alias("unchanged"))


def line(files: DataFrame, path: str, number: int) -> DataFrame:
    return line_table(files.where(F.col("path") == path)).where(F.col("line_num") == number)


def file_map(files: DataFrame) -> DataFrame:
    """All files with their metadata, by path."""
    return file_table(files).select("path", "language", "line_count", "byte_size").orderBy("path")


def outline_answer(files: DataFrame, symbols: DataFrame, lost: DataFrame, path: str) -> DataFrame:
    """One row for a file: language, counts, imports, unresolved imports, and its symbols in order without the imports."""
    f = file_table(files.where(F.col("path") == path)).select("path", "language", "line_count", "byte_size")
    s = symbols.where(F.col("path") == path)
    own = s.agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "import", F.struct("ord", "name")))), lambda x: x["name"]).alias("imports"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "import", F.struct("ord", "line_start", "line_end", "kind", "name", "detail")))).alias("symbols"),
    )
    gone = lost.where(F.col("path") == path).agg(F.sort_array(F.collect_set("import")).alias("unresolved"))
    return f.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(gone)).withColumn("symbol_count", F.size("symbols"))  # one row each


def fuzzy_paths(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Paths by fuzzy score: of the file name with 10 more, else of the whole path."""
    q = query.lower()
    low = F.lower("path")
    score = F.coalesce(X.fuzzy_score(q, F.substring_index(low, "/", -1)) + F.lit(10).cast("float"), X.fuzzy_score(q, low))
    return files.select("path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)
