"""Word, substring and regular-expression search over the lines of a corpus.

Word lookups filter each file's lines by their own tokens, so no posting is shuffled for a single query; the posting tables
below serve counts and repeated lookups.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import globs
from ..sources.adapters import line_table


def word_postings(files: DataFrame) -> DataFrame:
    """Distinct (word, path, line_num)."""
    lines = line_table(files)
    return lines.select(F.explode(F.array_distinct(X.tokens(F.col("line_text")))).alias("word"), "path", "line_num")


def trigram_postings(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(X.trigrams(F.col("content"))).alias("tri"))


def word_lines(files: DataFrame, word: str) -> DataFrame:
    """Lines that have a word; the asked word is lower-cased as a whole, indexed ones only in ASCII."""
    q = word.lower()
    return line_table(files.where(F.lower("content").contains(q))).where(F.array_contains(X.tokens(F.col("line_text")), q))


def prefix_lines(files: DataFrame, prefix: str) -> DataFrame:
    q = prefix.lower()
    return line_table(files.where(F.lower("content").contains(q))).where(F.exists(X.tokens(F.col("line_text")), lambda w: w.startswith(q)))


def trigram_candidates(files: DataFrame, query: str) -> DataFrame:
    """Paths whose text has every trigram of the query."""
    q = query.lower()
    if len(q.encode()) < 3 or not q.isascii():
        return files.select("path").limit(0)
    asked = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    low = F.lower("content")
    for t in asked:
        files = files.where(low.contains(t))
    return files.select("path")


def search(files: DataFrame, query: str, limit: int, full_scan_below: int = 100) -> DataFrame:
    """Lines for one term by tier: exact word, word prefix, substring; for more terms, lines with all of them.

    A full substring scan (tier 4) is added only for a corpus of fewer than ``full_scan_below`` files and no other result.
    """
    terms = query.lower().split() or [query.lower()]
    lines = line_table(files)
    low = F.lower("line_text")
    if len(terms) > 1:
        cond = low.contains(terms[0])
        for t in terms[1:]:
            cond &= low.contains(t)
        # the first term's files: those that have it as a word or all its trigrams; all files if there are none
        first = terms[0]
        word = F.exists(X.lines(F.col("content")), lambda x: F.array_contains(X.tokens(x), first))
        if len(first.encode()) >= 3 and first.isascii():
            narrowed = files.where(F.lower("content").contains(first))
        else:
            narrowed = files.where(word)
        rows = line_table(narrowed) if narrowed.limit(1).count() else lines
        return rows.where(cond).select("path", "line_num", "line_text").orderBy("path", "line_num").limit(limit)
    q = terms[0]
    words = X.tokens(F.col("line_text"))
    tier = F.when(F.array_contains(words, q), 1).when(F.exists(words, lambda w: w.startswith(q)), 2)
    if len(q.encode()) >= 3 and q.isascii():
        tier = tier.when(low.contains(q), 3)
    rows = line_table(files.where(F.lower("content").contains(q))).withColumn("tier", tier)
    found = rows.where("tier is not null")
    if (len(q.encode()) < 3 or not q.isascii()) and files.limit(full_scan_below).count() < full_scan_below and not found.limit(1).count():
        found = rows.where(low.contains(q)).withColumn("tier", F.lit(4))
    return found.orderBy("tier", "path", "line_num").limit(limit).select("path", "line_num", "line_text", "tier")


_NOT_LINEAR = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


def search_regex(files: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Lines that a pattern finds; look-around and back references are no part of the language."""
    if _NOT_LINEAR.search(pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern}")
    return line_table(files).where(F.col("line_text").rlike(pattern)).select("path", "line_num", "line_text").orderBy("path", "line_num").limit(limit)


def with_scope(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol (latest start, later of equals) over each (path, line_num), imports aside; null if none."""
    s = symbols.where("kind <> 'import'").select(F.col("path").alias("sp"), F.struct("line_start", "ord", "name", "kind").alias("s"), "line_start", "line_end")
    found = rows.join(s, (F.col("path") == F.col("sp")) & F.col("line_num").between(F.col("line_start"), F.col("line_end")), "left")
    return found.groupBy("path", "line_num", "line_text").agg(F.max("s").alias("s")).select("path", "line_num", "line_text", F.col("s.name").alias("scope"), F.col("s.kind").alias("scope_kind"))


def text_search(files: DataFrame, symbols: DataFrame, query: str, limit: int, glob: str | None = None, compact: bool = False, regex: bool = False) -> DataFrame:
    """Search, then filters by path and comment, then scopes; four times the limit is looked at before the filters."""
    rows = search_regex(files, query, 4 * limit) if regex else search(files, query, 4 * limit).select("path", "line_num", "line_text")
    if glob is not None:
        rows = rows.where(globs.matches_anywhere(F.col("path"), glob))
    if compact:
        rows = rows.where(~X.is_comment_or_blank(F.col("line_text"), X.language(F.col("path"))))
    return with_scope(rows.orderBy("path", "line_num").limit(limit), symbols).orderBy("path", "line_num")


def word_refs(files: DataFrame, word: str, symbols: DataFrame | None = None, glob: str | None = None, prefix: str = "") -> DataFrame:
    """Every line with a word, classified, scored and numbered by rank (``pos`` from 1)."""
    lines = word_lines(files.where(X.under(F.col("path"), prefix)), word)
    if glob is not None:
        lines = lines.where(globs.matches_anywhere(F.col("path"), glob))
    path, text = F.col("path"), F.col("line_text")
    if symbols is not None:
        defs = symbols.where((F.col("name") == word) & ~F.col("kind").isin("import", "comment")).select("path", F.col("line_start").alias("line_num")).distinct().withColumn("is_def", F.lit(True))
        lines = lines.join(defs, ["path", "line_num"], "left")
    else:
        lines = lines.withColumn("is_def", F.lit(None).cast("boolean"))
    plain = X.choose((X.is_call_of(text, word), "call"), otherwise="reference")
    kind = F.when(X.is_doc_path(path), "doc").when(F.col("is_def"), "definition").when(X.is_import_line(text), "import").when(X.is_export_line(text), "export").when(X.is_test_path(path), "test").otherwise(plain)
    rank = X.word_path_rank(path)
    rows = lines.select("path", "line_num", "line_text", kind.alias("kind"), rank.alias("path_rank"))
    scores = F.create_map(*[F.lit(x) for kv in X.OCCURRENCE_SCORES.items() for x in kv])
    ranks = F.array(*map(F.lit, X.RANK_SCORES))
    return rows.withColumn("score", scores[F.col("kind")] + F.element_at(ranks, F.col("path_rank") + 1))


def ranked_page(refs: DataFrame, cursor: int = 0, limit: int = 50) -> DataFrame:
    """One page of the ranked references: a top-k, so only cursor + limit rows are gathered."""
    limit = min(max(limit, 1), 200)
    top = refs.orderBy(F.desc("score"), "path_rank", "path", "line_num").limit(cursor + limit)
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.orderBy(F.desc("score"), "path_rank", "path", "line_num"))
    return top.withColumn("pos", pos).where(F.col("pos") > cursor).select("pos", "kind", "path", "line_num", "line_text", "score")


def path_facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("facet")).agg(F.count(F.lit(1)).alias("n"))


def kind_facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("kind").alias("facet")).agg(F.count(F.lit(1)).alias("n"))


def callers(files: DataFrame, symbols: DataFrame, word: str, limit: int = 30) -> DataFrame:
    """Lines with a word that are not where a symbol of that name starts."""
    defs = symbols.where(F.col("name") == word).select("path", F.col("line_start").alias("line_num"))
    return word_lines(files, word).join(defs, ["path", "line_num"], "left_anti").select("path", "line_num", "line_text").orderBy("path", "line_num").limit(limit)
