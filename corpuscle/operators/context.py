"""Context bundles: for a question in words, the symbols and lines that matter most.

Keywords and terms come from the short question on the driver. Over files, built-in functions on the text tell the files that
may matter; only those are outlined or taken apart into lines, and only symbols that may be candidates are scored. What is
bounded by the question (the paths near its keywords, the ranked symbols) is collected and goes into the next plan.
"""

from __future__ import annotations

import re
from bisect import insort
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import exprs as X
from ..functions import globs
from ..sources.adapters import line_table
from . import outline

# fixed values: words that carry no meaning, words that ask for tests, words of action
STOP = "what when where which with this that from into does work works look find show how why the and for application".split()
TEST_WORDS = ("test", "tests", "testing", "spec", "specs")
ACTIONS = ("create", "build", "make", "use", "run")
# fixed values: weights of a symbol's score
WEIGHTS = {
    "exact": 500,
    "same_ignoring_case": 450,
    "normal_equal": 420,
    "normal_contains": 180,
    "normal_within": 80,
    "suffix_callable": 320,
    "path_keyword": 80,
    "basename_callable": 520,
    "term_in_name": 35,
    "term_in_path": 10,
    "many_terms_callable": 520,
    "create_or_use": 260,
    "test_path": -60,
    "shadowed": -260,
    "indexed": 500,
    "outlined": 450,
}
# fixed values: weights of a symbol's score by several terms, and the least scores of candidates by path and by terms
TERM_WEIGHTS = {"name": 120, "path": 55, "callable": 120, "action": 140, "runtime": 80}
LEAST_BY_PATH, LEAST_BY_TERMS, PATHS_A_KEYWORD = 80, 260, 5
CALLABLE = ("function", "method")
TOP, BODY_LINES, HITS, HITS_WITH_TESTS = 5, 120, 24, 8
#: what a low confidence says and proposes
LOW_NOTE = "No source symbol matches the question well; what follows are text matches."
NEXT_STEPS = ("path_search with a file name", "symbol_search with a name", "text_search with a phrase")


def normal(text: str) -> str:
    return "".join(c for c in text if c.isalnum()).lower()


def singular(word: str) -> str:
    return word.rstrip("s") if len(word) > 3 else word


def keywords(question: str) -> list[str]:
    """Quoted parts, identifiers, runs of two and three words and their variants, then plain words; each once."""
    out = [m for g in re.findall(r"\"([^\"]+)\"|`([^`]+)`|'([^']+)'", question) for m in g if m]
    words = re.findall(r"[A-Za-z0-9_./:-]+", question)
    out += [w for w in words if re.search(r"[_\-./:]|[a-z][A-Z]|\d", w)]
    plain = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", question)]
    content = [w for w in plain if w not in STOP]
    for n in (3, 2):
        for i in range(len(content) - n + 1):
            part = content[i : i + n]
            last = [*part[:-1], singular(part[-1])]
            out += ["_".join(part), "-".join(part), " ".join(part), "".join(part), "_".join(last), "".join(last)]
    out += content or plain
    seen: dict[str, str] = {}
    for k in out:
        if len(k.encode()) >= 3:
            seen.setdefault(k.lower(), k)
    return list(seen.values())


def terms(question: str) -> list[str]:
    found = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", question)]
    return list(dict.fromkeys(t for w in found for t in (w, singular(w)) if len(t) >= 3 and t not in STOP))


def asks_for_tests(question: str) -> bool:
    return any(w in TEST_WORDS for w in re.findall(r"[a-z]+", question.lower()))


def is_explicit(question: str) -> bool:
    """A quoted part, or a token that looks like an identifier."""
    return bool(re.search(r"[\"'`].+[\"'`]|[_\-./:]|[a-z][A-Z]|\d", question))


def path_rank(p: Column) -> Column:
    return X.choose((X.is_source_path(p), 0), (X.is_test_path(p), 4), (X.is_example_path(p), 5), (X.is_doc_path(p), 6), (p.startswith("packages/") | p.startswith("apps/"), 1), otherwise=3)


def path_score(p: Column, tests: bool) -> Column:
    return X.choose((X.is_source_path(p), 180), (X.is_doc_path(p), -180), (X.is_example_path(p), -120), (X.is_test_path(p), 0 if tests else -60), otherwise=0)


def _once(values: dict[str, Column], use) -> Column:
    """``use`` of some columns that are each computed once a row."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use)[0]


def _keyword_table(ks: list[str]) -> Column:
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(k).alias("word"), F.lit(k.lower()).alias("low"), F.lit(normal(k)).alias("norm"), F.lit(re.search(r"[A-Z_\-]", k) is not None).alias("signal")) for i, k in enumerate(ks)]
    return F.array(*rows)


def allowed(path: Column, prefix: str = "", glob: str | None = None, language: str | None = None) -> Column:
    """A question's filter of paths."""
    cond = X.under(path, prefix)
    if glob is not None:
        cond &= globs.matches(path, glob)
    return cond & (X.language(path) == language.lower()) if language is not None else cond


def _ends(values: list, within) -> list:
    """The values that no other value is ``within``; of equal ones the first."""
    return [v for i, v in enumerate(values) if not any(within(u, v) and (j < i or not within(v, u)) for j, u in enumerate(values) if j != i)]


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _dealt(files: DataFrame) -> DataFrame:
    """The rows over all cores, however they are split: what a filter leaves may stand in a few splits."""
    return files.repartition(max(2 * files.sparkSession.sparkContext.defaultParallelism, files.rdd.getNumPartitions()))


def _is_in(want: str, text: str) -> bool:
    at = iter(text)
    return all(c in at for c in want)


def fuzzy(want: str, text: str) -> int | None:
    """``exprs.fuzzy_score`` of one text."""
    at, run, score, last = 0, 0, 0, -2
    for c in want:
        i = text.find(c, at)
        if i < 0:
            return None
        run = run + 2 if i == last + 1 else 0
        score += 1 + run + (5 if i == 0 or text[i - 1] in "/_-" else 0)
        last, at = i, i + 1
    return score


def _nearest(asked: list[tuple[int, str]]):
    """A task's best paths of each keyword; a file is outlined only if it would be one of them."""

    def best_of(it):
        best = {ord_: [] for ord_, _ in asked}
        for b in it:
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            for i, (path, low) in enumerate(zip(columns["path"], columns["low"])):
                name, new = low.rsplit("/", 1)[-1], []
                for ord_, want in asked:
                    score = fuzzy(want, name)
                    score = fuzzy(want, low) if score is None else score + 10
                    if score is not None:
                        held, row = best[ord_], (-score, path)
                        if (len(held) < PATHS_A_KEYWORD or row < held[-1]) and row not in held:
                            new.append((held, row))
                if new and ("content" not in columns or outline.outline(columns["language"][i], columns["content"][i] or "", path)[0]):
                    for held, row in new:
                        insort(held, row)
                        del held[PATHS_A_KEYWORD:]
        rows = [(ord_, path, -score) for ord_, held in best.items() for score, path in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32()))], names=["ord", "path", "more"])

    return best_of


def near_paths(paths: DataFrame, ks: list[str]) -> DataFrame:
    """(path, near): the keywords (of 3 bytes and more) that a path is among the best fuzzy matches of, with rounded scores.

    paths: (path), or (path, content), of which only files with symbols count. Every keyword has ``PATHS_A_KEYWORD`` paths at
    most, so this is a small table and is collected; only the best of each task are dealt.
    """
    asked = [(i, k.lower()) for i, k in enumerate(ks) if len(k.encode()) >= 3]
    low = F.lower("path")
    has_all = lambda k: "".join(f"[^\\x{{{ord(c):x}}}]*+\\x{{{ord(c):x}}}" for c in k)
    some = "^(?:" + "|".join(map(has_all, _ends([k for _, k in asked], _is_in))) + ")" if asked else "(?!)"
    columns = ["path", low.alias("low")] + ([X.language(F.col("path")).alias("language"), "content"] if "content" in paths.columns else [])
    rows = paths.where(low.rlike(some)).select(*columns).mapInArrow(_nearest(asked), "ord int, path string, more int").distinct()
    place = F.row_number().over(W.partitionBy("ord").orderBy(F.desc("more"), "path"))
    best = rows.withColumn("place", place).where(F.col("place") <= PATHS_A_KEYWORD)
    best = best.groupBy("path").agg(F.collect_list(F.struct("ord", "more")).alias("near")).collect()
    return paths.sparkSession.createDataFrame(best, "path string, near array<struct<ord:int,more:int>>")


def _core(found: list[str]) -> list[str]:
    return [t for t in found if len(t) >= 4 or t == "run"]


def _may_define(question: str, ks: list[str]) -> Column:
    """Whether a file can have a symbol that a keyword names or that several terms find: true for all that do, and for some more."""
    text, path = F.col("content"), F.col("path")
    low, plain = F.lower(text), X.ascii_lower(text)
    named = [F.contains(low, F.lit(k)) for k in _ends([k.lower() for k in ks if k.isascii()], lambda a, b: a in b)]
    named += [c for k in ks if not k.isascii() for c in (F.contains(text, F.lit(k)), F.contains(plain, F.lit(k.lower())))]
    # a term's characters with anything between them that a normalised name leaves out
    also = {"k": "\\x{212a}", "i": "\\x{130}"}
    spelled = ["[^\\p{IsAlphabetic}\\p{N}]*+".join(f"[{c}{c.upper()}{also.get(c, '')}]" for c in t) for t in _core(terms(question))]
    several = [reduce(lambda a, b: a + b, [x.rlike(t).cast("int") for t in spelled for x in (text, path)]) >= 2] if spelled else []
    # keys of YAML are joined to names that stand nowhere in the text
    return X.any_of(*named, *several, X.language(path) == "yaml")


def _may_be(question: str, ks: list[str]) -> Column:
    """Whether a symbol (path, name, near) has a way of becoming a candidate."""
    name, core = F.col("name"), _core(terms(question))
    by_name = name.isin(ks) | X.ascii_lower(name).isin([k.lower() for k in ks]) | F.col("near").isNotNull()
    if not core:
        return by_name
    count = lambda text: reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in core])
    in_name, in_path = count(X.normalised(name)), count(X.normalised(F.col("path")))
    return by_name | (((in_name > 0) | (in_path >= 2)) & (in_name + in_path >= 2))


def _score(question: str, ks: list[str], tests: bool) -> Column:
    """A symbol's best score over its ways of becoming a candidate; null if it is none.

    The ways: a keyword's own name, that name whatever its case, a file among the best for a keyword, several terms.
    """
    w, path = WEIGHTS, F.col("path")
    call = F.col("kind").isin(*CALLABLE)
    found = terms(question)
    core = _core(found)
    actions = [a for a in ACTIONS if a in found]
    count = lambda text, words: F.size(F.filter(F.array(*map(F.lit, words)), lambda t: F.contains(text, t))) if words else F.lit(0)
    base = X.kind_score(F.col("kind")) + path_score(path, tests)
    in_tests = F.when(X.is_test_path(path) & F.lit(not tests), w["test_path"]).otherwise(0)

    def action_score(x):
        hit = (count(x["n"], actions) + count(x["p"], actions)) > 0
        return F.when(hit & x["call"], 360).when(hit, 180).otherwise(-260) if actions else F.lit(0)

    def per_symbol(x):
        n, p = x["n"], x["p"]
        in_name, in_path = count(n, found), count(p, found)
        many = x["call"] & (in_name >= 2)
        more = w["term_in_name"] * in_name + w["term_in_path"] * in_path + F.when(x["call"] & (n == x["stem"]), w["basename_callable"]).otherwise(0)
        more += F.when(many, w["many_terms_callable"]).otherwise(0) + F.when(many & n.rlike("^(create|use)"), w["create_or_use"]).otherwise(0)
        shadowed = ~x["call"] & (n != "") & F.exists(x["callables"], lambda c: F.endswith(c, n) & (F.length(c) > F.length(n)))
        more += F.when(shadowed, w["shadowed"]).otherwise(0) + x["base"] + x["tests"]
        c_name, c_path = count(n, core), count(p, core)
        if core:
            more += F.when(c_name == 0, -1000).when((c_name == 1) & (c_path == 0) & F.lit(len(core) >= 3), -1200).when(c_name >= 2, 600).when(c_path >= 1, 200).otherwise(0)
            more += F.when((c_name == 0) & (c_path < 2), -360).otherwise(90 * c_name + 25 * c_path) + action_score(x)

        t = TERM_WEIGHTS
        by_terms = x["base"] + x["tests"] + t["name"] * c_name + t["path"] * c_path + F.when(x["call"], t["callable"]).otherwise(0) + action_score(x)
        by_terms += F.when(n.rlike("^(create|run)"), t["action"]).otherwise(0) + F.when(F.contains(n, F.lit("runtime")), t["runtime"]).otherwise(0)
        enough = ~((c_name == 0) & (c_path < 2)) & (c_name + c_path >= 2) & F.lit(bool(core))

        def best(y):
            def per_keyword(k):
                own = F.when(x["name"] == k["word"], w["exact"]).when(k["signal"] & (x["ascii"] == k["low"]), w["same_ignoring_case"]).otherwise(0)
                close = F.when(n == k["norm"], w["normal_equal"]).when(F.contains(n, k["norm"]), w["normal_contains"]).when((F.octet_length(k["norm"]) >= 5) & F.contains(k["norm"], n), w["normal_within"]).otherwise(0)
                suffix = F.when(x["call"] & F.endswith(n, k["norm"]) & (F.length(n) > F.length(k["norm"])), w["suffix_callable"]).otherwise(0)
                score = own + y["more"] + F.when(k["norm"] != "", close + suffix + F.when(F.contains(p, k["norm"]), w["path_keyword"]).otherwise(0)).otherwise(0)
                by_path = F.try_element_at(F.filter(x["near"], lambda v: v["ord"] == k["ord"]), F.lit(1))["more"]
                # what a way adds; a candidate by path counts from LEAST_BY_PATH on
                named = F.when(x["name"] == k["word"], w["indexed"]).when(x["ascii"] == k["low"], w["outlined"])
                return F.struct(score.alias("score"), named.alias("named"), by_path.alias("by_path"))

            found = F.transform(_keyword_table(ks), per_keyword)
            found = F.transform(found, lambda v: F.greatest(v["score"] + v["named"], F.when(v["score"] + v["by_path"] >= LEAST_BY_PATH, v["score"] + v["by_path"])))
            return F.greatest(F.array_max(found), F.when(enough & (y["by_terms"] >= LEAST_BY_TERMS), y["by_terms"]))

        return _once({"more": more, "by_terms": by_terms}, best)

    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    values = {"n": X.normalised(F.col("name")), "p": X.normalised(path), "stem": X.normalised(stem), "name": F.col("name"), "ascii": X.ascii_lower(F.col("name")), "call": call}
    values |= {"base": base, "tests": in_tests, "near": F.col("near"), "callables": F.col("callables")}
    return _once(values, per_symbol)


def ranked_symbols(symbols: DataFrame, question: str, limit: int = TOP, prefix: str = "", glob: str | None = None, language: str | None = None) -> DataFrame:
    """The best symbols for a question: each once, with its best score; tests only if asked for or alone.

    Fuzzy paths are looked up among all files with symbols, before the filter of paths.
    """
    ks = keywords(question)
    s = symbols.where("kind <> 'import'")
    if not ks:
        return s.select("path", "name", "kind", "line_start", "line_end", F.lit(0).alias("score")).limit(0)
    near = near_paths(symbols.select("path").distinct(), ks)
    calls = s.where(F.col("kind").isin(*CALLABLE)).groupBy("path").agg(F.collect_set(X.normalised(F.col("name"))).alias("callables"))
    s = s.where(allowed(F.col("path"), prefix, glob, language)).join(F.broadcast(near), "path", "left").where(_may_be(question, ks))
    return _ranked(s.join(calls, "path", "left"), question, ks, limit)


def ranked_in(files: DataFrame, question: str, limit: int = TOP, prefix: str = "", glob: str | None = None, language: str | None = None) -> DataFrame:
    """``ranked_symbols`` of (path, content) files with a path each; only files that may have a candidate are outlined."""
    ks, path = keywords(question), F.col("path")
    if not ks:
        return ranked_symbols(outline.symbols(files), question)
    near = near_paths(files.select("path", "content"), ks)
    few = files.where(allowed(path, prefix, glob, language)).where(path.isin([r.path for r in near.collect()]) | _may_define(question, ks))
    s = outline.outlines(_dealt(few.select("path", "content"))).select("path", "symbols", F.explode("symbols").alias("s"))
    s = s.select("path", "symbols", "s.*").where("kind <> 'import'").join(F.broadcast(near), "path", "left").where(_may_be(question, ks))
    calls = F.filter("symbols", lambda x: x["kind"].isin(*CALLABLE))
    return _ranked(s.withColumn("callables", F.array_distinct(F.transform(calls, lambda x: X.normalised(x["name"])))), question, ks, limit)


def _ranked(s: DataFrame, question: str, ks: list[str], limit: int) -> DataFrame:
    """The first symbols of (path, name, kind, line_start, line_end, near, callables)."""
    tests = asks_for_tests(question)
    none = F.array().cast("array<struct<ord:int,more:int>>")
    s = s.withColumn("near", F.coalesce("near", none)).withColumn("callables", F.coalesce("callables", F.array().cast("array<string>")))
    rows = s.select("path", "name", "kind", "line_start", "line_end", _score(question, ks, tests).alias("score")).where("score > 0")
    rows = rows.groupBy("path", "name", "kind", "line_start").agg(F.max("line_end").alias("line_end"), F.max("score").alias("score"))
    rows = rows.select("path", "name", "kind", "line_start", "line_end", "score")
    return _first(rows, tests, limit, F.desc("score"), path_rank(F.col("path")), "path", "line_start", "name", "kind")


def _first(rows: DataFrame, tests: bool, limit: int, *order) -> DataFrame:
    """The first rows in an order; tests only if asked for or alone. The rows are computed once."""
    if not tests:
        columns = rows.columns
        rows = rows.withColumn("__test", X.is_test_path(F.col("path")))
        place = F.row_number().over(W.partitionBy("__test").orderBy(*order))
        rows = rows.withColumn("__place", place).where(F.col("__place") <= limit)  # of tests and of others
        rows = rows.withColumn("__alone", F.bool_and("__test").over(W.partitionBy(F.lit(0)))).where("__alone or not __test").select(*columns)
    return rows.orderBy(*order).limit(limit)


def bodies(files: DataFrame, ranked: DataFrame, most: int = BODY_LINES) -> DataFrame:
    """Ranked symbols with their source, cut to ``most`` lines."""
    lines = X.lines(F.col("content"))
    joined = files.select("path", "content").join(F.broadcast(ranked), "path")
    n = F.greatest(F.least(F.col("line_end"), F.size(lines), F.col("line_start") + most - 1) - F.col("line_start") + 1, F.lit(1))
    return joined.select("path", "name", "kind", "line_start", "line_end", "score", F.array_join(F.slice(lines, F.col("line_start"), n), "\n").alias("body"))


def snippets(files: DataFrame, ranked: DataFrame, question: str, limit: int = 20, prefix: str = "", glob: str | None = None, language: str | None = None) -> DataFrame:
    """Lines for the keywords: definitions of the ranked symbols first, then the lines that a search for a keyword gives.

    Each keyword gives ``HITS`` lines at most, in the order of a search (word, prefix, within a word; path; line) and before
    the filter of paths; the first keyword to reach a line fixes its score. All keywords are looked for in one pass over the
    lines of the files that have one, and only the first hits of each task are dealt.
    """
    tests, ks = asks_for_tests(question), keywords(question)
    lines = line_table(files)
    text, path = F.col("line_text"), F.col("path")
    if not ks:
        return lines.select("path", "line_num", "line_text", F.lit(0).alias("score")).limit(0)
    top = ranked.orderBy(F.desc("score"), path_rank(path), "path", "line_start", "name", "kind").select("path", "line_start").collect()
    defs = files.sparkSession.createDataFrame([(r.path, r.line_start, 260 - 12 * i, -1) for i, r in enumerate(top)], "path string, line_num int, score int, ord int")
    paths = sorted({r.path for r in top})

    parts = [k.lower().split() or [k.lower()] for k in ks]
    token = r"[\p{IsAlphabetic}\p{N}_]"

    def tier(p):
        if len(p) > 1:
            return F.when(reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(w)) for w in p]), 0)
        word, n = _quoted(p[0]), len(p[0])
        inside = F.contains(F.lower(text), F.lit(p[0]))
        out = F.when(~inside, None) if p[0].isascii() else F
        out = out.when(text.rlike(f"(?i)(?<!{token})(?={token}{{{n}}}(?!{token})){word}"), 1).when(text.rlike(f"(?i)(?<!{token})(?={token}{{{n}}}){word}"), 2)
        return out.when(inside, 3) if p[0].isascii() and n >= 3 else out

    def may_have(text):
        """Whether a text may have a line with a keyword; one whose parts are all within another's parts decides for both."""
        has = lambda w: F.contains(F.lower(text), F.lit(w)) | (F.lit(False) if w.isascii() else F.contains(X.ascii_lower(text), F.lit(w)))
        return X.any_of(*[reduce(lambda a, b: a & b, map(has, p)) for p in _ends(parts, lambda a, b: all(any(v in w for w in b) for v in a))])

    said = line_table(_dealt(files.select("path", "content").where(may_have(F.col("content"))))).where(may_have(text))
    hits = F.array(*[F.struct(F.lit(i).alias("ord"), tier(p).alias("tier")) for i, p in enumerate(parts)])
    said = said.select("path", "line_num", "line_text", "language", F.explode(hits).alias("h")).where("h.tier is not null").select("path", "line_num", "line_text", "language", "h.*")
    place = F.row_number().over(W.partitionBy("ord").orderBy("tier", "path", "line_num"))
    said = said.withColumn("place", place).where(F.col("place") <= (HITS_WITH_TESTS if tests else HITS))
    first = said.groupBy("path", "line_num", "line_text", "language").agg(F.min("ord").alias("ord")).where(allowed(path, prefix, glob, language))
    edge = "[^A-Za-z0-9_-]"

    def score(x):
        k = F.element_at(_keyword_table(ks), x["ord"] + 1)
        whole = F.regexp_like(x["low"], F.concat(F.lit(f"(^|{edge})\\Q"), k["low"], F.lit(f"\\E({edge}|$)")))
        return F.when(F.contains(x["low"], k["low"]), 20).otherwise(0) + F.when(whole, 30).otherwise(0) + F.when(F.contains(x["path"], k["low"]), 15).otherwise(0) - F.when(F.length(k["word"]) <= 3, 10).otherwise(0)

    cases = _once({"low": F.lower(text), "path": F.lower(path), "ord": F.col("ord")}, score)
    place = X.choose((X.is_source_path(path), 20), (X.is_doc_path(path), -30), (X.is_example_path(path), -20), otherwise=0)
    minus = F.when(X.is_comment_or_blank(text, F.col("language")), 20).otherwise(0) + F.when(X.is_import_line(text), 35).otherwise(0) + F.when(X.is_test_path(path) & F.lit(not tests), 80).otherwise(0)
    near = F.when(path.isin(paths), 90).otherwise(0)
    said = first.select("path", "line_num", "line_text", (cases + place + near - minus).alias("score"), "ord")
    own = line_table(files.where(path.isin(paths))).join(F.broadcast(defs), ["path", "line_num"]).select("path", "line_num", "line_text", "score", "ord")
    rows = own.unionByName(said).groupBy("path", "line_num", "line_text").agg(F.min_by("score", F.struct("ord", -F.col("score"))).alias("score"))
    return _first(rows, tests, limit, F.desc("score"), path_rank(path), "path", "line_num", "line_text")


def render(question: str, bodies_: DataFrame, snippets_: DataFrame, confidence_: str) -> str:
    """A bundle as markdown; both tables are as small as their limits."""
    out = [f"## Context for: {question}", ""]
    if confidence_ == "low":
        out += [LOW_NOTE, "", "### Suggested Next Steps", "", *[f"- {x}" for x in NEXT_STEPS], ""]
    symbols = bodies_.orderBy(F.desc("score"), path_rank(F.col("path")), "path", "line_start", "name").collect()
    if symbols:
        out += ["### Relevant Symbols", "", *[f"- {r.name} ({r.kind}): {r.path}:{r.line_start}-{r.line_end}" for r in symbols], "", "### Relevant Symbol Bodies", ""]
        for r in symbols:
            out += [f"#### {r.path}:{r.line_start}-{r.line_start + r.body.count(chr(10))} {r.name}", "", "```text", r.body.removesuffix("\n"), "```", ""]
    lines = snippets_.collect()
    if lines:
        out += ["### Relevant Code Snippets", "", *[f"{r.path}:{r.line_num}: {r.line_text}" for r in lines]]
    return "\n".join(out) + "\n"


def confidence(ranked: DataFrame, question: str) -> DataFrame:
    """high: an explicit question with a source symbol; medium: any source symbol; else low."""
    source = F.coalesce(F.bool_or(X.is_source_path(F.col("path"))), F.lit(False))
    return ranked.agg(F.when(source & F.lit(is_explicit(question)), "high").when(source, "medium").otherwise("low").alias("confidence"), F.count(F.lit(1)).alias("symbols"))
