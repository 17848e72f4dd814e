"""The engine's queries over the test tables, each with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, changes, context, deps, files, index, metrics, outline, search
from .plans import output, pipe
from .sources import adapters as A
from .sources import project
from .sources.storage import work_dir
from .streaming import watch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_list = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
DOCS = f"""WITH f AS (
  SELECT doc_id, text AS content, 1700000000000 + 1000 * doc_id AS modified_ms, CAST(strlen(text) AS BIGINT) AS byte_size,
    list_extract({_list(A.FOLDERS)}, CAST(doc_id % 8 + 1 AS INTEGER)) || source || '/' || lang || '/doc_' || doc_id || list_extract({_list(A.EXTENSIONS)}, CAST(doc_id % 10 + 1 AS INTEGER)) AS path,
    list_extract(['rust','typescript','python','go','markdown','sql','shell','css','json','unknown'], CAST(doc_id % 10 + 1 AS INTEGER)) AS language,
    CAST(greatest(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END, 1) AS INTEGER) AS line_count
  FROM documents),
l0 AS (SELECT path, language, line_count, unnest(string_split(content, chr(10))) AS line_text, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f),
l AS (SELECT path, language, CAST(n AS INTEGER) AS line_num, line_text FROM l0 WHERE n <= line_count),
w AS (SELECT DISTINCT translate(tok, '{_UP}', '{_LOW}') AS word, path, line_num FROM (SELECT path, line_num, unnest(regexp_extract_all(line_text, '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM l))
"""
_TEST = "(path LIKE 'tests/%' OR path LIKE '%/tests/%' OR path LIKE '%.test.%' OR path LIKE '%.spec.%')"
_REFS = (
    DOCS
    + f""", r AS (SELECT l.path, l.line_num, line_text,
  CASE WHEN path LIKE 'docs/%' OR path LIKE '%.md' OR path LIKE '%.mdx' THEN 'doc'
    WHEN ltrim(line_text) LIKE 'import %' OR ltrim(line_text) LIKE 'use %' OR ltrim(line_text) LIKE 'from %' THEN 'import'
    WHEN ltrim(line_text) LIKE 'export %' THEN 'export' WHEN {_TEST} THEN 'test'
    WHEN contains(line_text, 'the(') OR contains(line_text, 'the::') OR contains(line_text, '.the(') THEN 'call' ELSE 'reference' END AS kind,
  CASE WHEN {_TEST} THEN 5 WHEN path LIKE 'packages/%' AND path LIKE '%/src/%' THEN 0 WHEN path LIKE 'apps/%' AND path LIKE '%/src/%' THEN 1 WHEN path LIKE 'src/%' THEN 2
    WHEN path LIKE 'packages/%' OR path LIKE 'apps/%' THEN 3 WHEN path LIKE 'examples/%' THEN 4 WHEN path LIKE 'docs/%' OR path LIKE '%.md' THEN 6 ELSE 4 END AS path_rank
  FROM l JOIN (SELECT path, line_num FROM w WHERE word = 'the') USING (path, line_num)),
s AS (SELECT *, CASE kind WHEN 'definition' THEN 100 WHEN 'export' THEN 90 WHEN 'import' THEN 75 WHEN 'call' THEN 65 WHEN 'reference' THEN 50 WHEN 'test' THEN 30 ELSE 10 END
  + list_extract([20,16,14,8,0,-40,-30], path_rank + 1) AS score FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, path_rank, path, line_num) AS pos FROM s)
"""
)
_k = lambda t, c: f"'src/{t}/k' || {c} || '.ts'"
EDGES = f"""WITH RECURSIVE e AS (
  SELECT {_k("nation", "n_nationkey")} AS src, {_k("region", "n_regionkey")} AS dst FROM nation
  UNION ALL SELECT {_k("supplier", "s_suppkey")}, {_k("nation", "s_nationkey")} FROM supplier
  UNION ALL SELECT {_k("customer", "c_custkey")}, {_k("nation", "c_nationkey")} FROM customer
  UNION ALL SELECT {_k("orders", "o_orderkey")}, {_k("customer", "o_custkey")} FROM orders),
names AS (SELECT 'region_' || r_regionkey AS name, {_k("region", "r_regionkey")} AS path, 1 AS line_start FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, {_k("nation", "n_nationkey")}, 2 FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, {_k("supplier", "s_suppkey")}, 2 FROM supplier
  UNION ALL SELECT 'customer_' || c_custkey, {_k("customer", "c_custkey")}, 2 FROM customer
  UNION ALL SELECT 'orders_' || o_orderkey, {_k("orders", "o_orderkey")}, 2 FROM orders
  UNION ALL SELECT 'part_' || p_partkey, {_k("part", "p_partkey")}, 1 FROM part),
fan AS (SELECT path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT dst AS path, count(*) AS fan_in FROM e GROUP BY 1) FULL JOIN (SELECT src AS path, count(*) AS fan_out FROM e GROUP BY 1) USING (path)),
hot AS (SELECT path, fan_in || '/' || fan_out AS detail, 'dependency.hotspot' AS rule, CASE WHEN fan_in >= 40 OR fan_out >= 50 THEN 'high' ELSE 'warning' END AS severity,
  CASE WHEN fan_in >= 40 OR fan_out >= 50 THEN 'actionable' ELSE 'risk_note' END AS actionability FROM fan WHERE fan_in >= 15 OR fan_out >= 20),
dead AS (SELECT path, name AS detail, 'dead_code.candidate' AS rule, 'warning' AS severity, 'candidate' AS actionability, line_start FROM names WHERE path NOT IN (SELECT dst FROM e)),
findings AS (SELECT 'dependency.hotspot:' || path AS id, path, rule, severity, actionability, detail, CAST(NULL AS INTEGER) AS line_start FROM hot
  UNION ALL SELECT 'dead_code.candidate:' || path || ':' || line_start || ':' || detail, path, rule, severity, actionability, detail, line_start FROM dead),
o AS (SELECT *, CASE actionability WHEN 'actionable' THEN 0 WHEN 'candidate' THEN 1 WHEN 'risk_note' THEN 2 ELSE 3 END AS arank, CASE severity WHEN 'high' THEN 0 ELSE 1 END AS srank,
  min(CASE actionability WHEN 'actionable' THEN 0 ELSE 1 END) OVER (PARTITION BY path) = 0 AND actionability <> 'actionable' AS secondary FROM findings),
placed AS (SELECT *, row_number() OVER (ORDER BY secondary, arank, srank, path, line_start NULLS FIRST, rule, id) AS place FROM o)
"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark, d):
    return A.document_files(spark, d)


def _keys(spark, d, cyclic=False):
    return A.key_project(spark, d, cyclic)


def _edges(spark, d, cyclic=False):
    project = _keys(spark, d, cyclic)
    return deps.resolve(project, outline.imports(project))[0]


# --- listings and reads


@query(DOCS + ", m AS (SELECT * FROM f WHERE path LIKE 'src/%' AND (path LIKE '%.py' OR path LIKE '%.md') AND line_count BETWEEN 2 AND 60) SELECT path, language, line_count, byte_size, (SELECT count(*) FROM m) AS total FROM m ORDER BY path LIMIT 200")
def files_filtered(spark: SparkSession, d: str) -> DataFrame:
    return files.filtered(_docs(spark, d), "src", "src/*.{py,md}", None, 2, 60)


@query(DOCS + "SELECT language, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(byte_size) AS BIGINT) AS bytes FROM f GROUP BY 1")
def files_by_language(spark, d):
    return files.by_language(_docs(spark, d))


@query(DOCS + ", c AS (SELECT substr(path, 15) AS rest FROM f WHERE path LIKE 'packages/core/%') SELECT DISTINCT split_part(rest, '/', 1) || CASE WHEN contains(rest, '/') THEN '/' ELSE '' END AS name, contains(rest, '/') AS is_dir FROM c ORDER BY is_dir DESC, name")
def list_dir(spark, d):
    return files.children(_docs(spark, d), "packages/core/")


@query(DOCS + "SELECT path FROM f WHERE path LIKE 'src/%.rs' ORDER BY path LIMIT 200")
def glob_star(spark, d):
    return files.globbed(_docs(spark, d), "src/*.rs")


@query(DOCS + "SELECT path FROM f WHERE path LIKE '%.rs' OR path LIKE '%.ts' ORDER BY path LIMIT 200")
def glob_brace(spark, d):
    return files.globbed(_docs(spark, d), "**/*.{rs,ts}")


@query(DOCS + "SELECT path, modified_ms, byte_size, strftime(make_timestamp(modified_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS modified FROM f ORDER BY modified_ms DESC, byte_size DESC, path LIMIT 10")
def recent_topk(spark, d):
    return files.recent(_docs(spark, d))


@query(DOCS + "SELECT (SELECT count(*) FROM f) AS files, count(DISTINCT word) AS words, count(DISTINCT path) AS word_files FROM w")
def status_counts(spark, d):
    return files.status(_docs(spark, d))


@query(DOCS + "SELECT path, language, line_num, line_text FROM l")
def lines_explode(spark, d):
    return A.line_table(_docs(spark, d))


@query(DOCS + "SELECT path, coalesce((SELECT string_agg(line_text, chr(10) ORDER BY line_num) FROM l WHERE l.path = f.path AND line_num BETWEEN 2 AND 4), '') AS text FROM f")
def read_range(spark, d):
    return files.read_range(_docs(spark, d), 2, 4)


_BLANK = r"regexp_replace(line_text, '^\s+|\s+$', '', 'g')"


@query(
    DOCS
    + f""", k AS (SELECT path, line_num, line_text FROM (SELECT *, {_BLANK} AS t FROM l) WHERE t <> '' AND NOT CASE WHEN language IN ('python','shell') THEN t LIKE '#%' WHEN language = 'sql' THEN t LIKE '--%'
  WHEN language = 'markdown' THEN t LIKE '<!--%' WHEN language = 'css' THEN t LIKE '*%' OR t LIKE '/*%' OR t LIKE '%*/' ELSE t LIKE '//%' OR t LIKE '*%' OR t LIKE '/*%' OR t LIKE '%*/' END)
SELECT f.path, coalesce(string_agg(line_text, chr(10) ORDER BY line_num), '') AS text, CAST(count(line_num) AS INTEGER) AS lines FROM f LEFT JOIN k ON f.path = k.path GROUP BY f.path"""
)
def read_compact(spark, d):
    return files.read_compact(_docs(spark, d))


def _fuzzy(q: str) -> str:
    """Fuzzy scores of all paths, a character at a time: of the file name with 10 more, else of the whole path."""
    hit = f"(met < {len(q)} AND substr(t, i + 1, 1) = substr('{q}', met + 1, 1))"
    return (
        DOCS.replace("WITH f", "WITH RECURSIVE f", 1)
        + f""", z AS (SELECT path, whole, t, 0 AS i, 0 AS met, 0 AS run, 0 AS score, '/' AS before FROM (SELECT path, true AS whole, lower(path) AS t FROM f UNION ALL SELECT path, false, split_part(lower(path), '/', -1) FROM f)
  UNION ALL SELECT path, whole, t, i + 1, met + CASE WHEN {hit} THEN 1 ELSE 0 END, CASE WHEN {hit} THEN run + 2 ELSE 0 END,
    score + CASE WHEN {hit} THEN 1 + run + CASE WHEN i = 0 OR before IN ('/', '_', '-') THEN 5 ELSE 0 END ELSE 0 END, substr(t, i + 1, 1) FROM z WHERE i < length(t)),
fz AS (SELECT path, CAST(coalesce(max(score + 10) FILTER (NOT whole), max(score) FILTER (whole)) AS FLOAT) AS score FROM z WHERE i = length(t) AND met = {len(q)} GROUP BY 1)
"""
    )


@query(_fuzzy("webdoc12") + "SELECT path, score FROM fz WHERE score > 0 ORDER BY score DESC, path LIMIT 20")
def path_fuzzy(spark, d):
    return files.fuzzy_paths(_docs(spark, d), "webdoc12")


# --- words and search


def _word_counts(spark, d):
    p = search.word_postings(_docs(spark, d))
    # counted per file first, so that no distinct count needs every posting again
    per_file = p.groupBy("word", "path").agg(F.count(F.lit(1)).alias("k"))
    return per_file.groupBy("word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("files"))


def _trigram_counts(spark, d):
    return search.trigram_postings(_docs(spark, d)).groupBy("tri").agg(F.count(F.lit(1)).alias("files"))


@query(DOCS + "SELECT word, count(*) AS n, count(DISTINCT path) AS files FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def word_postings_topk(spark, d):
    return _word_counts(spark, d).orderBy(F.desc("n"), "word").limit(50)


@query(DOCS + "SELECT word, count(*) AS n, count(DISTINCT path) AS files FROM w GROUP BY 1")
def word_postings_counts(spark, d):
    return _word_counts(spark, d)


@query(DOCS + "SELECT path, line_num FROM w WHERE word = 'the'")
def word_lookup(spark, d):
    return search.word_lines(_docs(spark, d), "The").select("path", "line_num")


@query(DOCS + "SELECT DISTINCT path, line_num FROM w WHERE starts_with(word, 'onan')")
def word_prefix(spark, d):
    return search.prefix_lines(_docs(spark, d), "onan").select("path", "line_num")


@query(_REFS + "SELECT CAST(pos AS INTEGER) AS pos, kind, path, line_num, line_text, CAST(score AS INTEGER) AS score FROM p WHERE pos <= 50")
def word_refs_ranked(spark, d):
    return search.ranked_page(search.word_refs(_docs(spark, d), "the"))


@query(_REFS + "SELECT CAST(pos AS INTEGER) AS pos, kind, path, line_num, line_text, CAST(score AS INTEGER) AS score FROM p WHERE pos > 50 AND pos <= 80")
def word_refs_page2(spark, d):
    return search.ranked_page(search.word_refs(_docs(spark, d), "the"), 50, 30)


@query(_REFS + "SELECT split_part(path, '/', 1) AS facet, count(*) AS n FROM s GROUP BY 1")
def word_path_facets(spark, d):
    return search.path_facets(search.word_refs(_docs(spark, d), "the"))


@query(_REFS + "SELECT kind AS facet, count(*) AS n FROM s GROUP BY 1")
def word_kind_facets(spark, d):
    return search.kind_facets(search.word_refs(_docs(spark, d), "the"))


@query(DOCS + "SELECT path FROM f WHERE " + " AND ".join(f"contains(lower(content), '{t}')" for t in ("tio", "ion", "on ", "n t", " th")))
def trigram_candidates(spark, d):
    return search.trigram_candidates(_docs(spark, d), "tion th")


@query(DOCS + ", t AS (SELECT DISTINCT substr(lower(content), i, 3) AS tri, path FROM (SELECT path, content, unnest(range(1, length(content) - 1)) AS i FROM f)) SELECT tri, count(*) AS files FROM t WHERE regexp_matches(tri, '^[ -~]{3}$') GROUP BY 1 ORDER BY files DESC, tri LIMIT 100")
def trigram_postings_topk(spark, d):
    return _trigram_counts(spark, d).orderBy(F.desc("files"), "tri").limit(100)


@query(DOCS + ", t AS (SELECT DISTINCT substr(lower(content), i, 3) AS tri, path FROM (SELECT path, content, unnest(range(1, length(content) - 1)) AS i FROM f)) SELECT tri, count(*) AS files FROM t WHERE regexp_matches(tri, '^[ -~]{3}$') GROUP BY 1")
def trigram_postings_counts(spark, d):
    return _trigram_counts(spark, d)


@query(
    DOCS
    + """, t AS (SELECT path, line_num, 1 AS tier FROM w WHERE word = 'anon' UNION ALL SELECT path, line_num, 2 FROM w WHERE starts_with(word, 'anon') UNION ALL SELECT path, line_num, 3 FROM l WHERE contains(lower(line_text), 'anon'))
SELECT path, line_num, line_text, CAST(tier AS INTEGER) AS tier FROM (SELECT path, line_num, min(tier) AS tier FROM t GROUP BY 1, 2) JOIN l USING (path, line_num) ORDER BY tier, path, line_num LIMIT 100"""
)
def search_single_tiered(spark, d):
    return search.search(_docs(spark, d), "anon", 100)


@query(DOCS + "SELECT path, line_num, line_text FROM l WHERE contains(lower(line_text), 'the') AND contains(lower(line_text), 'anon') ORDER BY path, line_num LIMIT 100")
def search_multi(spark, d):
    return search.search(_docs(spark, d), "the anon", 100)


@query(DOCS + "SELECT path, line_num, line_text FROM l WHERE regexp_matches(line_text, 'on[a-z]{2} the') ORDER BY path, line_num LIMIT 200")
def search_regex(spark, d):
    return search.search_regex(_docs(spark, d), "on[a-z]{2} the", 200)


_USES = """, u AS (SELECT 'src/customer/k' || c_custkey || '.ts' AS path, 'customer_' || c_custkey AS name FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'src/supplier/k' || s_suppkey || '.ts', 'supplier_' || s_suppkey FROM supplier WHERE s_nationkey = 7),
g AS (SELECT path, 1 AS line_num, 'import { nation_7 } from "../nation/k7";' AS line_text, CAST(NULL AS VARCHAR) AS scope FROM u UNION ALL SELECT path, 3, '  nation_7();', name FROM u UNION ALL SELECT 'src/nation/k7.ts', 2, 'export function nation_7(row) {', 'nation_7')
"""


@query(EDGES + _USES + ", top AS (SELECT * FROM g ORDER BY path, line_num LIMIT 50) SELECT path, CAST(line_num AS INTEGER) AS line_num, line_text, scope, CASE WHEN scope IS NOT NULL THEN 'function' END AS scope_kind FROM top")
def search_scoped(spark, d):
    p = _keys(spark, d)
    return search.text_search(p, outline.symbols_naming(p, "nation_7"), "nation_7", 50, glob="src/*.ts", compact=True)


@query(EDGES + _USES + "SELECT path, CAST(line_num AS INTEGER) AS line_num, line_text FROM g WHERE path <> 'src/nation/k7.ts' ORDER BY path, line_num LIMIT 30")
def callers_anti(spark, d):
    p = _keys(spark, d)
    return search.callers(p, outline.symbols_naming(p, "nation_7"), "nation_7")


# --- symbols


@query("SELECT 'src/nation/k7.ts' AS path, 'nation_7' AS name, 'function' AS kind, CAST(2 AS INTEGER) AS line_start, CAST(4 AS INTEGER) AS line_end, '(row)' AS detail")
def symbol_defs(spark, d):
    return outline.definitions(outline.symbols_naming(_keys(spark, d), "nation_7"), "nation_7")


@query(
    EDGES
    + """, c AS (SELECT path, name, line_start, replace(name, '_', '') AS n FROM names),
x AS (SELECT path, name, line_start, 70 + CASE WHEN n = 'nation7' THEN 1000 WHEN contains(n, 'nation7') THEN 700 WHEN strlen(n) >= 4 AND contains('nation7', n) THEN 320 WHEN regexp_matches(n, 'n.*a.*t.*i.*o.*n.*7') THEN 220 END AS raw FROM c),
top AS (SELECT * FROM x WHERE raw IS NOT NULL ORDER BY raw DESC, path, line_start, name LIMIT 50)
SELECT path, name, 'function' AS kind, CAST(line_start AS INTEGER) AS line_start, CAST(raw AS INTEGER) AS raw_score, CAST(raw AS DOUBLE) / (SELECT max(raw) FROM top) AS score FROM top"""
)
def symbol_search(spark, d):
    return outline.symbol_search(outline.symbols(_keys(spark, d)), "nation 7")


@query("SELECT CAST(ord AS INTEGER) AS ord, name, kind, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end FROM (SELECT 0 AS ord, '../nation/k' || c_nationkey AS name, 'import' AS kind, 1 AS a, 1 AS b FROM customer WHERE c_custkey = 5 UNION ALL SELECT 1, 'customer_5', 'function', 2, 4)")
def outline_rows(spark, d):
    return outline.symbols(_keys(spark, d).where(F.col("path") == "src/customer/k5.ts")).select("ord", "name", "kind", "line_start", "line_end")


@query(EDGES + "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'function' AS kind FROM names UNION ALL SELECT 'import' FROM e) GROUP BY 1")
def symbol_kind_counts(spark, d):
    return outline.symbols(_keys(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- dependencies


@query(EDGES + "SELECT dst AS path FROM e WHERE src = 'src/customer/k5.ts' ORDER BY 1")
def deps_direct(spark, d):
    return deps.depends_on(_edges(spark, d), "src/customer/k5.ts")


@query(EDGES + "SELECT src AS path FROM e WHERE dst = 'src/nation/k7.ts' ORDER BY 1")
def deps_reverse(spark, d):
    return deps.imported_by(_edges(spark, d), "src/nation/k7.ts")


_REACH = ", r AS (SELECT '{0}' AS path, 0 AS depth UNION SELECT e.{2}, r.depth + 1 FROM r JOIN e ON e.{1} = r.path) SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY 1"


@query(EDGES + _REACH.format("src/orders/k10.ts", "src", "dst"))
def deps_transitive(spark, d):
    return deps.transitive(spark, _edges(spark, d), "src/orders/k10.ts")


@query(EDGES + _REACH.format("src/region/k1.ts", "dst", "src"))
def deps_transitive_reverse(spark, d):
    return deps.transitive(spark, _edges(spark, d), "src/region/k1.ts", reverse=True)


@query(
    r"""WITH h AS (SELECT 'web/p_' || page_id || '.ts' AS path, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages),
x AS (SELECT path, unnest(links) AS import, generate_subscripts(links, 1) AS line FROM h)
SELECT path, import, CAST(min(line) AS INTEGER) AS line_start FROM x WHERE starts_with(import, '/') OR starts_with(import, './') OR starts_with(import, '../') GROUP BY 1, 2"""
)
def unresolved_imports(spark, d):
    p = A.page_files(spark, d)
    return deps.resolve(p, outline.imports(p))[1]


@query(
    """WITH RECURSIVE e AS (SELECT 'src/nation/k' || n_nationkey || '.ts' AS src, 'src/region/k' || n_regionkey || '.ts' AS dst FROM nation UNION ALL SELECT 'src/region/k' || r_regionkey || '.ts', 'src/nation/k' || r_regionkey || '.ts' FROM region),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
s AS (SELECT x.a AS path, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT min(least(path, other)) AS component, path FROM s WHERE path <> other GROUP BY path"""
)
def scc_cycles(spark, d):
    return deps.components(spark, _edges(spark, d, True))


# --- audit


@query(EDGES + "SELECT path, severity, actionability, detail FROM hot")
def hotspots(spark, d):
    return audit.hotspots(_edges(spark, d)).select("path", "severity", "actionability", "detail")


@query(DOCS + "SELECT path, CASE WHEN line_count >= 60 THEN 'high' ELSE 'warning' END AS severity FROM f WHERE line_count >= 20")
def large_files(spark, d):
    return audit.large_files(A.file_table(_docs(spark, d)), (20, 60)).select("path", "severity")


@query(EDGES + "SELECT path, name AS detail, CAST(2 AS INTEGER) AS line_start, 'warning' AS severity FROM names WHERE line_start = 2")
def large_symbols(spark, d):
    return audit.large_symbols(outline.symbols(_keys(spark, d)), (3, 5)).select("path", "detail", "line_start", "severity")


def _dead(spark, d):
    p = _keys(spark, d)
    return audit.dead_code(outline.symbols(p), search.word_postings(p))


def _findings(spark, d):
    p = _keys(spark, d)
    counts = outline.symbols(p).groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    return audit.hotspots(_edges(spark, d), counts).unionByName(_dead(spark, d))


@query(EDGES + "SELECT path, detail, CAST(line_start AS INTEGER) AS line_start FROM dead")
def dead_code(spark, d):
    return _dead(spark, d).select("path", "detail", "line_start")


@query(EDGES + "SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (actionability = 'actionable') AS actionable, count(*) = 0 AS passed FROM findings")
def audit_summary(spark, d):
    return audit.summary(_findings(spark, d))


@query(EDGES + "SELECT rule, severity, count(*) AS n, arg_min(path, place) AS top_path FROM placed GROUP BY 1, 2")
def audit_rule_groups(spark, d):
    return audit.rule_groups(_findings(spark, d))


@query(EDGES + "SELECT id, path, rule, severity, actionability, detail, secondary FROM placed WHERE place <= 100")
def audit_ordered(spark, d):
    return audit.ordered(_findings(spark, d)).select("id", "path", "rule", "severity", "actionability", "detail", "secondary")


@query(EDGES + "SELECT id, actionability FROM findings WHERE rule = 'dead_code.candidate'")
def audit_dead_code_ids(spark, d):
    return _dead(spark, d).select("id", "actionability")


@query(
    EDGES
    + """, t AS (SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high FROM findings),
g AS (SELECT count(*) AS returned, count(*) FILTER (actionability = 'actionable' AND NOT secondary) AS actionable, count(*) FILTER (actionability = 'candidate' AND NOT secondary) AS candidates,
  count(*) FILTER (actionability = 'risk_note' AND NOT secondary) AS risk_notes, count(*) FILTER (actionability = 'expected' AND NOT secondary) AS expected, count(*) FILTER (secondary) AS secondary FROM placed WHERE place <= 100)
SELECT CASE total WHEN 0 THEN 'pass' ELSE 'warn' END AS verdict, total, returned, high, total - high AS warnings, actionable, candidates, risk_notes, expected, secondary, total > 100 AS truncated FROM t, g"""
)
def audit_report(spark, d):
    return audit.report(_findings(spark, d))


@query(
    EDGES
    + """SELECT severity, rule, path, line_start AS line, CASE rule WHEN 'dependency.hotspot' THEN 'Dependency hotspot' ELSE 'Possible unused function `' || detail || '`' END AS title, CAST(1 AS BIGINT) AS instances
FROM placed WHERE place <= 12"""
)
def audit_report_rows(spark, d):
    return audit.report_rows(_findings(spark, d))


_CHANGED = "c AS (SELECT 'src/customer/k' || c_custkey || '.ts' AS path FROM customer WHERE c_custkey % 100 = 0)"


@query(EDGES + f", {_CHANGED}, near AS (SELECT path FROM c UNION SELECT dst FROM e WHERE src IN (SELECT path FROM c) UNION SELECT src FROM e WHERE dst IN (SELECT path FROM c)) SELECT path, rule, detail FROM findings WHERE path IN (SELECT path FROM near)")
def audit_scope_since(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 100 = 0").select(F.concat(F.lit("src/customer/k"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"))
    return audit.in_scope(_findings(spark, d), c, _edges(spark, d)).select("path", "rule", "detail")


# --- pipe language


@query(DOCS + "SELECT path, line_num, line_text FROM l WHERE path LIKE 'src/%.py' AND contains(lower(line_text), 'in the') ORDER BY path, line_num LIMIT 5")
def pipeline_glob_search_limit(spark, d):
    return pipe.run(_docs(spark, d), "glob src/*.py | search in the | limit 5")


@query(DOCS + "SELECT 'files' AS kind, count(*) AS n FROM f WHERE path LIKE 'docs/%.md' AND contains(lower(path), '/en/')")
def pipeline_count(spark, d):
    return pipe.run(_docs(spark, d), "glob docs/*.md | filter /EN/ | count")


@query(EDGES + "SELECT path, dst FROM (SELECT src AS path, dst FROM e WHERE src LIKE 'src/customer/k1%.ts')")
def pipeline_deps(spark, d):
    return pipe.run(_keys(spark, d), "glob src/customer/k1*.ts | deps", edges=_edges(spark, d))


@query(_fuzzy("webdoc12") + "SELECT path FROM fz WHERE score > 0 ORDER BY score DESC, path LIMIT 3")
def pipeline_fuzzy_limit(spark, d):
    return pipe.run(_docs(spark, d), "fuzzy webdoc12 | limit 3")


@query(ORACLE["search_single_tiered"].replace("SELECT path, line_num, line_text, CAST(tier AS INTEGER) AS tier", "SELECT path, line_num, line_text").replace("LIMIT 100", "LIMIT 7"))
def pipeline_search_limit(spark, d):
    return pipe.run(_docs(spark, d), "search anon | limit 7")


@query("SELECT 'nonsense' IS NULL AS none, 'unknown command: nonsense' AS error")
def pipeline_error(spark, d):
    return pipe.run_or_error(spark, _docs(spark, d), "glob src/*.py | nonsense").select(F.lit(False).alias("none"), "error")


# --- imports by suffix, traces, definitions among references


@query("SELECT 'app/c' || c_custkey || '.py' AS src, 'lib/n' || c_nationkey || '/__init__.py' AS dst FROM customer")
def deps_suffix_index(spark, d):
    p = A.module_files(spark, d)
    return deps.resolve(p, outline.imports(p))[0]


@query(EDGES + "SELECT src AS path, 'imported_by' AS relation, CAST(1 AS INTEGER) AS depth FROM e WHERE dst = 'src/nation/k7.ts'")
def trace_imported_by(spark, d):
    p = _keys(spark, d)
    return deps.trace(spark, *deps.resolve(p, outline.imports(p)), "src/nation/k7.ts")


@query(EDGES + ", r AS (SELECT 'src/orders/k10.ts' AS path, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.path) SELECT path, 'depends_on' AS relation, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY 1")
def trace_depends_on(spark, d):
    p = _keys(spark, d)
    return deps.trace(spark, *deps.resolve(p, outline.imports(p)), "src/orders/k10.ts", "depends_on", True)


@query(
    EDGES
    + _USES
    + """SELECT path, CAST(line_num AS INTEGER) AS line_num, line_text, CASE line_num WHEN 1 THEN 'import' WHEN 3 THEN 'call' ELSE 'definition' END AS kind, CAST(CASE line_num WHEN 1 THEN 75 WHEN 3 THEN 65 ELSE 100 END + 14 AS INTEGER) AS score FROM g"""
)
def word_refs_definitions(spark, d):
    p = _keys(spark, d)
    return search.word_refs(p, "nation_7", outline.symbols_naming(p, "nation_7")).select("path", "line_num", "line_text", "kind", "score")


# --- reads and outlines with their guards


@query(DOCS + "SELECT path, CASE WHEN doc_id % 3 = 0 THEN '' ELSE content END AS text, doc_id % 3 = 0 AS unchanged FROM f WHERE path LIKE 'docs/%'")
def read_if_hash(spark, d):
    f = _docs(spark, d).where(F.col("path").startswith("docs/")).withColumn("byte_size", F.octet_length("content").cast("long"))
    h = f.select("path", project.content_hashes(F.col("content")).alias("known"), "doc_id")
    # a read per hash that a client has: every third file's own
    out = files.read(f, f).join(h, "path")
    same = (F.col("doc_id") % 3 == 0) & (F.upper("known") == F.upper("hash"))
    return out.select("path", F.when(same, "").otherwise(F.col("text")).alias("text"), same.alias("unchanged"))


@query(EDGES + "SELECT 'src/customer/k5.ts' AS path, 'typescript' AS language, CAST(4 AS INTEGER) AS line_count, [split_part(replace(dst, 'src/', '../'), '.ts', 1)] AS imports, CAST(1 AS INTEGER) AS symbol_count, 'customer_5' AS name FROM e WHERE src = 'src/customer/k5.ts'")
def outline_answer(spark, d):
    p = _keys(spark, d)
    only = p.where(F.col("path") == "src/customer/k5.ts")
    lost = deps.resolve(p, outline.imports(only))[1]
    return files.outline_answer(p, outline.symbols(only), lost, "src/customer/k5.ts").select("path", "language", "line_count", "imports", "symbol_count", F.element_at("symbols", 1)["name"].alias("name"))


@query(DOCS + "SELECT path, language, line_count, byte_size FROM f")
def file_map(spark, d):
    return files.file_map(_docs(spark, d))


# --- the stored index


def _index(spark, files_, *tables):
    return index.build(spark, files_, work_dir(spark, "index"), tables or index.TABLES)


@query(DOCS + "SELECT l.path, line_num, line_text FROM l JOIN w USING (path, line_num) WHERE word = 'the' AND l.path LIKE 'docs/%'")
def index_word_lookup(spark, d):
    tables = index.opened(spark, _index(spark, _docs(spark, d).select("path", "content", "modified_ms"), "files", "contents", "words"))
    return index.lines_of(tables, index.word_lines(tables, "The").where(F.col("path").startswith("docs/")))


@query(ORACLE["trigram_candidates"])
def index_trigram_candidates(spark, d):
    tables = index.opened(spark, _index(spark, _docs(spark, d).select("path", "content", "modified_ms"), "trigrams"))
    return index.trigram_candidates(tables, "tion th")


@query(EDGES + "SELECT src AS path FROM e WHERE dst = 'src/nation/k7.ts'")
def index_imported_by(spark, d):
    keys = _keys(spark, d).withColumn("modified_ms", F.lit(0).cast("long"))
    tables = index.opened(spark, _index(spark, keys, "files", "symbols", "imports", "edges", "unresolved"))
    return deps.imported_by(tables["edges"], "src/nation/k7.ts")


def _moved(spark, d):
    """The documents as files, and as a walk finds them later: some gone, changed, touched, new."""
    f = _docs(spark, d).select("doc_id", "path", "content", "modified_ms")
    walked = f.where("doc_id % 7 <> 0").select("doc_id", "path", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" fresh"))).otherwise(F.col("content")).alias("content"), (F.col("modified_ms") + F.when((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0), 1).otherwise(0)).alias("modified_ms"))
    walked = walked.union(walked.where("doc_id % 11 = 0").withColumn("path", F.concat(F.lit("new/"), F.col("path"))))
    return f.drop("doc_id"), walked.select("path", F.octet_length("content").cast("long").alias("byte_size"), "modified_ms"), walked.select("path", "content")


_LATER = """, a AS (SELECT path, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'remove' WHEN doc_id % 5 = 0 THEN 'reindex' WHEN doc_id % 3 = 0 THEN 'metadata' END AS action FROM f
  UNION ALL SELECT 'new/' || path, doc_id, 'add' FROM f WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0)
"""


@query(DOCS + _LATER + "SELECT path, action FROM a WHERE action IS NOT NULL")
def index_refresh_plan(spark, d):
    f, meta, contents = _moved(spark, d)
    tables = index.opened(spark, _index(spark, f, "files"))
    return index.plan(tables, meta, contents)


@query(DOCS + _LATER + "SELECT path, action FROM a WHERE action IS NOT NULL AND (path LIKE 'docs/%' OR path LIKE 'new/src/%')")
def index_refresh_paths(spark, d):
    f, meta, contents = _moved(spark, d)
    tables = index.opened(spark, _index(spark, f, "files"))
    return index.plan(tables, meta, contents, spark.createDataFrame([("docs",), ("new/src/",)], "path string"))


@query(DOCS + _LATER + "SELECT word, count(*) AS n FROM (SELECT w.word, a.path FROM w JOIN a USING (path) WHERE word IN ('the', 'and') AND action IS DISTINCT FROM 'remove' AND action IS DISTINCT FROM 'add' UNION ALL SELECT 'fresh', path FROM a JOIN f USING (doc_id) WHERE doc_id % 5 = 0 AND action <> 'remove' UNION ALL SELECT w.word, a.path FROM a JOIN w ON a.path = 'new/' || w.path WHERE action = 'add' AND word IN ('the', 'and')) GROUP BY 1".replace("UNION ALL SELECT 'fresh', path FROM a JOIN f USING (doc_id)", "UNION ALL SELECT 'fresh', a.path FROM a JOIN f USING (doc_id)"))
def index_refreshed_words(spark, d):
    f, meta, contents = _moved(spark, d)
    old = _index(spark, f, "files", "contents", "words", "versions")
    new, _ = index.refresh(spark, old, meta, contents, work_dir(spark, "index"))
    return index.opened(spark, new)["words"].where("word in ('the', 'and', 'fresh')").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(DOCS + "SELECT op, count(*) AS n FROM (SELECT 'Insert' AS op FROM f UNION ALL SELECT 'Delete' FROM f WHERE doc_id % 7 = 0) GROUP BY 1 UNION ALL SELECT 'files', count(*) FROM f WHERE doc_id % 7 <> 0 UNION ALL SELECT 'lines of the', count(*) FROM w JOIN f USING (path) WHERE word = 'the' AND doc_id % 7 <> 0")
def index_remove(spark, d):
    f = _docs(spark, d)
    gone = f.where("doc_id % 7 = 0").select("path")
    new = index.remove(spark, _index(spark, f.select("path", "content", "modified_ms"), "files", "words", "versions"), gone, work_dir(spark, "index"))
    t = index.opened(spark, new)
    ops = t["versions"].groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    more = t["files"].agg(F.lit("files").alias("op"), F.count(F.lit(1)).alias("n")).union(index.word_lines(t, "the").agg(F.lit("lines of the").alias("op"), F.count(F.lit(1)).alias("n")))
    return ops.union(more)


# --- versions, refresh, metrics

_VERSIONS = "WITH v AS (SELECT 'users/' || user_id AS path, event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'error' THEN 'Delete' ELSE 'Replace' END AS op, CAST(floor(value) AS BIGINT) AS size FROM events)"


@query(_VERSIONS + "SELECT path, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(size, seq) AS size FROM v WHERE seq > 5000 GROUP BY 1")
def changes_since(spark, d):
    return changes.changes_since(A.event_versions(spark, d), 5000)


@query(_VERSIONS + "SELECT path, seq, op, size FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= 20")
def version_retention(spark, d):
    return changes.retained(A.event_versions(spark, d), 20)


@query(_VERSIONS + "SELECT max(seq) AS seq FROM v")
def current_seq(spark, d):
    return changes.current_seq(A.event_versions(spark, d))


@query(DOCS + "SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'remove' WHEN doc_id % 5 = 0 THEN 'reindex' WHEN doc_id % 3 = 0 THEN 'metadata' ELSE 'keep' END AS action FROM f UNION ALL SELECT 'add' FROM f WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0) GROUP BY 1")
def refresh_diff(spark, d):
    f = _docs(spark, d)
    walked = f.where("doc_id % 7 <> 0").select("doc_id", "path", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content"), (F.col("modified_ms") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("modified_ms"))
    walked = walked.union(walked.where("doc_id % 11 = 0").withColumn("path", F.concat(F.lit("new/"), F.col("path"))))
    return changes.refresh_plan(f, walked).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_RANKS = """WITH x AS (SELECT l_orderkey AS c, l_partkey AS item, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM lineitem),
want AS (SELECT DISTINCT c, item FROM x WHERE flag = 'R'), got AS (SELECT c, item, min(rank) AS rank FROM x GROUP BY 1, 2),
h AS (SELECT want.c, count(*) AS n, count(*) FILTER (rank <= 5) AS r5, count(*) FILTER (rank <= 10) AS r10, min(rank) AS best FROM want LEFT JOIN got USING (c, item) GROUP BY 1),
sc AS (SELECT c AS "case", CAST(r5 AS DOUBLE) / n AS recall_5, CAST(r10 AS DOUBLE) / n AS recall_10, CAST(coalesce(1.0 / best, 0) AS DOUBLE) AS reciprocal_rank FROM h)
"""


def _scores(spark, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber"))
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("item"), "l_returnflag", rank.alias("rank"))
    return metrics.rank_scores(x.where("l_returnflag = 'R'").select("case", "item"), x.select("case", "item", "rank"))


@query(_RANKS + "SELECT * FROM sc")
def rank_scores(spark, d):
    return _scores(spark, d)


@query(_RANKS + "SELECT count(*) AS cases, round(avg(recall_5), 9) AS recall_5, round(avg(recall_10), 9) AS recall_10, round(avg(reciprocal_rank), 9) AS mrr, count(*) FILTER (recall_10 = 1) AS correct FROM sc")
def retrieval_metrics(spark, d):
    s = metrics.retrieval_summary(_scores(spark, d))
    return s.select("cases", *[F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "mrr")], "correct")


@query(
    """WITH v AS (SELECT lang AS rule, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'correct_actionable' ELSE 'correct_not_actionable' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT rule, count(*) AS labels, count(verdict) AS n, count(*) FILTER (verdict IN ('correct_actionable', 'correct_not_actionable')) AS r, count(*) FILTER (verdict = 'correct_actionable') AS a, count(*) FILTER (verdict = 'false_positive') AS fp FROM v GROUP BY 1)
SELECT rule, labels, CAST(r AS DOUBLE) / nullif(n, 0) AS structural_precision, CAST(a AS DOUBLE) / nullif(n, 0) AS actionable_precision, CAST(fp AS DOUBLE) / nullif(n, 0) AS false_discovery_rate, CAST(n AS DOUBLE) / labels AS coverage FROM g"""
)
def audit_precision(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("rule"))
    v = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "correct_actionable").otherwise("correct_not_actionable")
    return metrics.audit_scores(docs.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").select("rule", v.alias("verdict")))


@query(DOCS + "SELECT path, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM f")
def token_estimate(spark, d):
    return metrics.estimated_tokens(_docs(spark, d))


# --- context bundles and more of the pipe language


@query()
def brief_symbols(spark, d):
    p = _keys(spark, d)
    return context.bodies(p, context.ranked_in(p, "where does nation_7 call region"))


@query()
def brief_snippets(spark, d):
    p = _keys(spark, d)
    q = "where does nation_7 call region"
    return context.snippets(p, context.ranked_in(p, q), q)


@query(EDGES + "SELECT CASE WHEN count(*) > 0 THEN 'high' ELSE 'low' END AS confidence, count(*) AS symbols FROM names WHERE path LIKE 'src/nation/%' AND name = 'nation_7'")
def brief_confidence(spark, d):
    q = "where does nation_7 call region"
    return context.confidence(context.ranked_in(_keys(spark, d), q, glob="src/nation/k7.ts"), q)


@query(EDGES + "SELECT path, name, kind, CAST(line_start AS INTEGER) AS line_start FROM (SELECT path, name, 'function' AS kind, line_start FROM names WHERE path LIKE 'src/nation/%.ts' UNION ALL SELECT src, '../region/' || split_part(split_part(dst, '/', 3), '.', 1), 'import', 1 FROM e WHERE src LIKE 'src/nation/%.ts')")
def pipeline_outline(spark, d):
    p = _keys(spark, d)
    return pipe.run(p, "glob src/nation/*.ts | outline", symbols=outline.symbols(p)).select("path", "name", "kind", "line_start")


@query(DOCS + "SELECT path, content FROM f WHERE path LIKE 'docs/%.md' ORDER BY path LIMIT 3")
def pipeline_read(spark, d):
    return pipe.run(_docs(spark, d), "glob docs/*.md | limit 3 | read")


@query(DOCS + "SELECT path, line_num, line_text FROM l WHERE path = (SELECT min(path) FROM f WHERE path LIKE 'src/%') AND line_num = 1")
def read_line(spark, d):
    f = _docs(spark, d)
    first = f.where(F.col("path").startswith("src/")).agg(F.min("path").alias("path"))
    return A.line_table(f.join(F.broadcast(first), "path", "left_semi")).where("line_num = 1").select("path", "line_num", "line_text")


@query(DOCS + "SELECT path, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS cell FROM (SELECT path, trim(regexp_replace(line_text, '\\s+', ' ', 'g')) AS t FROM l)")
def compact_cells(spark, d):
    return A.line_table(_docs(spark, d)).select("path", output.compact(F.col("line_text")).alias("cell"))


@query(_VERSIONS + "SELECT op, count(*) AS n, max(seq) AS seq FROM (SELECT path, arg_max(op, seq) AS op, max(seq) AS seq FROM v GROUP BY 1) GROUP BY 1")
def latest_operations(spark, d):
    return watch.latest_changes(A.event_versions(spark, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
