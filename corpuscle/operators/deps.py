"""The dependency graph: imports resolved to files, reachability, cycles.

An import becomes scored candidate paths, and the candidates are joined with the files; the best of each import is its edge.
Imports that no candidate meets are looked up by path suffix, as an equi-join on every suffix of a path.
"""

from __future__ import annotations

import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.storage import shared_folder

# fixed values: extensions and index files that an import may leave out, in order
EXTENSIONS = "rs py ts tsx mts cts js jsx mjs cjs go java rb php zig c h cpp hpp cc hh cxx hxx".split()
INDEX_FILES = ("mod.rs", "index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py")
RUNTIME_SOURCES = {".js": ("ts", "tsx"), ".jsx": ("tsx",), ".mjs": ("mts",), ".cjs": ("cts",)}
SCRIPTS = ("javascript", "typescript")


def is_local(spec: str) -> bool:
    return spec in (".", "..") or spec.startswith(("./", "../", "/"))


def terms(text: str) -> list[str]:
    """What an import's text names: a quoted or bracketed path, a module, a use path."""
    t = text.strip()
    if m := re.search(r"[\"']([^\"']+)[\"']", t):
        t = m[1]
    elif m := re.search(r"<([^>]+)>", t):
        t = m[1]
    elif m := re.match(r"from\s+(\S+)\s+import", t):
        t = m[1]
    elif m := re.match(r"import\s+([\w.]+)", t):
        t = m[1]
    elif m := re.match(r"(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)", t):
        t = m[1].removeprefix("crate::").removeprefix("self::").rstrip(":")
    t = re.split(r"[?#]", t)[0].rstrip(";").strip()
    t = t.replace("::", "/")
    if not is_local(t):
        t = t.replace(".", "/")
    return sorted({t, t.rsplit("/", 1)[-1]} if t and not is_local(t) else {t} if t else set())


# how a file meets a name, and what that scores: as it is, without its extension, as a folder's index file
EXACT, WITHOUT_EXTENSION, INDEX = 1200, 1100, 1000


def candidates(importer: str, term: str) -> list[tuple[int, str, bool]]:
    """(score, name, whether only the very path counts) that a term may mean, seen from a file.

    For the names that may lack an extension or an index file the score is what is added to EXACT and so on.
    """
    folder = posixpath.dirname(importer)
    if is_local(term):
        base = posixpath.normpath(posixpath.join(folder, term)) if not term.startswith("/") else posixpath.normpath(term).lstrip("/")
        bases = [] if base.startswith("..") else [base.lstrip("/") if base != "." else ""]
    else:
        bases = list(dict.fromkeys([term, f"{folder}/{term}" if folder else term, f"src/{term}"]))
    out = []
    for base in bases:
        more = 50 * base.count("/") + min(len(base), 80)
        out.append((more, base, False))
        stem, ext = posixpath.splitext(base)
        out += [(1190 - i + more, f"{stem}.{e}", True) for i, e in enumerate(RUNTIME_SOURCES.get(ext, ()))]
    return out


def file_names(files: DataFrame) -> DataFrame:
    """(name, how, path): the names that an import may call a file by."""
    path = F.col("path")
    ext, last = F.substring_index(path, ".", -1), F.substring_index(path, "/", -1)
    stem = F.when(path.contains(".") & ext.isin(*EXTENSIONS), F.regexp_replace(path, r"\.[^.]*$", ""))
    folder = F.when(last.isin(*INDEX_FILES), F.regexp_replace(path, r"/?[^/]*$", ""))
    names = F.array(*[F.struct(n.alias("name"), F.lit(how).alias("how")) for n, how in ((path, EXACT), (stem, WITHOUT_EXTENSION), (folder, INDEX))])
    return files.select(F.explode(names).alias("n"), F.col("path").alias("dst")).select("n.name", "n.how", "dst").where("name is not null")


def use_leaves(text: str) -> list[list[str]]:
    """The paths that a Rust use statement names, braces expanded, as lists of segments."""
    t = re.sub(r"^(?:pub(?:\([^)]*\))?\s+)?use\s+", "", text.strip()).rstrip(";").strip()

    def expand(t: str) -> list[str]:
        a = t.find("{")
        if a < 0:
            return [t]
        depth, parts, start = 0, [], a + 1
        for i in range(a, len(t)):
            depth += (t[i] == "{") - (t[i] == "}")
            if depth == 1 and t[i] == "," or depth == 0:
                parts.append(t[start:i].strip())
                start = i + 1
            if depth == 0:
                break
        return [t[:a] + x for p in parts if p for x in expand(p)]

    leaves = [re.split(r"\s+as\s+", x)[0].strip().split("::") for x in expand(t)]
    return [[s for s in leaf if s and s not in ("*",)] for leaf in leaves]


def use_candidates(importer: str, leaf: list[str]) -> list[tuple[int, str, bool]]:
    """Files of a use path's modules, the longest first; a module is a file or a folder with mod.rs."""
    folder, name = posixpath.split(importer)
    # where the file's own submodules are
    own = folder if name in ("mod.rs", "main.rs", "lib.rs") else f"{folder}/{name.removesuffix('.rs')}".lstrip("/")
    root = importer[: importer.rfind("src/") + 4].rstrip("/") if "src/" in importer else folder
    if not leaf:
        return []
    if leaf[0] == "crate":
        base, rest = root, leaf[1:]
    elif leaf[0] == "self":
        base, rest = own, leaf[1:]
    elif leaf[0] == "super":
        base, rest = own, leaf
        while rest and rest[0] == "super":
            base, rest = posixpath.dirname(base), rest[1:]
    else:
        base, rest = root, leaf
    out = []
    for n in range(len(rest), 0, -1):
        stem = "/".join([x for x in (base, *rest[:n]) if x])
        out += [(5000 + 10 * n + 1, f"{stem}.rs", True), (5000 + 10 * n, f"{stem}/mod.rs", True)]
    return out


_OUT = "path string, ord int, part int, import_text string, line int, local boolean, term string, score int, name string, exact boolean"


def _expand(it):
    for b in it:
        rows = []
        for path, language, k, text, line in zip(*(b.column(c).to_pylist() for c in ("path", "language", "ord", "import_text", "line"))):
            if language == "rust":
                for part, leaf in enumerate(use_leaves(text)):
                    rows += [(path, k, part, text, line, False, "/".join(leaf), *c) for c in use_candidates(path, leaf)]
                continue
            found = terms(text)
            local = any(map(is_local, found))
            if language in SCRIPTS and not local:
                continue
            rows += [(path, k, 0, text, line, local, t, *c) for t in found for c in candidates(path, t)]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*rows), kinds)], names=["path", "ord", "part", "import_text", "line", "local", "term", "score", "name", "exact"])


def resolve(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) edges without duplicates or loops, and local imports that mean no file: (path, import, line_start)."""
    imports = _checkpoint(imports.sparkSession, imports)  # files are outlined once
    asked = imports.withColumn("language", X.language(F.col("path"))).mapInArrow(_expand, _OUT)
    hits = asked.join(file_names(files), "name").where(f"dst <> path and (not exact or how = {EXACT})")
    score = F.when(F.col("exact"), F.col("score")).otherwise(F.col("score") + F.col("how"))
    best = hits.groupBy("path", "ord", "part").agg(F.min_by("dst", F.struct((-score).alias("s"), "dst")).alias("dst"))
    # what has no exact candidate: by suffix of a path, of its stem or of an index file's folder, unless the import is local
    rest = asked.select("path", "ord", "part", "term", "local").distinct().join(best, ["path", "ord", "part"], "left_anti")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")

    def tails(whole):
        parts = F.split(whole, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    def scored(whole, equal: int, ends: int):
        return F.transform(tails(whole), lambda t: F.struct(t.alias("term"), F.when(t == whole, equal).otherwise(ends).alias("score")))

    # an index file also goes by its folder
    folder, is_index = F.regexp_replace("path", r"/?[^/]*$", ""), F.substring_index("path", "/", -1).isin(*INDEX_FILES)
    index = F.filter(scored(folder, 650, 650), lambda k: is_index & (k["term"] != ""))
    keys = files.select(F.col("path").alias("dst"), F.explode(F.concat(scored(F.col("path"), 1000, 800), scored(stem, 950, 750), index)).alias("k")).select("dst", "k.term", "k.score")
    # longer terms say more
    score = F.col("score") + 50 * (F.size(F.split("term", "/")) - 1) + F.least(F.octet_length("term"), F.lit(80))
    by_tail = rest.where("not local").join(keys, "term").where("dst <> path").groupBy("path", "ord", "part").agg(F.min_by("dst", F.struct((-score).alias("s"), "dst")).alias("dst"))
    edges = best.union(by_tail).select(F.col("path").alias("src"), "dst").distinct()
    lost = asked.where("local").select("path", "ord", "import_text", "line").distinct().join(best.select("path", "ord"), ["path", "ord"], "left_anti").where(X.language(F.col("path")) != "rust")
    return edges, lost.select("path", F.col("import_text").alias("import"), F.col("line").alias("line_start")).distinct()


def unresolved_in_order(lost: DataFrame) -> DataFrame:
    return lost.orderBy("path", F.col("line_start").asc_nulls_first(), "import")


def depends_on(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("path")).distinct().orderBy("path")


def imported_by(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path")).distinct().orderBy("path")


def trace(spark: SparkSession, edges: DataFrame, lost: DataFrame, path: str, direction: str = "imported_by", transitively: bool = False) -> DataFrame:
    """(path, relation, depth) of a file's dependencies: files by distance (1 if direct), and, in direction depends_on,
    its unresolved imports without distance."""
    if direction not in ("imported_by", "depends_on"):
        raise ValueError(f"direction: {direction}")
    reverse = direction == "imported_by"
    if transitively:
        rows = transitive(spark, edges, path, reverse)
    else:
        rows = (imported_by if reverse else depends_on)(edges, path).withColumn("depth", F.lit(1))
    rows = rows.select("path", F.lit(direction).alias("relation"), "depth")
    if reverse:
        return rows
    return rows.union(lost.where(F.col("path") == path).select(F.col("import"), F.lit("unresolved"), F.lit(None).cast("int")).distinct())


def transitive(spark: SparkSession, edges: DataFrame, path: str, reverse: bool = False, stored=None) -> DataFrame:
    """Files reachable from a file (or that reach it), itself aside, with their distance; safe on cycles.

    A frontier at a time; each frontier is checkpointed once and the visited files are the frontiers so far, so no round
    writes what an earlier one did.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("path"), F.col(b).alias("next")).distinct()
    keep = stored or (lambda df: _checkpoint(spark, df))
    e = keep(e)
    seen = front = spark.createDataFrame([(path, 0)], "path string, depth int")
    depth = 0
    while True:
        depth += 1
        front = keep(front.join(e, "path").select(F.col("next").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            return seen.where("depth > 0").orderBy("depth", "path")
        seen = seen.union(front)


def _checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; a local master without one uses a local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Strongly connected components of two files and more: (component, path), named by the first member.

    Files without a way in or out are trimmed first; then the least label is spread forwards and backwards, components
    whose labels agree are taken out, until nothing is left.
    """
    e = _checkpoint(spark, edges.where("src <> dst").distinct())
    found = None
    while True:
        while True:  # trim
            inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            inner = _checkpoint(spark, inner)
            if inner.count() == e.count():
                break
            e = inner
        if not e.limit(1).count():
            break
        forward, back = _least_label(spark, e, "src", "dst"), _least_label(spark, e, "dst", "src")
        both = forward.withColumnRenamed("label", "f").join(back.withColumnRenamed("label", "b"), "path")
        # a least node reaches and is reached: its component is those with both labels
        done = _checkpoint(spark, both.where("f = b").select(F.col("f").alias("component"), "path"))
        found = done if found is None else found.union(done)
        gone = done.select("path")
        e = _checkpoint(spark, e.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return spark.createDataFrame([], "component string, path string")
    many = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(many, "component", "left_semi")


def _least_label(spark: SparkSession, e: DataFrame, a: str, b: str) -> DataFrame:
    """For each node the least node that reaches it along a -> b."""
    labels = e.select(F.col("src").alias("path")).union(e.select(F.col("dst"))).distinct().withColumn("label", F.col("path"))
    while True:
        sent = labels.join(e.select(F.col(a).alias("path"), F.col(b).alias("to")), "path").select(F.col("to").alias("path"), "label")
        new = _checkpoint(spark, labels.union(sent).groupBy("path").agg(F.min("label").alias("label")))
        if not new.exceptAll(labels).limit(1).count():
            return new
        labels = new
