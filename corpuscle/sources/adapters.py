"""Tables of the test data as corpora of files: (path, content) and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

FOLDERS = ("packages/core/src/", "apps/web/src/", "src/", "packages/core/", "examples/", "tests/", "docs/", "lib/")
EXTENSIONS = (".rs", ".ts", ".py", ".go", ".md", ".sql", ".sh", ".css", ".json", ".txt")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than cores; larger inputs stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, modified_ms of every document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat(pick(FOLDERS, len(FOLDERS)), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), pick(EXTENSIONS, len(EXTENSIONS)))
    return spread(d.select("doc_id", "text", "source", "lang")).select("doc_id", path.alias("path"), F.col("text").alias("content"), (F.lit(1700000000000) + 1000 * F.col("doc_id")).alias("modified_ms"))


# (table, folder, key, name, foreign keys as (column, table's folder))
FOREIGN_KEYS = (
    ("region", "r_regionkey", ()),
    ("nation", "n_nationkey", (("n_regionkey", "region"),)),
    ("supplier", "s_suppkey", (("s_nationkey", "nation"),)),
    ("customer", "c_custkey", (("c_nationkey", "nation"),)),
    ("orders", "o_orderkey", (("o_custkey", "customer"),)),
    ("part", "p_partkey", ()),
)


def key_project(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> DataFrame:
    """A TypeScript file per row of the key tables, importing the files its foreign keys name; path and content.

    cyclic: each region's file imports the nation file of the same number too.
    """
    out = None
    for table, key, links in FOREIGN_KEYS:
        d = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if cyclic and table == "region":
            links = (("r_regionkey", "nation"),)
        name = F.concat(F.lit(f"{table}_"), F.col(key).cast("string"))
        imports = [F.concat(F.lit(f'import {{ {to}_'), F.col(c).cast("string"), F.lit(f' }} from "../{to}/k'), F.col(c).cast("string"), F.lit('";\n')) for c, to in links]
        calls = [F.concat(F.lit(f"  {to}_"), F.col(c).cast("string"), F.lit("();\n")) for c, to in links]
        content = F.concat(*imports, F.lit("export function "), name, F.lit("(row) {\n"), *calls, F.lit("}\n"))
        rows = d.select(F.concat(F.lit(f"src/{table}/k"), F.col(key).cast("string"), F.lit(".ts")).alias("path"), content.alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return spread(out) if out.rdd.getNumPartitions() < 2 * len(FOREIGN_KEYS) else out


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python package per nation and a module per customer that imports its nation's package by name."""
    n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    number = lambda x: F.col(x).cast("string")
    packages = n.select(F.concat(F.lit("lib/n"), number("n_nationkey"), F.lit("/__init__.py")).alias("path"), F.lit("LIMIT = 1\n").alias("content"))
    modules = c.select(F.concat(F.lit("app/c"), number("c_custkey"), F.lit(".py")).alias("path"), F.concat(F.lit("import n"), number("c_nationkey"), F.lit("\n")).alias("content"))
    return packages.union(modules)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per page that imports what the page links to."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    content = F.array_join(F.transform(links, lambda x: F.concat(F.lit('import "'), x, F.lit('";'))), "\n")
    return p.select(F.concat(F.lit("web/p_"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), content.alias("content"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as versions of one file per user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = X.choose((F.col("event_type") == "signup", "Insert"), (F.col("event_type") == "error", "Delete"), otherwise="Replace")
    return e.select(
        F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"),
        (F.col("event_id") + 1).alias("seq"),
        op.alias("op"),
        F.floor("value").cast("long").alias("size"),
    )


def file_table(files: DataFrame) -> DataFrame:
    """Metadata of (path, content) files."""
    return files.withColumns(
        {
            "language": X.language(F.col("path")),
            "line_count": F.greatest(F.size(X.lines(F.col("content"))), F.lit(1)),
            "byte_size": F.octet_length("content").cast("long"),
        }
    )


def line_table(files: DataFrame) -> DataFrame:
    """path, language, line_num, line_text of every line."""
    return files.select("path", X.language(F.col("path")).alias("language"), F.posexplode(X.lines(F.col("content"))).alias("p", "line_text")).select("path", "language", (F.col("p") + 1).alias("line_num"), "line_text")
