"""Retrieval and audit quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_scores(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """recall@5, recall@10 and reciprocal rank of each case; expected: (case, item), returned: (case, item, rank from 1).

    A repeated item counts once, at its first rank; a case that expects nothing has 1.0 each.
    """
    first = returned.groupBy("case", "item").agg(F.min("rank").alias("rank"))
    want = expected.where("item is not null").select("case", "item").distinct()
    hits = want.join(first, ["case", "item"], "left").groupBy("case").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("rank") <= 5).alias("r5"),
        F.count_if(F.col("rank") <= 10).alias("r10"),
        F.min("rank").alias("best"),
    )
    cases = expected.select("case").distinct().join(hits, "case", "left")
    one = F.col("n").isNull()
    return cases.select(
        "case",
        F.when(one, 1.0).otherwise(F.col("r5") / F.col("n")).alias("recall_5"),
        F.when(one, 1.0).otherwise(F.col("r10") / F.col("n")).alias("recall_10"),
        F.when(one, 1.0).otherwise(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def retrieval_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("cases"), F.avg("recall_5").alias("recall_5"), F.avg("recall_10").alias("recall_10"), F.avg("reciprocal_rank").alias("mrr"), F.count_if(F.col("recall_10") == 1).alias("correct"))


def audit_scores(verdicts: DataFrame) -> DataFrame:
    """Precision by rule; verdicts: (rule, verdict or null). A null quotient: nothing to divide by."""
    v = F.col("verdict")
    reviewed = F.count_if(v.isin("correct_actionable", "correct_not_actionable", "false_positive"))
    right = F.count_if(v.isin("correct_actionable", "correct_not_actionable"))
    return verdicts.groupBy("rule").agg(
        F.count(F.lit(1)).alias("labels"),
        F.try_divide(right, reviewed).alias("structural_precision"),
        F.try_divide(F.count_if(v == "correct_actionable"), reviewed).alias("actionable_precision"),
        F.try_divide(F.count_if(v == "false_positive"), reviewed).alias("false_discovery_rate"),
        F.try_divide(F.count_if(v.isNotNull()), F.count(F.lit(1))).alias("coverage"),
    )


def audit_totals(verdicts: DataFrame, top: int = 25) -> DataFrame:
    """All rules together; verdicts: (pos, severity, verdict or null). precision_25: the share of actionable ones among the
    first ``top`` by pos that are reviewed and not uncertain."""
    v = F.col("verdict")
    right = F.count_if(v.isin("correct_actionable", "correct_not_actionable"))
    false = F.count_if(v == "false_positive")
    firsts = verdicts.where(v.isNotNull() & (v != "uncertain")).orderBy("pos").limit(top).agg(F.avg((v == "correct_actionable").cast("int")).alias("precision_25"))
    out = verdicts.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count("verdict").alias("reviewed"),
        F.count_if(v.isNull()).alias("unreviewed"),
        right.alias("structurally_correct"),
        F.count_if(v == "correct_actionable").alias("actionable"),
        false.alias("false_positives"),
        F.count_if((v == "false_positive") & (F.col("severity") == "high")).alias("high_severity_false_positives"),
        F.count_if(v == "uncertain").alias("uncertain"),
        F.try_divide(right, right + false).alias("structural_precision"),
        F.try_divide(F.count_if(v == "correct_actionable"), right + false).alias("actionable_precision"),
        F.try_divide(false, right + false).alias("false_discovery_rate"),
        F.coalesce(F.try_divide(F.count("verdict"), F.count(F.lit(1))), F.lit(1.0)).alias("label_coverage"),
    )
    return out.crossJoin(F.broadcast(firsts))  # one row each


def score_mutations(results: DataFrame) -> DataFrame:
    """results: detected (boolean)."""
    hit = F.count_if("detected")
    return results.agg(F.count(F.lit(1)).alias("cases"), hit.alias("detected"), F.try_divide(hit, F.count(F.lit(1))).alias("recall"))


#: how a tool's result rows are told apart: their path, path and line, path and line and name, or name
ITEM_KEYS = {
    **dict.fromkeys(("files", "recent", "glob", "path_search", "trace_deps", "brief"), ("path",)),
    **dict.fromkeys(("text_search", "word_refs", "callers"), ("path", "line_num")),
    **dict.fromkeys(("symbol_defs", "symbol_search", "outline"), ("path", "line_start", "name")),
    "list": ("name",),
}


def extract_items(tool: str, rows: DataFrame) -> DataFrame:
    """(item, rank from 1) of a tool's rows, which have ``pos``; an item that repeats counts once, where it first stands."""
    parts = [F.col(c) if c in ("path", "name") else F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ITEM_KEYS[tool.replace("-", "_")]]
    first = rows.select(F.concat_ws(":", *parts).alias("item"), "pos").groupBy("item").agg(F.min("pos").alias("pos"))
    from pyspark.sql import Window as W

    return first.select("item", F.row_number().over(W.orderBy("pos")).alias("rank"))  # a result page, not a corpus


def baseline_deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, absolute_delta); both: metric, value. The delta of a value that is missing is null."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "full")
    return both.select("metric", "baseline", "current", (F.col("current") - F.col("baseline")).alias("absolute_delta"))


def evenly_spaced(rows: DataFrame, order: str, count: int) -> DataFrame:
    """``count`` (two and more) rows at even distances in an order, the first and the last among them; all if there are fewer.

    Ranks are counted by range: each range's rows are numbered apart and moved by the sizes of the ranges before it.
    """
    n = rows.count()
    if n <= count:
        return rows
    spread = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("part_", F.spark_partition_id())
    from pyspark.sql import Window as W

    spread = spread.withColumn("in_", F.row_number().over(W.partitionBy("part_").orderBy(order)) - 1)
    sizes = spread.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min(order).alias("first_"))
    before = sizes.select(F.col("part_"), (F.sum("n_").over(W.orderBy("first_")) - F.col("n_")).alias("before_"))
    wanted = [i * (n - 1) // (count - 1) for i in range(count)]
    return spread.join(before, "part_").where((F.col("in_") + F.col("before_")).isin(wanted)).select(*rows.columns)


def bounded_directory(files: DataFrame, most: int) -> DataFrame:
    """(directory, files) of the folder, one or two levels deep, with most files, two to ``most``; of equals the last by name."""
    parts = F.split("path", "/")
    depth = F.least(F.size(parts) - 1, F.lit(2))
    groups = files.where(F.col("path").contains("/")).groupBy(F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("directory")).agg(F.count(F.lit(1)).alias("files"))
    return groups.where(F.col("files").between(2, most)).orderBy(F.desc("files"), F.desc("directory")).limit(1)


def write_report(results: DataFrame, summary: DataFrame, deltas: DataFrame, folder: str) -> str:
    """Case results as JSON lines under ``folder`` and the summary as markdown, which is returned."""
    results.write.mode("overwrite").json(f"{folder}/cases")
    rows = [r.asDict() for r in summary.collect()]
    shown = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["# Accuracy", "", "| metric | value |", "|-|-|", *[f"| {k} | {shown(v)} |" for r in rows for k, v in r.items()]]
    moved = deltas.orderBy("metric").collect()
    if moved:
        lines += ["", "| metric | baseline | current | delta |", "|-|-|-|-|", *[f"| {r.metric} | {shown(r.baseline)} | {shown(r.current)} | {shown(r.absolute_delta)} |" for r in moved]]
    text = "\n".join(lines) + "\n"
    summary.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return text


def estimated_tokens(files: DataFrame) -> DataFrame:
    """A quarter of the characters, rounded up."""
    return files.select("path", F.ceil(F.length("content") / 4).cast("long").alias("tokens"))
