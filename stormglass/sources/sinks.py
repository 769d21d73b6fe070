"""Writers of summaries, logs, posts and reports."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.text import reformat


#: The fields of a line of posts and the line that begins a step in a log.
NULL_FIELD, FIELD_END, STEP_LINE = "null", "\t", "********** step = %d ************ "


def write_tsv(posts: DataFrame, path: str) -> None:
    """Posts in the TSV form: id, null, ms, user, text on one line."""
    one = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n\t]", " ")
    cols = [F.coalesce(c, F.lit("")) for c in (F.col("tweet_id"), F.lit(NULL_FIELD), F.col("created_at_ms").cast("string"), F.col("user_id"))]
    posts.select(F.concat_ws(FIELD_END, *cols, one).alias("value")).write.mode("overwrite").text(path)


def write_json(raw: DataFrame, path: str) -> None:
    raw.write.mode("overwrite").json(path)


def write_step_summary(summary: DataFrame, path: str) -> None:
    """One folder per step; a step written again replaces only itself."""
    one = summary.withColumn("text", F.regexp_replace("text", "[\r\n]", " "))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def append_log(summary: DataFrame, path: str) -> None:
    """Adds one line per summary row, after a header line per step, to the log."""
    head = summary.select("step", F.lit(0).alias("rank_no"), F.format_string(STEP_LINE, F.col("step")).alias("value")).distinct()
    lines = summary.select("step", "rank_no", F.regexp_replace("text", "[\r\n]", " ").alias("value"))
    head.union(lines).orderBy("step", "rank_no").select("value").write.mode("append").text(path)


def write_summary_files(summary: DataFrame, path: str, *by: str) -> None:
    """One text file for each value of ``by``: the summary's lines in order of ``rank_no``."""
    line = F.struct("rank_no", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda r: r["text"])
    summary.groupBy(*by).agg(F.array_join(lines, "\n").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def eval_table(scores: DataFrame, ks: list[int]) -> DataFrame:
    """``model, step`` and precision, recall and F1 for each K, side by side."""
    cols = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in ks for c in ("p", "r", "f1")]
    return scores.groupBy("model", "step").agg(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def ab_plan(spark: SparkSession, models: list[str], steps: list[int], ks: list[int], seed: int = 1) -> DataFrame:
    """The plan of a blind comparison: every baseline, step and K in shuffled order, the first model left or right."""
    r = random.Random(seed)
    rows = [(m, s, k) for m in sorted(models) for s in sorted(steps) for k in sorted(ks)]
    r.shuffle(rows)
    return spark.createDataFrame([(i, m, s, r.randint(0, 1), k) for i, (m, s, k) in enumerate(rows)], "index int, baseline string, step int, inc_set int, top_k int")


def ab_pages(summaries: DataFrame, plan: DataFrame, path: str, reference: str = "inc") -> None:
    """The pages of a blind comparison and its key.

    One page per row of ``plan`` (see :func:`ab_plan`), in a table of the two
    summaries' first ``top_k`` posts side by side, the reference's on the left where
    ``inc_set`` is 0; pages are put together by the tasks. ``pages`` holds them by
    index, ``key`` the plan as CSV with its header.
    """
    posts = summaries.select("model", "step", "rank_no", reformat(F.coalesce("text", F.lit(""))).alias("text"))
    lines = plan.join(posts, "step").where((F.col("rank_no") <= F.col("top_k")) & ((F.col("model") == reference) | (F.col("model") == F.col("baseline"))))
    mine = (F.col("model") == reference) == (F.col("inc_set") == 0)
    safe = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    row = lines.groupBy("index", "rank_no").agg(F.max(F.when(mine, safe)).alias("l"), F.max(F.when(~mine, safe)).alias("r"))
    cells = F.concat(F.lit("<tr><td>"), F.col("rank_no").cast("string"), F.lit("</td><td>"), F.coalesce("l", F.lit("")), F.lit("</td><td>"), F.coalesce("r", F.lit("")), F.lit("</td></tr>"))
    body = row.groupBy("index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", cells.alias("c")))), lambda x: x["c"]), "").alias("rows"))
    head = "<html><body><table><tr><th>Number</th><th>Set 1</th><th>Set 2</th></tr>"
    page = F.concat(F.lit(head), F.coalesce("rows", F.lit("")), F.lit("</table></body></html>"))
    plan.join(body, "index", "left").select("index", page.alias("value")).write.mode("overwrite").partitionBy("index").text(f"{path}/pages")
    plan.select("index", "baseline", "step", "inc_set", "top_k").write.mode("overwrite").option("header", True).csv(f"{path}/key")


def rank_lines(ranks: DataFrame, k: int) -> DataFrame:
    """``line``: the ``k`` nodes of the highest rank for a log, the least of them first."""
    top = ranks.orderBy(F.desc("rank"), "node").limit(k)
    return top.orderBy("rank", F.desc("node")).select(F.format_string("PageRank: %f, %s", F.col("rank"), F.col("node")).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """``line``: the edges of a graph (``u, v, total``) for a log."""
    return edges.select(F.format_string("%s --> %s: %.1f", F.col("u"), F.col("v"), F.col("total").cast("double")).alias("line"))
