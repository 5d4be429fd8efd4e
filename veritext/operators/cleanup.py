"""Repeated header and footer lines of a prediction, beyond those that the reference has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.config import REPORT_EXAMPLES
from veritext.functions import text


def artifact_lines(docs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row a line: line_no, line, key, artifact (a page artifact with a key), lone (a page number or leader line)."""
    plain = text.newlines(F.coalesce(F.col(column), F.lit("")))
    rows = docs.select(*keys, F.posexplode_outer(text.lines(plain)).alias("line_no", "line"))
    line = F.col("line")
    rows = rows.withColumns({"key": text.cleanup_key(line), "_a": text.page_artifact(line), "lone": text.page_number(line) | text.toc_leader(line)})
    return rows.withColumn("artifact", (F.col("key") != "") & F.col("_a")).drop("_a")


def remove_repeated(docs: DataFrame, keys: list[str], pred: str, gt: str | None = None) -> DataFrame:
    """keys, text (pred without the lines), removed_line_count, removed_line_examples.

    An artifact line goes if its key repeats or it stands alone on a page's edge,
    and the reference has had as many already.
    """
    lines = artifact_lines(docs, keys, pred)
    by_key = Window.partitionBy(*keys, "key", "artifact")
    lines = lines.withColumns({"times": F.count(F.lit(1)).over(by_key), "nth": F.row_number().over(by_key.orderBy("line_no"))})
    if gt is None:
        lines = lines.withColumn("allowed", F.lit(0))
    else:
        known = artifact_lines(docs, keys, gt).where("artifact").groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("allowed"))
        lines = lines.join(known, [*keys, "key"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(0)))
    gone = F.col("artifact") & ((F.col("times") >= 2) | F.col("lone")) & (F.col("nth") > F.col("allowed"))
    lines = lines.withColumn("gone", F.coalesce(gone, F.lit(False)))
    listed = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test & F.col("line").isNotNull(), F.struct("line_no", c.alias("t"))))), lambda x: x["t"])
    return lines.groupBy(*keys).agg(
        F.array_join(listed(~F.col("gone"), F.col("line")), "\n").alias("text"), F.count_if("gone").alias("removed_line_count"),
        F.slice(listed(F.col("gone"), text.strip(F.col("line"))), 1, REPORT_EXAMPLES).alias("removed_line_examples"))
