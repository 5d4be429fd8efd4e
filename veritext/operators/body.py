"""Body text: the score of two documents' texts without tables and heading marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.config import EXACT_BODY_CELLS, PREVIEW_CHARS, ScoringConfig
from veritext.functions import text
from veritext.functions.arrow import settled
from veritext.operators import distance


def normal_forms(docs: DataFrame, columns: dict[str, str], config: ScoringConfig) -> DataFrame:
    """docs with name_1 for each name and its column, the body's normal form, and name_2, the normal form of that: it isn't idempotent, and the distance is taken on the second.

    A step takes all columns at once: each step has a Python worker for each task, and its memory.
    """
    docs = docs.withColumns({f"{name}_0": settled(text.without_heading_marks(F.col(column))) for name, column in columns.items()})
    for k in (1, 2):
        # Python's results come first, as columns of one node.
        normal = {f"{name}_n": text.semantic_udf(config)(F.col(f"{name}_{k - 1}")) for name in columns}
        docs = docs.withColumns(normal).withColumns({f"{name}_{k}": settled(text.body_lines(F.col(f"{name}_n"))) for name in columns}).drop(*normal)
    return docs.drop(*[f"{name}_0" for name in columns])


def score(docs: DataFrame, gt: str, pred: str, config: ScoringConfig) -> DataFrame:
    """docs with a struct `text_eval`: the score of text columns gt and pred, both without tables."""
    docs = normal_forms(docs, {"_g": gt, "_p": pred}, config)
    has_gt, has_pred = F.col("_g_1") != "", F.col("_p_1") != ""
    none = ~has_gt & ~has_pred
    apart = F.when(none, 0.0).otherwise(distance.normalized(F.col("_g_2"), F.col("_p_2"), EXACT_BODY_CELLS))
    docs = docs.withColumn("_d", settled(apart))
    op = F.when(has_gt & has_pred, "match").when(has_gt, "missing").otherwise("extra")
    worst = F.struct(op.alias("op"), text.rounded(F.col("_d")).alias("distance"), has_gt.cast("int").alias("gt_count"), has_pred.cast("int").alias("pred_count"), text.preview(F.col("_g_2"), PREVIEW_CHARS).alias("gt_preview"), text.preview(F.col("_p_2"), PREVIEW_CHARS).alias("pred_preview"))
    one = lambda c: c.cast("int")
    result = F.struct(
        text.rounded(text.clamp((1.0 - F.col("_d")) * 100.0)).alias("text_score"), one(has_gt & has_pred).alias("matched_block_count"), one(has_gt & ~has_pred).alias("missing_block_count"), one(~has_gt & has_pred).alias("extra_block_count"),
        text.rounded(F.col("_d")).alias("average_edit_distance"), one(has_gt).alias("gt_block_count"), one(has_pred).alias("pred_block_count"), F.when(none, F.array().cast("array<struct<op:string,distance:double,gt_count:int,pred_count:int,gt_preview:string,pred_preview:string>>")).otherwise(F.array(worst)).alias("worst_matches"))
    return docs.withColumn("text_eval", result).drop("_g_1", "_g_2", "_p_1", "_p_2", "_d")
