"""Scoring plans: documents to component scores, to summaries, to the leaderboard.

Documents come as rows (system_id, doc_id, gt, pred, and gt_alt or null); all steps
are keyed by (system_id, doc_id), so that any number of systems and documents is
one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.config import FINAL_WEIGHTS, ScoringConfig
from veritext.functions import text
from veritext.operators import body, cleanup, extract, headings, tables

KEYS = ["system_id", "doc_id"]
STRATEGIES = ("primary", "alt", "max")


def _role(docs: DataFrame, column: str, role: str) -> DataFrame:
    return docs.where(F.col(column).isNotNull()).select(*KEYS, F.lit(role).alias("role"), F.col(column).alias("text"))


def extracted_roles(docs: DataFrame) -> DataFrame:
    """(keys, role, tables, body): each text is parsed once."""
    roles = _role(docs, "gt", "gt").unionByName(_role(docs, "pred", "pred")).unionByName(_role(docs, "gt_alt", "alt"))
    return extract.with_tables(roles).drop("text")


def table_scores(extracted: DataFrame, docs: DataFrame, strategy: str, config: ScoringConfig) -> DataFrame:
    """(keys, table, primary_table, alt_table, selected_gt)."""
    every = tables.features(extract.tables(extracted, [*KEYS, "role"]), config)
    of = lambda role: every.where(F.col("role") == role).drop("role", "raw", "matrix")
    size = lambda role: F.max(F.when(F.col("role") == role, F.size("tables")))
    counts = docs.select(*KEYS).join(extracted.groupBy(*KEYS).agg(size("gt").alias("n_gt"), size("alt").alias("n_alt"), size("pred").alias("n_pred")), KEYS, "left")
    counts = counts.withColumns({"n_gt": F.coalesce("n_gt", F.lit(0)), "n_pred": F.coalesce("n_pred", F.lit(0))})
    gt, alt, pred = of("gt"), of("alt"), of("pred")
    if strategy == "max":
        best = tables.better_of(tables.global_match(gt, pred, KEYS, config), tables.global_match(alt, pred, KEYS, config), KEYS)
        both = tables.total(counts.where("n_alt IS NOT NULL"), best, KEYS, True).withColumnRenamed("table", "best")
        lone = counts.where("n_alt IS NULL")
        lacking = lambda df: df.join(lone.select(*KEYS), KEYS, "left_semi")
        ordered = tables.total(lone, tables.ordered_match(lacking(gt), lacking(pred), KEYS, config), KEYS, False).withColumnRenamed("table", "ordered")
        rows = counts.select(*KEYS).join(ordered, KEYS, "left").join(both, KEYS, "left")
        return rows.select(*KEYS, F.coalesce(_shape(F.col("best")), _shape(F.col("ordered"))).alias("table"), F.when(F.col("best").isNotNull(), "per_table_max").otherwise("primary").alias("selected_gt"))
    primary = tables.total(counts, tables.ordered_match(gt, pred, KEYS, config), KEYS, False)
    if strategy == "primary":
        return primary.select(*KEYS, _shape(F.col("table")).alias("table"), F.lit("primary").alias("selected_gt"))
    second = counts.where("n_alt IS NOT NULL").select(*KEYS, F.col("n_alt").alias("n_gt"), F.col("n_alt"), "n_pred")
    other = tables.total(second, tables.ordered_match(alt, pred, KEYS, config), KEYS, False).withColumnRenamed("table", "other")
    rows = primary.join(other, KEYS, "left")
    return rows.select(*KEYS, F.coalesce(_shape(F.col("other")), _shape(F.col("table"))).alias("table"), F.when(F.col("other").isNotNull(), "alt").otherwise("primary (alt unavailable)").alias("selected_gt"))


EXTRA = ("table_keyword_score double", "table_match_score double", "selected_gt_variant string", "primary_pair_score double", "alt_pair_score double")


def _shape(table: Column) -> Column:
    """A table struct whose matches have the same fields under every strategy."""
    return F.when(table.isNotNull(), table.withField("matches", F.from_json(F.to_json(table["matches"]), _match_schema())))


def _match_schema() -> str:
    types = {"gt_kind": "string", "pred_kind": "string", "gt_span_pages": "struct<start:int,end:int>", "pred_span_pages": "struct<start:int,end:int>", "gt_is_cross_page": "boolean", "pred_is_cross_page": "boolean"}
    fields = [f"{f}:{types.get(f, 'double' if f.endswith('score') else 'int')}" for f in tables.MATCH_FIELDS] + [x.replace(" ", ":") for x in EXTRA]
    return f"array<struct<{','.join(fields)}>>"


def evaluate(docs: DataFrame, strategy: str = "max", config: ScoringConfig | None = None) -> DataFrame:
    """One row a document: scores, and the structs table, title and text_eval behind them. docs has KEYS, gt, pred and gt_alt."""
    config = config or ScoringConfig()
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is {strategy!r}")
    if "gt_alt" not in docs.columns:
        docs = docs.withColumn("gt_alt", F.lit(None).cast("string"))
    docs = docs.select(*KEYS, F.coalesce("gt", F.lit("")).alias("gt"), F.coalesce("pred", F.lit("")).alias("pred"), "gt_alt")
    removed = None
    if config.remove_pred_header_footer:
        removed = cleanup.remove_repeated(docs, KEYS, "pred", "gt")
        docs = docs.drop("pred").join(removed.select(*KEYS, F.col("text").alias("pred")), KEYS)
    extracted = extracted_roles(docs).persist()
    found = table_scores(extracted, docs, strategy, config)
    of = lambda role: extracted.where(F.col("role") == role).select(*KEYS, F.col("body").alias(f"{role}_body"))
    rest = of("gt").join(of("pred"), KEYS)
    rest = rest.withColumns({"gt_headings": extract.heading_list(F.col("gt_body")), "pred_headings": extract.heading_list(F.col("pred_body"))})
    rest = body.score(headings.score(rest, "gt_headings", "pred_headings"), "gt_body", "pred_body", config)
    rows = rest.join(found, KEYS)
    weighted = F.col("table.final_table_score") * FINAL_WEIGHTS["table"] + F.col("title.title_layout_score") * FINAL_WEIGHTS["title_layout"] + F.col("text_eval.text_score") * FINAL_WEIGHTS["text"]
    out = rows.select(
        *KEYS, text.rounded(text.clamp(weighted)).alias("final_score"), F.col("table.final_table_score").alias("table_score"), "title.title_layout_score", "text_eval.text_score", "selected_gt", "table", "title", "text_eval")
    return out if removed is None else out.join(removed.drop("text"), KEYS)


def summary(results: DataFrame) -> DataFrame:
    """One flat row a document."""
    return results.select(
        *KEYS, "final_score", "table_score", "title_layout_score", "text_score", F.col("table.table_structure_score"), F.col("table.table_content_score"), F.col("table.matched_table_count"), F.col("table.missing_table_count"),
        F.col("table.extra_table_count"), F.col("table.primary_selected_pair_count"), F.col("table.alt_selected_pair_count").alias("semi_semantic_selected_pair_count"))


SCORES = ("final_score", "table_score", "title_layout_score", "text_score")


def means(rows: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """Mean scores of a group, and its number of documents."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("document_count"), *[text.rounded(F.avg(c), digits).alias(c) for c in SCORES])


def leaderboard(rows: DataFrame, ordinal: str = "system_ordinal") -> DataFrame:
    """Systems by mean final score; of equal ones the first listed. rows has system_id, ordinal and the scores."""
    mean = means(rows, ["system_id", ordinal], 4)
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), ordinal))).select("rank", "system_id", "document_count", *SCORES)
