"""Markdown reports of results and summaries, as Spark columns: sections are lists of lines with labels and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.config import FINAL_WEIGHTS, REPORT_LEVELS, REPORT_MATCHES, ScoringConfig
from veritext.plans import score

# --- fixed values: headings and labels of the reports ---
TITLE = "# Financial Markdown Scoring Report"
PER_TABLE = "- Per-table rule: each predicted table keeps its higher one-to-one pair score from primary or alt GT."
SUMMARY_TITLE = " 评分报告"
SUMMARY_HEADS = ("## 平均分", "| 文件数 | 总分 | 表格 | 标题布局 | 正文 |", "## 逐文档结果", "| 编号 | 文档 | 总分 | 表格 | 标题布局 | 正文 | 匹配表 | 漏表 | 冗余表 |", "## 错误")
NOTES = (
    "Tables are compared as cell matrices, by shape and by the edit distance of their flattened text.",
    "Heading texts only align headings; the layout score counts what aligns, at which level, in which order.",
    "The body is compared as one sequence of characters, without tables and heading marks.",
)


def number(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def labelled(**values: Column) -> list[Column]:
    """`- Label: value` for each, underscores as blanks."""
    return [F.concat(F.lit(f"- {k.replace('_', ' ')}: "), v.cast("string")) for k, v in values.items()]


def slashed(*values: Column) -> Column:
    return F.concat_ws(" / ", *[v.cast("string") for v in values])


def levels(c: Column) -> Column:
    """A list of levels, shortened beyond REPORT_LEVELS."""
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.slice(c, 1, REPORT_LEVELS), lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.concat(F.lit("`"), shown, F.when(F.size(c) > REPORT_LEVELS, F.concat(F.lit(" ... ("), F.size(c).cast("string"), F.lit(" total)"))).otherwise(""), F.lit("`"))


def shape(rows: Column, cols: Column) -> Column:
    return F.concat(F.lit("{'rows': "), rows.cast("string"), F.lit(", 'cols': "), cols.cast("string"), F.lit("}"))


def listed(lines: Column, none: str) -> Column:
    """An array of lines, or one line where it's empty."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(none)


def match_line(selected: Column):
    def line(m: Column) -> Column:
        parts = {"pair": m["table_pair_score"], "structure": m["table_structure_score"], "content": m["table_content_score"], "keywords": F.coalesce(m["table_keyword_score"], F.lit(0.0)), "match": F.coalesce(m["table_match_score"], m["table_pair_score"])}
        figures = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), number(v)) for k, v in parts.items()], F.concat(F.lit("GT shape="), shape(m["gt_rows"], m["gt_cols"])), F.concat(F.lit("Pred shape="), shape(m["pred_rows"], m["pred_cols"])))
        return F.concat(F.lit("- "), F.coalesce(m["selected_gt_variant"], selected), F.lit(" GT table "), m["gt_index"].cast("string"), F.lit(" -> Pred table "), m["pred_index"].cast("string"), F.lit(": "), figures)

    return line


def worst_line(w: Column, i: Column) -> Column:
    side = lambda name: F.concat(F.lit("0+"), w[f"{name}_count"].cast("string"))
    shown = lambda name: F.coalesce(F.nullif(w[f"{name}_preview"], F.lit("")), F.lit("(empty)"))
    head = F.concat((i + 1).cast("string"), F.lit(". op="), w["op"], F.lit(", distance="), number(w["distance"]), F.lit(", GT blocks "), side("gt"), F.lit(", Pred blocks "), side("pred"))
    return F.concat(head, F.lit("\n   - GT: "), shown("gt"), F.lit("\n   - Pred: "), shown("pred"))


def document_reports(results: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """(keys, report) of score.evaluate()'s rows."""
    config, c = config or ScoringConfig(), F.col
    removed = c("removed_line_count") if "removed_line_count" in results.columns else F.lit(0)
    examples = c("removed_line_examples") if "removed_line_examples" in results.columns else F.array().cast("array<string>")
    mode = "prediction_only_header_footer_cleanup" if config.remove_pred_header_footer else "disabled_after_explicit_adapter"
    t, h, b = "table.", "title.", "text_eval."
    both = c("selected_gt") == "per_table_max"
    chosen = F.when(both, F.concat_ws("\n", F.lit(PER_TABLE), F.concat(F.lit("- Per-table selected primary / alt pairs: "), slashed(c(t + "primary_selected_pair_count"), c(t + "alt_selected_pair_count"))), F.concat(F.lit("- Per-table reference table count: "), c(t + "gt_table_count").cast("string"))))
    scores = labelled(Final_Score=number(c("final_score")), Table_Score=number(c("table_score")), Title_Layout_Score=number(c("title_layout_score")), Text_Score=number(c("text_score")))
    settings = {"Remove pred header/footer": config.remove_pred_header_footer, "Normalize images": config.normalize_images, "Normalize Chinese variants": config.normalize_zh, "Normalize footnotes": config.normalize_footnotes, "Normalize punctuation": config.normalize_punctuation,
                "Table pair weights": f"structure={config.table_structure_weight}, content={config.table_content_weight}"}
    sections = [
        [F.lit(TITLE)], [F.lit("## Overall"), *scores],
        [F.lit("## Prediction Cleanup"), F.lit(f"- Mode: {mode}"), F.concat(F.lit("- Removed pred header/footer lines: "), removed.cast("string")), F.lit("- Removed examples:"), listed(F.transform(F.slice(examples, 1, 10), lambda x: F.concat(F.lit("  - "), x)), "  - None")],
        [F.lit("## Weights"), *[F.lit(f"- {k.replace('_', ' ').title()}: {w:.0%}") for k, w in FINAL_WEIGHTS.items()]],
        [F.lit("## Configuration"), *[F.lit(f"- {k}: {v}") for k, v in settings.items()]],
        [F.lit("## Table Evaluation"), F.concat(F.lit("- Table GT strategy result: "), c("selected_gt")), chosen, F.concat(F.lit("- Matched / missing / extra tables: "), slashed(c(t + "matched_table_count"), c(t + "missing_table_count"), c(t + "extra_table_count"))),
         *labelled(Table_content_score=number(c(t + "table_content_score")), Table_structure_score=number(c(t + "table_structure_score")), Table_matrix_score=number(c(t + "table_matrix_score")), Cross_page_table_score=F.coalesce(number(c(t + "cross_page_table_score")), F.lit("none")))],
        [F.lit("### Table Matches"), listed(F.transform(F.slice(t + "matches", 1, REPORT_MATCHES), match_line(c("selected_gt"))), "- No matched tables.")],
        [F.lit("## Title Layout Evaluation"), *[F.concat(F.lit(f"- {side.replace('gt', 'GT').replace('pred', 'Pred')} {kind} heading levels: "), levels(c(f"{h}{side}_{kind}_heading_levels"))) for kind in ("raw", "relative") for side in ("gt", "pred")],
         *labelled(Title_layout_score=number(c(h + "title_layout_score")), Heading_F1_score=number(c(h + "heading_f1_score")), Level_accuracy_score=number(c(h + "level_accuracy_score")), Order_score=number(c(h + "order_score"))), F.lit("- Main penalties:"), F.array_join(F.transform(h + "issues", lambda x: F.concat(F.lit("  - "), x)), "\n")],
        [F.lit("## Text Evaluation"), F.lit("- Text mode: normalized_full_text_preserve_newlines"), *labelled(Text_score=number(c(b + "text_score")), Average_edit_distance=number(c(b + "average_edit_distance"))),
         F.concat(F.lit("- Matched / missing / extra blocks: "), slashed(c(b + "matched_block_count"), c(b + "missing_block_count"), c(b + "extra_block_count"))), F.concat(F.lit("- GT / Pred block counts: "), slashed(c(b + "gt_block_count"), c(b + "pred_block_count")))],
        [F.lit("### Worst Match Samples"), listed(F.transform(b + "worst_matches", worst_line), "- No text mismatches.")],
        [F.lit("## Notes"), *[F.lit(f"- {n}") for n in NOTES]],
    ]
    whole = F.concat(F.concat_ws("\n\n", *[F.concat_ws("\n", *s) for s in sections]), F.lit("\n"))
    return results.select(*score.KEYS, whole.alias("report"))


def summary_report(rows: DataFrame, system_name: str, errors: DataFrame | None = None) -> DataFrame:
    """One row: the summary of score.summary()'s rows with `document`, as Markdown; errors(error) at the end."""
    c = F.col
    cells = [c("doc_id"), c("document"), *[number(c(s), 2) for s in score.SCORES], *[c(f"{k}_table_count").cast("string") for k in ("matched", "missing", "extra")]]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(s) for s in score.SCORES], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    told = (errors if errors is not None else rows.select(F.lit(None).cast("string").alias("error")).limit(0)).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "error"))), "\n").alias("errors"))
    means = F.concat(F.lit("| "), F.concat_ws(" | ", c("n").cast("string"), *[number(c(s), 2) for s in score.SCORES]), F.lit(" |"))
    m, mh, d, dh, e = SUMMARY_HEADS
    tables = F.when(c("n") > 0, F.concat(F.lit(f"{m}\n\n{mh}\n|---:|---:|---:|---:|---:|\n"), means, F.lit(f"\n\n{d}\n\n{dh}\n|---:|---|---:|---:|---:|---:|---:|---:|---:|\n"), c("lines")))
    wrong = F.when(c("errors") != "", F.concat(F.lit(f"{e}\n\n"), c("errors")))
    return whole.crossJoin(told).select(F.concat(F.concat_ws("\n\n", F.lit(f"# {system_name}{SUMMARY_TITLE}"), tables, wrong), F.lit("\n")).alias("report"))
