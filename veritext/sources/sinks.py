"""Results as files: JSON and CSV through Spark's writers; single small files through the file system of their path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext import schemas

MARK = "﻿"


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A one-row frame's text as one file at path, in whatever file system path names."""
    spark = df.sparkSession
    rows = df.select(column).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: {len(rows)} rows instead of one")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(rows[0][0].encode()))
    finally:
        out.close()


def pretty_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: all rows of a small result as a JSON array in order, indented, with other than ASCII as it is."""
    rows = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select(F.to_json("rows", {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def csv_text(df: DataFrame, order: list[str], mark: bool = True) -> DataFrame:
    """One row: a small result as CSV with a header, and a byte order mark for spreadsheets."""
    line = F.to_csv(F.struct(*[F.col(c).cast("string") for c in df.columns]))
    body = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\r\n").alias("b"))
    return body.select(F.concat(F.lit((MARK if mark else "") + ",".join(df.columns) + "\r\n"), "b", F.lit("\r\n")).alias("value"))


def write_rows(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Results of any size as partitioned files: parquet, json or csv."""
    df.write.mode(mode).partitionBy(*(by or [])).format(kind).option("header", True).save(path)


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents(system_id, doc_id, text) as text files, one folder a document. The writer ends each with a line feed, which stands for a text's own last one."""
    value = F.regexp_replace("text", r"\n\z", "").alias("value")
    docs.select("system_id", "doc_id", value).write.mode(mode).partitionBy("system_id", "doc_id").text(path)


def write_summary(rows: DataFrame, report: DataFrame, folder: str, errors: DataFrame | None = None) -> None:
    """summary.json, summary.csv and summary.md of a system's few rows; errors.json if there are errors."""
    write_text(pretty_json(rows, ["doc_id"]), "value", f"{folder}/summary.json")
    write_text(csv_text(rows, ["doc_id"]), "value", f"{folder}/summary.csv")
    write_text(report, "report", f"{folder}/summary.md")
    if errors is not None and errors.take(1):
        write_text(pretty_json(errors, errors.columns), "value", f"{folder}/errors.json")


def write_leaderboard(board: DataFrame, folder: str) -> None:
    write_text(pretty_json(board, ["rank"]), "value", f"{folder}/leaderboard.json")
    write_text(csv_text(board, ["rank"]), "value", f"{folder}/leaderboard.csv")


def write_manifest(manifest: DataFrame, path: str) -> None:
    write_text(manifest.select(F.to_json(F.struct(*manifest.columns), {"pretty": "true"}).alias("value")), "value", path)


def with_provenance(results: DataFrame, files: DataFrame, adapter: str, manifest_path: str) -> DataFrame:
    """Results with the hashes of the bytes of their inputs (files: keys, gt_sha256, gt_alt_sha256, prediction_sha256), the adapter and its manifest."""
    from veritext.plans.score import KEYS

    return results.join(files, KEYS, "left").withColumns({"normalization_adapter": F.lit(adapter), "normalization_manifest": F.lit(manifest_path)})


SUMMARY_COLUMNS, LEADERBOARD_COLUMNS = schemas.SUMMARY, schemas.LEADERBOARD
