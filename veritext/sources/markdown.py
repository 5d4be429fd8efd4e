"""Markdown documents and their files: reading, resolving and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext import schemas
from veritext.functions import text


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, file_name, text, content_sha256) of each Markdown file below path.

    Texts are UTF-8 without a byte order mark and with line feeds only; bytes that
    are no UTF-8 become U+FFFD, and then a byte order mark stays.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    whole = F.make_valid_utf8(F.col("content").cast("string"))
    whole = F.when(valid, F.regexp_replace(whole, "^﻿", "")).otherwise(whole)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), text.newlines(whole).alias("text"), F.sha2("content", 256).alias("content_sha256"))


def from_rows(df: DataFrame, id_col: str, text_col: str, **keys: str) -> DataFrame:
    """Rows of any table as documents: doc_id as a string, null texts empty, and constant key columns."""
    return df.select(*[F.lit(v).alias(k) for k, v in keys.items()], F.col(id_col).cast("string").alias("doc_id"), text.newlines(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def adapter_source(docs: DataFrame) -> DataFrame:
    """Texts as adapters take them: line feeds only, no byte order marks in front."""
    return docs.withColumn("text", F.regexp_replace(text.newlines(F.col("text")), "^﻿+", ""))


def document_id(file_name: Column) -> Column:
    """The three digits that a file name begins with, or null."""
    return F.nullif(F.regexp_extract(file_name, r"^(\d{3})", 1), F.lit(""))


def with_document_id(files: DataFrame) -> DataFrame:
    """files with doc_id; a name without one is an error."""
    found = document_id(F.col("file_name"))
    return files.withColumn("doc_id", F.when(found.isNull(), F.raise_error(F.concat(F.lit("no document id in "), F.col("file_name"))).cast("string")).otherwise(found))


def require_all(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """files of wanted(doc_id); a document without a file is an error."""
    joined = wanted.join(files, "doc_id", "left")
    return joined.withColumn("path", F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no file for document "), F.col("doc_id"))).cast("string")).otherwise(F.col("path")))


def one_each(candidates: DataFrame, what: str) -> DataFrame:
    """The one path that each document resolved to; none or several distinct ones are an error."""
    counted = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    message = F.concat(F.lit(f"{what}: expected one file for "), F.col("doc_id"), F.lit(", found "), F.array_join("paths", " "))
    return counted.select("doc_id", F.when(F.size("paths") == 1, F.col("paths")[0]).otherwise(F.raise_error(message).cast("string")).alias("path"))


def _first_kind(candidates: DataFrame) -> DataFrame:
    """Of a document's candidates those of the best priority."""
    best = Window.partitionBy("doc_id")
    return candidates.withColumn("_best", F.min("priority").over(best)).where("priority = _best").drop("_best")


def resolve_ground_truth(files: DataFrame, wanted: DataFrame, variant: str) -> DataFrame:
    """(doc_id, path): variant/<id>.md, else the only variant/<id>*.md, else the only file anywhere that ends in _<id>.md of the variant."""
    pairs = files.join(F.broadcast(wanted.select("doc_id")), F.contains("file_name", F.col("doc_id")))
    inside = F.contains("path", F.lit(f"/{variant}/"))
    exact = inside & (F.col("file_name") == F.concat("doc_id", F.lit(".md")))
    prefix = inside & F.startswith("file_name", F.col("doc_id"))
    suffix = F.endswith("file_name", F.concat(F.lit("_"), F.col("doc_id"), F.lit(".md"))) & F.contains("path", F.lit(variant))
    ranked = pairs.withColumn("priority", F.when(exact, 1).when(prefix, 2).when(suffix, 3)).where("priority IS NOT NULL")
    return one_each(_first_kind(ranked), f"ground truth {variant}")


def resolve_predictions(files: DataFrame, wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, path): <id>.md, else <id>*.md that is no report, else a name that holds one of the document's aliases(doc_id, alias).

    wanted and aliases are a benchmark's few documents, which are broadcast.
    """
    plain = files.where(~F.contains(F.lower("file_name"), F.lit("report")))
    exact = files.join(F.broadcast(wanted), F.col("file_name") == F.concat("doc_id", F.lit(".md"))).withColumn("priority", F.lit(1))
    prefix = plain.join(F.broadcast(wanted), F.startswith("file_name", F.col("doc_id"))).withColumn("priority", F.lit(2))
    named = plain.join(F.broadcast(aliases), F.contains(F.lower("file_name"), F.lower("alias"))).drop("alias").withColumn("priority", F.lit(3))
    return one_each(_first_kind(exact.unionByName(prefix).unionByName(named)), "prediction")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Normalization manifests, one row a file."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """(system, constraint): constraints that aren't false. One that is absent is not false."""
    checks = F.array(*[F.struct(F.lit(c).alias("constraint"), F.col(f"constraints.{c}").alias("value")) for c in schemas.CONSTRAINTS])
    return manifests.select("system", F.explode(checks).alias("c")).where(~F.col("c.value").eqNullSafe(F.lit(False))).select("system", "c.constraint")


def admitted(manifests: DataFrame, allow_unverified: bool = False) -> DataFrame:
    """Manifests without violations; all of them if unverified ones are allowed."""
    return manifests if allow_unverified else manifests.join(manifest_violations(manifests).select("system").distinct(), "system", "left_anti")


def read_results(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """JSON results or summaries; with `expected`, any other number of rows is an error."""
    rows = spark.read.option("multiLine", True).option("primitivesAsString", False).json(path)
    return rows if expected is None else require_count(rows, expected, "results")


def require_count(rows: DataFrame, expected: int, what: str) -> DataFrame:
    """rows, if there are as many as expected; an error as they are read otherwise."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    told = F.concat(F.lit(f"{what}: expected {expected}, found "), F.col("_n").cast("string"))
    checked = n.select(F.when(F.col("_n") == expected, True).otherwise(F.raise_error(told).cast("boolean")).alias("_ok"))
    return rows.join(F.broadcast(checked), F.col("_ok"), "inner").drop("_ok")
