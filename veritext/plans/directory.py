"""From folders of files to scores: one system's folder, or all systems at once, to a leaderboard.

Files are read once for all systems. A document that can't be scored is an error
row, not a failure of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.config import ScoringConfig
from veritext.functions import text
from veritext.plans import report, score
from veritext.sources import markdown, sinks

VARIANTS = ("primary", "semi_semantic")


def references(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, gt, gt_alt, gt_sha256, gt_alt_sha256) of wanted(doc_id): the primary reference, and the second one where there is any."""
    files = markdown.read_documents(spark, root, True)
    names = files.select("path", "file_name")

    def of(variant: str, column: str, some: DataFrame) -> DataFrame:
        found = markdown.resolve_ground_truth(names, some, variant).join(files, "path")
        return found.select("doc_id", F.col("text").alias(column), F.col("content_sha256").alias(f"{column}_sha256"))

    return of(VARIANTS[0], "gt", wanted).join(of(VARIANTS[1], "gt_alt", wanted), "doc_id", "left")


def predictions(spark: SparkSession, folders: DataFrame, wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(system_id, doc_id, pred, prediction_sha256) of every system of folders(system_id, path), a list of few rows; pred is null where a document has no file."""
    out = None
    for row in folders.select("system_id", "path").collect():
        files = markdown.read_documents(spark, row["path"])
        found = markdown.resolve_predictions(files.select("path", "file_name"), wanted, aliases).join(files, "path")
        rows = wanted.select(F.lit(row["system_id"]).alias("system_id"), "doc_id").join(found.select("doc_id", F.col("text").alias("pred"), F.col("content_sha256").alias("prediction_sha256")), "doc_id", "left")
        out = rows if out is None else out.unionByName(rows)
    return out


def score_systems(docs: DataFrame, refs: DataFrame, strategy: str = "max", config: ScoringConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, errors): evaluate() of predictions with their references and input hashes; and (system_id, doc_id, error) of documents that lack either."""
    both = docs.join(refs, "doc_id", "left")
    lacking = F.when(F.col("gt").isNull(), "no reference").when(F.col("pred").isNull(), "no prediction")
    hashes = [c for c in ("gt_sha256", "gt_alt_sha256", "prediction_sha256") if c in both.columns]
    scored = score.evaluate(both.where(lacking.isNull()).select(*score.KEYS, "gt", "pred", "gt_alt"), strategy, config)
    return scored.join(both.select(*score.KEYS, *hashes), score.KEYS), both.where(lacking.isNotNull()).select(*score.KEYS, lacking.alias("error"))


def gated(folders: DataFrame, manifests: DataFrame, allow_unverified: bool = False) -> DataFrame:
    """The systems whose normalization manifest vouches for them."""
    return folders.join(markdown.admitted(manifests, allow_unverified).select(F.col("system").alias("system_id")).distinct(), "system_id", "left_semi")


def ranked(results: DataFrame, systems: DataFrame, expected: int) -> DataFrame:
    """The leaderboard of systems(system_id, system_ordinal, label) that have `expected` documents; a system with others is an error. Unlabelled systems go by their id."""
    counts = results.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"))
    told = F.concat(F.col("system_id"), F.lit(f": expected {expected} documents, found "), F.col("n").cast("string"))
    whole = counts.select("system_id", F.when(F.col("n") == expected, True).otherwise(F.raise_error(told).cast("boolean")).alias("whole"))
    rows = results.join(whole.where("whole").select("system_id"), "system_id").join(systems.select("system_id", "system_ordinal"), "system_id", "left")
    board = score.leaderboard(rows.withColumn("system_ordinal", F.coalesce("system_ordinal", F.lit(2**31 - 1))))
    named = text.labelled(board, "system_id", systems.select(F.col("system_id").alias("key"), "label"), None)
    return named.select("rank", F.col("system_id").alias("system"), F.coalesce("label", "system_id").alias("system_name"), "document_count", *score.SCORES)


def write_system(results: DataFrame, errors: DataFrame, system_id: str, name: str, folder: str, config: ScoringConfig | None = None) -> None:
    """A system's summary files, and its documents' reports as one text file each."""
    own = results.where(F.col("system_id") == system_id)
    rows = score.summary(own).withColumn("document", F.col("doc_id"))
    wrong = errors.where(F.col("system_id") == system_id)
    sinks.write_summary(rows, report.summary_report(rows, name, wrong), folder, wrong)
    reports = report.document_reports(own, config)
    sinks.write_documents(reports.select("system_id", "doc_id", F.col("report").alias("text")), f"{folder}/documents", "overwrite")
