"""Documents that keep arriving: the same transforms on a stream, results merged batch by batch."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritext.config import ScoringConfig
from veritext.functions import text
from veritext.plans import score


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, text) of files as they arrive below path, each a whole text."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    at = F.col("_metadata.file_path")
    return files.select(at.alias("path"), F.element_at(F.split(at, "/"), -1).alias("file_name"), text.newlines(F.regexp_replace("value", "^﻿", "")).alias("text"))


def score_arrivals(predictions: DataFrame, references: DataFrame, path: str, checkpoint: str, config: ScoringConfig | None = None) -> StreamingQuery:
    """Scores predictions(system_id, doc_id, pred) against references(doc_id, gt, gt_alt) as they arrive.

    Scoring keeps no state. A batch's rows carry its number, so a batch that is run
    again replaces its own files, and current() takes the last score of a document.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = score.summary(score.evaluate(batch.join(references, "doc_id"), "max", config))
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return predictions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last score of each document."""
    last = Window.partitionBy(*score.KEYS).orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of a stream or table by tumbling windows; later rows than `late` are left out of a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


