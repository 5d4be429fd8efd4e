"""Command line: score documents, folders and all systems, adapt predictions, canonicalize references, rank systems.

python -m veritext.cli score --gt FILE --pred FILE [--gt-table-alt FILE] ...
python -m veritext.cli adapt --kind KIND --input FOLDER --output FOLDER --system ID
python -m veritext.cli canonical --gt-root FOLDER [--check] [--output FOLDER]
python -m veritext.cli directory --gt-root FOLDER --predictions FOLDER --system ID --output FOLDER --documents ID [ID ...]
python -m veritext.cli systems --gt-root FOLDER --predictions FOLDER --output FOLDER --documents ID [ID ...]
python -m veritext.cli rank --results FOLDER --output FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veritext.config import ScoringConfig
from veritext.operators import adapters, canonical
from veritext.plans import directory, report, score
from veritext.sources import markdown, sinks


def arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = parser.add_subparsers(dest="command", required=True)
    on_off = {"choices": ["on", "off"]}
    one = kinds.add_parser("score")
    one.add_argument("--gt", required=True)
    one.add_argument("--pred", required=True)
    one.add_argument("--gt-table-alt")
    one.add_argument("--table-gt-strategy", choices=score.STRATEGIES, default="max")
    one.add_argument("--json-out")
    one.add_argument("--markdown-out")
    one.add_argument("--remove-pred-header-footer", default="off", **on_off)
    for name in ("images", "footnotes", "punctuation"):
        one.add_argument(f"--normalize-{name}", default="on", **on_off)
    one.add_argument("--normalize-zh", choices=["t2s", "none"], default="t2s")
    one.add_argument("--table-structure-weight", type=float, default=0.6)
    one.add_argument("--table-content-weight", type=float, default=0.4)
    fit = kinds.add_parser("adapt")
    fit.add_argument("--kind", required=True, choices=list(adapters.pipelines([])))
    for name in ("input", "output", "system"):
        fit.add_argument(f"--{name}", required=True)
    ref = kinds.add_parser("canonical")
    ref.add_argument("--gt-root", required=True)
    ref.add_argument("--check", action="store_true")
    ref.add_argument("--output")
    ref.add_argument("--in-place", action="store_true", help="rewrite files that change")
    ref.add_argument("--expected", type=int, help="number of references that there must be")
    ref.add_argument("--flowcharts", help="a JSON file of document ids and the texts of their flowcharts")
    for name in ("directory", "systems"):
        many = kinds.add_parser(name)
        for option in ("gt-root", "predictions", "output"):
            many.add_argument(f"--{option}", required=True)
        many.add_argument("--documents", nargs="+", required=True)
        many.add_argument("--alias", nargs="*", default=[], metavar="ID=NAME", help="names that a document's file may hold")
        many.add_argument("--label", nargs="*", default=[], metavar="SYSTEM=NAME", help="systems' names, in the order that equal ones are listed in")
        many.add_argument("--table-gt-strategy", choices=score.STRATEGIES, default="max")
        many.add_argument("--allow-unverified", action="store_true", help="score systems whose manifest doesn't vouch for them, or that have none")
        if name == "directory":
            many.add_argument("--system", required=True)
    top = kinds.add_parser("rank")
    top.add_argument("--results", required=True)
    top.add_argument("--output", required=True)
    return parser.parse_args(given)


def run_score(spark: SparkSession, a: argparse.Namespace) -> int:
    config = ScoringConfig(
        normalize_images=a.normalize_images == "on", normalize_footnotes=a.normalize_footnotes == "on", normalize_punctuation=a.normalize_punctuation == "on", remove_pred_header_footer=a.remove_pred_header_footer == "on",
        normalize_zh=a.normalize_zh, table_structure_weight=a.table_structure_weight, table_content_weight=a.table_content_weight)
    one = lambda path, name: markdown.read_documents(spark, path).select(F.col("text").alias(name))
    docs = one(a.gt, "gt").crossJoin(one(a.pred, "pred"))
    docs = docs.crossJoin(one(a.gt_table_alt, "gt_alt")) if a.gt_table_alt else docs.withColumn("gt_alt", F.lit(None).cast("string"))
    results = score.evaluate(docs.select(F.lit("system").alias("system_id"), F.lit("document").alias("doc_id"), "*"), a.table_gt_strategy, config).cache()
    if a.json_out:
        sinks.write_text(results.select(F.to_json(F.struct(*results.columns), {"pretty": "true"}).alias("value")), "value", a.json_out)
    if a.markdown_out:
        sinks.write_text(report.document_reports(results, config), "report", a.markdown_out)
    results.select(*score.SCORES).show(truncate=False)
    return 0


def run_adapt(spark: SparkSession, a: argparse.Namespace) -> int:
    keys = ["doc_id"]
    docs = markdown.adapter_source(markdown.with_document_id(markdown.read_documents(spark, a.input)).select("doc_id", "text")).cache()
    once = adapters.adapt(docs, a.kind, keys).cache()
    checks = adapters.validate(docs, once, adapters.adapt(once.select("doc_id", "text"), a.kind, keys), keys).cache()
    if wrong := checks.where("error IS NOT NULL").select("doc_id", "error").take(20):
        print(*[f"{r.doc_id}: {r.error}" for r in wrong], sep="\n", file=sys.stderr)
        return 1
    sinks.write_documents(once.withColumn("system_id", F.lit(a.system)), f"{a.output}/documents", "overwrite")
    sinks.write_manifest(adapters.manifest(docs, once, checks.drop("error"), a.system, a.kind, []), f"{a.output}/normalization_manifest.json")
    return 0


def run_canonical(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = markdown.with_document_id(markdown.read_documents(spark, a.gt_root, True)).withColumn("system_id", F.element_at(F.split("path", "/"), -2))
    docs = docs if a.expected is None else markdown.require_count(docs, a.expected, "references")
    known = None
    if a.flowcharts:
        found = spark.read.option("multiLine", True).text(a.flowcharts, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "flowchart"))
        known = found
    done = canonical.canonicalize(docs.select("path", "system_id", "doc_id", "text"), known).cache()
    done.select("system_id", "doc_id", "changed", "error", *canonical.COUNTERS).orderBy("system_id", "doc_id").show(1000, truncate=False)
    state = done.agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias("changed"), F.count("error").alias("errors")).first()
    if not a.check and not state["errors"]:
        if a.output:
            sinks.write_documents(done, a.output, "overwrite")
        if a.in_place:
            for row in done.where("changed").select("path").collect():
                sinks.write_text(done.where(F.col("path") == row["path"]), "text", row["path"])
    done.unpersist()
    return int(bool(state["errors"]) or (a.check and state["changed"]))


def _pairs(given: list[str]) -> list[tuple[str, str]]:
    return [tuple(x.split("=", 1)) for x in given]


def run_systems(spark: SparkSession, a: argparse.Namespace) -> int:
    """All systems that have a folder below --predictions, or the one that is named."""
    wanted = spark.createDataFrame([(d,) for d in a.documents], "doc_id string")
    aliases = spark.createDataFrame(_pairs(a.alias), "doc_id string, alias string")
    labels = _pairs(a.label)
    if a.command == "directory":
        folders = spark.createDataFrame([(a.system, a.predictions)], "system_id string, path string")
        manifest_at = a.predictions
    else:
        files = markdown.read_documents(spark, a.predictions, True).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
        folders = files.select(F.element_at(F.split("path", "/"), -1).alias("system_id"), "path")
        manifest_at = f"{a.predictions}/*"
    if not a.allow_unverified:
        folders = directory.gated(folders, markdown.read_manifests(spark, f"{manifest_at}/*manifest.json"))
    folders = folders.cache()
    names = [r["system_id"] for r in folders.select("system_id").orderBy("system_id").collect()]
    if not names:
        print("no system's manifest vouches for it", file=sys.stderr)
        return 1
    results, errors = directory.score_systems(directory.predictions(spark, folders, wanted, aliases), directory.references(spark, a.gt_root, wanted), a.table_gt_strategy)
    results, errors = results.cache(), errors.cache()
    for name in names:
        directory.write_system(results, errors, name, dict(labels).get(name, name), f"{a.output}/{name}")
    failed = errors.count()
    if a.command == "systems" and not failed:
        systems = spark.createDataFrame([(n, labels.index(x) if (x := next((p for p in labels if p[0] == n), None)) else len(labels) + k, dict(labels).get(n)) for k, n in enumerate(names)], "system_id string, system_ordinal int, label string")
        sinks.write_leaderboard(directory.ranked(results, systems, len(a.documents)), a.output)
    return int(bool(failed))


def run_rank(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.parquet(a.results)
    sinks.write_leaderboard(score.leaderboard(rows if "system_ordinal" in rows.columns else rows.withColumn("system_ordinal", F.lit(0))), a.output)
    return 0


def main(given: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if given is None else given)
    spark = SparkSession.builder.appName("veritext").getOrCreate()
    return {"score": run_score, "adapt": run_adapt, "canonical": run_canonical, "directory": run_systems, "systems": run_systems, "rank": run_rank}[a.command](spark, a)


if __name__ == "__main__":
    raise SystemExit(main())
