"""Sources, sinks, adapters, canonical form, streaming and the command line."""

import hashlib
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veritext import cli
from veritext.operators import adapters, canonical
from veritext.plans import catalogue, score
from veritext.sources import markdown, sinks
from veritext.streaming import scoring


def write(folder, **files):
    for name, body in files.items():
        (folder / f"{name}.md").write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(folder)


def test_read_documents(spark, tmp_path):
    path = write(tmp_path, a="﻿x\r\ny\rz", b=b"bad \xff byte")
    got = {r.file_name: r for r in markdown.read_documents(spark, path).collect()}
    assert got["a.md"].text == "x\ny\nz" and "�" in got["b.md"].text and got["b.md"].content_sha256 == hashlib.sha256(b"bad \xff byte").hexdigest()


def test_resolution(spark):
    files = spark.createDataFrame([("/p/005.md", "005.md"), ("/p/006_x.md", "006_x.md"), ("/p/006_report.md", "006_report.md"), ("/p/MEITUAN.md", "MEITUAN.md")], "path string, file_name string")
    wanted = spark.createDataFrame([("005",), ("006",), ("007",)], "doc_id string")
    aliases = spark.createDataFrame([("007", "meituan")], "doc_id string, alias string")
    got = {r.doc_id: r.path for r in markdown.resolve_predictions(files, wanted, aliases).collect()}
    assert got == {"005": "/p/005.md", "006": "/p/006_x.md", "007": "/p/MEITUAN.md"}
    twice = files.unionByName(spark.createDataFrame([("/p/006_y.md", "006_y.md")], files.schema))
    with pytest.raises(Exception, match="expected one file"):
        markdown.resolve_predictions(twice, wanted, aliases).collect()
    with pytest.raises(Exception, match="no file"):
        markdown.require_all(files.withColumn("doc_id", F.lit("005")), wanted).collect()
    with pytest.raises(Exception, match="expected 3"):
        markdown.require_count(files, 3, "files").collect()


def test_manifest_gate(spark, tmp_path):
    flags = {c: False for c in ("uses_ground_truth", "uses_pdf", "uses_document_id_rules", "merges_or_splits_tables", "reorders_content")}
    for name, given in {"good": flags, "bad": flags | {"uses_pdf": True}, "absent": {k: v for k, v in flags.items() if k != "uses_pdf"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"system": name, "constraints": given, "totals": {"x": 1}}))
    manifests = markdown.read_manifests(spark, str(tmp_path))
    assert {(r.system, r.constraint) for r in markdown.manifest_violations(manifests).collect()} == {("bad", "uses_pdf"), ("absent", "uses_pdf")}
    assert [r.system for r in markdown.admitted(manifests).collect()] == ["good"] and markdown.admitted(manifests, True).count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("006", "b\"q", 1.5), ("005", "中", None)], "doc_id string, name string, x double")
    sinks.write_text(sinks.pretty_json(rows, ["doc_id"]), "value", f"{tmp_path}/a/x.json")
    assert [r["doc_id"] for r in json.loads((tmp_path / "a/x.json").read_text())] == ["005", "006"]
    sinks.write_text(sinks.csv_text(rows, ["doc_id"]), "value", f"{tmp_path}/x.csv")
    assert (tmp_path / "x.csv").read_bytes().startswith("﻿doc_id,name,x\r\n005,中,".encode())


SOURCE = "# Co Limited\n<details><summary>text_image</summary>a<br>b</details>\n<details open><summary>Natural image</summary>z</details>\n![x](y)\n\n<img src=1>\nA photo of a cat, no text or symbols\nx<sup> 1 </sup><!-- c -->\n12\n# Co Limited\n<table><tr><td>12</td></tr></table>\n# Co Limited\nend  "


def test_adapter(spark):
    docs = spark.createDataFrame([("d", SOURCE), ("e", ""), ("f", None)], "doc_id string, text string").fillna("")
    once = adapters.adapt(docs, "details", ["doc_id"]).cache()
    got = {r.doc_id: r for r in once.collect()}
    assert got["d"].text == "# Co Limited\n\na<br>b\n\n![]\n\nx1\n<table><tr><td>12</td></tr></table>\nend\n" and got["e"].text == "\n"
    assert got["d"].stats == {"details_wrappers_removed": 2, "text_details_unwrapped": 1, "visual_details_to_image_marker": 1, "markdown_images_normalized": 1, "html_images_normalized": 1, "generated_image_captions_removed": 1, "sup_wrappers_removed": 1, "comments_removed": 1, "standalone_page_numbers_removed": 1, "duplicate_running_headers_removed": 2}
    again = adapters.adapt(once.select("doc_id", "text"), "details", ["doc_id"])
    checks = {r.doc_id: r for r in adapters.validate(docs, once, again, ["doc_id"]).collect()}
    assert checks["d"].error is None and checks["d"].artifact_headings_removed == 2 and checks["d"].idempotent
    spoilt = once.withColumn("text", F.replace("text", F.lit("<td>12"), F.lit("<td>13")))
    assert {r.doc_id: r.error for r in adapters.validate(docs, spoilt, spoilt, ["doc_id"]).collect()}["d"] == "table matrix changed"
    made = adapters.manifest(docs, once, adapters.validate(docs, once, again, ["doc_id"]).drop("error"), "s", "details", ["rule"]).first()
    assert made.totals["comments_removed"] == 1 and len(made.files) == 3


def test_canonical(spark):
    md = "<details><summary>Flowchart</summary>x</details>\n<details><summary>text_image</summary>a\n\nb\nc</details>\n<TABLE><tr>\n<td colspan='2' ROWSPAN=3> a <BR/> b<img src=1></td></tr></TABLE>\n\n\n\nx<sup> 1 </sup>![p](q) \n"
    rows = spark.createDataFrame([("1", md), ("2", "<table><tr><td class='x'>a</td></tr></table>"), ("3", "plain\n"), ("4", "<table></table>")], "doc_id string, text string")
    known = spark.createDataFrame([("1", "A -> B")], "doc_id string, flowchart string")
    got = {r.doc_id: r for r in canonical.canonicalize(rows, known).collect()}
    assert got["1"].text == 'A -> B\n\n<table>\n  <tr>\n    <td rowspan="3" colspan="2">a<br>b</td>\n  </tr>\n</table>\n\nx1![]\n'
    assert "attributes" in got["2"].error and not got["3"].changed and "no rows" in got["4"].error
    again = canonical.canonicalize(spark.createDataFrame([("1", got["1"].text)], "doc_id string, text string"))
    assert not again.first().changed and canonical.check(rows.where("doc_id = '3'")).first().any_changed is False
    assert canonical.topics("| 編號 | 議題 |\n|---|---|\n| 1 | 甲 |") == "圖中議題：\n\n1. 甲"


def test_stream(spark, tmp_path):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    write(arrivals, a="# A\n\nbody text")
    refs = spark.createDataFrame([("a", "# A\n\nbody text", None), ("b", "x", None)], "doc_id string, gt string, gt_alt string")
    stream = scoring.read_documents(spark, str(arrivals)).select(F.lit("s").alias("system_id"), F.regexp_replace("file_name", ".md$", "").alias("doc_id"), F.col("text").alias("pred"))
    for _ in range(2):
        scoring.score_arrivals(stream, refs, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        write(arrivals, b="y")
    got = {r.doc_id: r.final_score for r in scoring.current(spark, f"{tmp_path}/out").collect()}
    assert got["a"] == 100 and got["b"] == 60
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "a")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in scoring.windowed_counts(events, "t", ["k"]).collect()) == [1, 2]


def test_command_line(spark, tmp_path):
    folder = write(tmp_path, gt="# A\n\ntext", pred="# A\n\ntext")
    assert cli.main(["score", "--gt", f"{folder}/gt.md", "--pred", f"{folder}/pred.md", "--json-out", f"{folder}/out.json", "--markdown-out", f"{folder}/out.md"]) == 0
    assert json.loads((tmp_path / "out.json").read_text())["final_score"] == 100 and "Final Score: 100.0000" in (tmp_path / "out.md").read_text()


def test_catalogue():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) >= 35 and score.KEYS == ["system_id", "doc_id"]


def test_entry_without_llm(tmp_path):
    """A copy without the subpackage and the pipeline still has all other queries."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "veritext", tmp_path / "veritext", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), '|', *e.oracle_sql())"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    names, oracles = (set(x.split()) for x in told.split("|"))
    assert names == set(catalogue.queries()) and oracles == set(catalogue.oracle_sql())
