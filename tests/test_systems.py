"""From folders to a leaderboard; and published figures, where their files are at hand."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veritext import cli
from veritext.plans import score
from veritext.sources import markdown

DOCUMENT = "# A\n\nsome text of its own\n\n<table><tr><td>x</td><td>1</td></tr></table>\n"
FLAGS = {c: False for c in ("uses_ground_truth", "uses_pdf", "uses_document_id_rules", "merges_or_splits_tables", "reorders_content")}


def folders(root):
    for at, text in {"gt/primary/001.md": DOCUMENT, "gt/primary/002.md": "# B\n", "gt/semi_semantic/001.md": DOCUMENT, "gt/semi_semantic/002.md": "# B\n",
                     "p/good/001.md": DOCUMENT, "p/good/002_x.md": "# B\n", "p/other/001.md": "# Z\n", "p/other/Beta.md": "# B\n", "p/cheat/001.md": DOCUMENT, "p/cheat/002.md": "# B\n"}.items():
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_text(text)
    for name in ("good", "other", "cheat"):
        (root / f"p/{name}/normalization_manifest.json").write_text(json.dumps({"system": name, "constraints": FLAGS | ({"uses_pdf": True} if name == "cheat" else {})}))


def test_all_systems(spark, tmp_path):
    folders(tmp_path)
    given = ["--gt-root", f"{tmp_path}/gt", "--predictions", f"{tmp_path}/p", "--output", f"{tmp_path}/out", "--documents", "001", "002", "--alias", "002=beta", "--label", "good=The good one"]
    assert cli.main(["systems", *given]) == 0
    board = json.loads((tmp_path / "out/leaderboard.json").read_text())
    assert [(r["rank"], r["system"], r["system_name"], r["document_count"]) for r in board] == [(1, "good", "The good one", 2), (2, "other", "other", 2)]
    assert board[0]["final_score"] == 100 and board[1]["final_score"] < 100 and not (tmp_path / "out/cheat").exists()
    rows = json.loads((tmp_path / "out/good/summary.json").read_text())
    assert [r["doc_id"] for r in rows] == ["001", "002"] and "The good one" in (tmp_path / "out/good/summary.md").read_text()


def test_directory_errors(spark, tmp_path):
    folders(tmp_path)
    (tmp_path / "p/good/002_x.md").unlink()
    given = ["--gt-root", f"{tmp_path}/gt", "--predictions", f"{tmp_path}/p/good", "--system", "good", "--output", f"{tmp_path}/out", "--documents", "001", "002"]
    assert cli.main(["directory", *given]) == 1
    assert [(r["doc_id"], r["error"]) for r in json.loads((tmp_path / "out/errors.json").read_text())] == [("002", "no prediction")]
    assert [r["doc_id"] for r in json.loads((tmp_path / "out/summary.json").read_text())] == ["001"]


#: Published figures: system (by the order of the folders' names), document -> final, table, heading and text scores, table structure and content, matched, missing and extra tables.
GOLDEN = {
    (0, "008"): (93.4126, 93.1919, 83.0751, 98.8021, 93.8166, 92.2549, 218, 0, 11),
    (0, "009"): (97.8692, 99.1694, 91.4367, 99.7852, 99.1483, 99.201, 182, 1, 0),
    (2, "008"): (93.1085, 93.1919, 81.0855, 99.0365, 93.8166, 92.2549, 218, 0, 11),
    (2, "009"): (96.3772, 99.1694, 89.4415, 97.0529, 99.1483, 99.201, 182, 1, 0),
    (5, "008"): (93.6629, 90.5005, 92.0599, 97.6269, 91.0934, 89.6111, 220, 0, 16),
    (5, "009"): (92.5998, 88.1487, 90.9173, 97.8922, 89.1909, 86.5853, 182, 1, 15),
}


@pytest.mark.skipif("PUBLISHED_DIR" not in os.environ, reason="PUBLISHED_DIR names the folder of published references and predictions")
def test_published_figures(spark):
    """Slow: some minutes for these documents. Every figure to four digits."""
    root = Path(os.environ["PUBLISHED_DIR"])
    systems = sorted(p for p in (root / "normalized_predictions").iterdir() if p.is_dir())
    read = lambda p: p.read_text(encoding="utf-8-sig")
    rows = [(str(k), d, read(root / f"data/gt/primary/{d}.md"), read(systems[k] / f"{d}.md"), read(root / f"data/gt/semi_semantic/{d}.md")) for k, d in GOLDEN]
    rows += [("self", d, read(root / f"data/gt/primary/{d}.md"), read(root / f"data/gt/primary/{d}.md"), read(root / f"data/gt/semi_semantic/{d}.md")) for d in ("008",)]
    docs = spark.createDataFrame(rows, "system_id string, doc_id string, gt string, pred string, gt_alt string").repartition(len(rows))
    got = {(r.system_id, r.doc_id): r for r in score.summary(score.evaluate(docs, "max")).collect()}
    for (k, d), want in GOLDEN.items():
        r = got[str(k), d]
        assert (r.final_score, r.table_score, r.title_layout_score, r.text_score, r.table_structure_score, r.table_content_score, r.matched_table_count, r.missing_table_count, r.extra_table_count) == want, (k, d)
    assert got["self", "008"].final_score == 100


def test_in_place(spark, tmp_path):
    (tmp_path / "primary").mkdir()
    (tmp_path / "primary/001.md").write_text("a  \n\n\n\nb<!-- c -->")
    (tmp_path / "flow.json").write_text(json.dumps({"001": "x -> y"}))
    given = ["canonical", "--gt-root", str(tmp_path), "--flowcharts", f"{tmp_path}/flow.json"]
    assert cli.main([*given, "--check"]) == 1 and cli.main([*given, "--in-place", "--expected", "1"]) == 0
    assert (tmp_path / "primary/001.md").read_text() == "a\n\nb\n" and cli.main([*given, "--check"]) == 0
    assert markdown.read_documents(spark, str(tmp_path), True).where(F.col("file_name") == "001.md").count() == 1
