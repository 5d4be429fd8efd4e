"""Extraction, alignment, matching and whole scores."""

import difflib
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.config import ScoringConfig
from veritext.functions import markup
from veritext.operators import cleanup, distance, extract, headings, tables
from veritext.plans import catalogue, rendered, report, score


def cell(text, down=1, across=1):
    return (text, down, across)


@pytest.mark.parametrize(("rows", "want"), [
    ([[cell("A", 2), cell("B")], [cell("C")]], [["A", "B"], ["A", "C"]]),
    ([[cell("A"), cell("B", 2)], [cell("C"), cell("D")]], [["A", "B"], ["C", "B", "D"]]),
    ([[cell("A"), cell("B", 2)], []], [["A", "B"], ["", "B"]]),
    ([[cell("A", 1, 3)]], [["A", "A", "A"]]),
    ([[cell("A", 3)], [cell("B")], []], [["A"], ["A", "B"], ["A"]]),
    ([], []),
])
def test_spread(rows, want):
    assert markup.spread(rows) == want


def test_html_matrix():
    assert markup.html_matrix("<table><tr><td>a<br>b</td><th rowspan='x'>&amp;</th></tr><td>lost</td><tr><td>open<td>kept</td></tr></table>") == [["a b", "&"], ["kept"]]


def test_extract():
    md = "<!-- table spans PDF pages 2-3 -->\n<table><tr><td>x</td></tr></table>\n\n|A|B|\n|---|---|\n|1|x\\|y|\n| - | - |\nend"
    found = markup.extract(md)
    first, second = found["tables"]
    assert first["span_pages"] == {"start": 2, "end": 3} and second["span_pages"] is None
    assert second["matrix"] == [["A", "B"], ["1", "x|y"], ["-", "-"]] and second["kind"] == "pipe"
    assert "<table" not in found["body"] and found["body"].endswith("end")
    assert markup.cross_page("<!-- table spans PDF pages 5-5 -->", 34) is None


def test_round_trip():
    rng = random.Random(1)
    for _ in range(50):
        m = [["".join(rng.choice("ab中|") for _ in range(rng.randint(1, 4))) for _ in range(3)] for _ in range(4)]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in m) + "</table>"
        pipe = "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in [m[0], ["---"] * 3, *m[1:]])
        assert markup.extract(html)["tables"][0]["matrix"] == m == markup.extract(pipe)["tables"][0]["matrix"]


def test_headings(spark):
    docs = spark.createDataFrame([("d", "# A\n```\n# no\n```\n### B ###\ntext\n   ###### C\n#no")], "doc_id string, body string")
    assert [tuple(r)[1:] for r in extract.headings(docs, ["doc_id"]).orderBy("index").collect()] == [(0, 1, "A", 1), (1, 3, "B", 2), (2, 6, "C", 3)]
    assert [tuple(h) for h in docs.select(extract.heading_list(F.col("body")).alias("h")).first().h] == [(1, "A"), (3, "B"), (6, "C")]


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc中😀") for _ in range(rng.randint(0, 25))), "".join(rng.choice("abc中😀") for _ in range(rng.randint(0, 25)))) for _ in range(200)]
    for a, b in pairs:
        assert distance.levenshtein(a, b) == plain_levenshtein(a, b) <= distance.segmented(a, b)
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", F.levenshtein("a", "b").alias("d"), distance.normalized(F.col("a"), F.col("b"), 30).alias("n")).orderBy("i").collect()
    assert [r.d for r in got] == [plain_levenshtein(a, b) for a, b in pairs]
    assert all(abs(r.n - (r.d if len(a) * len(b) <= 30 else distance.segmented(a, b)) / max(len(a), len(b), 1)) < 1e-12 or r.n == 1 for r, (a, b) in zip(got, pairs))


def test_segmented_follows_line_alignment():
    a, b = "x\ny\nz\n", "x\nq\nz\nw\n"
    ops = difflib.SequenceMatcher(None, a.splitlines(True), b.splitlines(True), autojunk=False).get_opcodes()
    assert distance.segmented(a, b) == 3 and len(ops) == 4


def test_alignment_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, m = rng.integers(0, 6, 2)
        cost = rng.choice([0.0, 0.3, 1.1, 1.0], (n, m))
        best = {(0, 0): 0.0}
        for i in range(n + 1):
            for j in range(m + 1):
                if i or j:
                    ways = [(i - 1, j, 1.0), (i, j - 1, 1.0), (i - 1, j - 1, cost[i - 1, j - 1] if i and j else 0)]
                    best[i, j] = min(best[a, b] + c for a, b, c in ways if a >= 0 and b >= 0)
        total, ops = headings.align(n, m, cost)
        assert abs(total - best[n, m]) < 1e-12 and abs(sum(o[3] for o in ops) - total) < 1e-9
        assert [o[1] for o in ops if o[1] >= 0] == list(range(n)) and [o[2] for o in ops if o[2] >= 0] == list(range(m))


def test_heading_score(spark):
    kind = "array<struct<level:int,text:string>>"
    rows = spark.createDataFrame([("same", [(1, "A"), (2, "B")], [(1, "A"), (3, "B")]), ("other", [(1, "A")], [(1, "B")]), ("none", [], []), ("half", [(1, "A")], []), ("levels", [(1, "A"), (2, "B")], [(1, "A"), (1, "B")])], f"k string, gt {kind}, pred {kind}")
    got = {r.k: r.title for r in headings.score(rows, "gt", "pred").collect()}
    assert got["same"].title_layout_score == got["other"].title_layout_score == got["none"].title_layout_score == 100
    assert got["half"].title_layout_score == 0 and got["half"].missing_heading_count == 1
    assert got["levels"].level_accuracy_score == 50 and got["levels"].title_layout_score == 95 and got["levels"].level_mismatch_count == 1


def test_structure_and_greedy(spark):
    s = spark.range(1).select(tables.structure_score(F.lit(2), F.lit(2), F.lit(3), F.lit(2)).alias("a"), tables.structure_score(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("b"), tables.set_similarity(F.lit(1), F.lit(2), F.lit(1)).alias("c")).first()
    assert abs(s.a - 77.7778) < 1e-4 and s.b == 100 and s.c == 1
    edges = spark.createDataFrame([([(0, 1), (0, 2), (1, 1), (1, 2)],)], "e array<struct<p:int,g:int>>")
    assert [tuple(x) for x in edges.select(tables.greedy(F.col("e")).alias("k")).first().k] == [(0, 1), (1, 2)]


GT = "# Title\n\nintro text\n\n<table><tr><td>revenue total</td><td>1</td></tr><tr><td>costs other</td><td>2</td></tr></table>\n\n## Part\n\n| name | value |\n|---|---|\n| assets | 5 |\n| debts | 7 |\n\nclosing words"


@pytest.fixture(scope="module")
def results(spark):
    less = GT.replace("| debts | 7 |\n", "").replace("closing", "other").replace("## Part\n", "")
    rows = [("s", "same", GT, GT, GT), ("s", "less", GT, less, GT), ("s", "empty", "", "", ""), ("s", "gone", GT, "", None), ("s", "null", None, None, None)]
    docs = spark.createDataFrame(rows, "system_id string, doc_id string, gt string, pred string, gt_alt string")
    return score.evaluate(docs).cache()


def test_evaluate(results):
    got = {r.doc_id: r for r in score.summary(results).collect()}
    assert all(got[k][f] == 100 for k in ("same", "empty", "null") for f in score.SCORES)
    assert got["same"].matched_table_count == got["same"].primary_selected_pair_count == 2
    assert got["gone"].final_score == 0 and got["gone"].missing_table_count == 2
    assert 60 < got["less"].final_score < 100 and got["less"].table_score < 100 and got["less"].title_layout_score < 100 and got["less"].text_score < 100


def test_strategies(spark):
    docs = spark.createDataFrame([("s", "d", GT, GT.replace("assets", "aspects"), GT)], "system_id string, doc_id string, gt string, pred string, gt_alt string")
    by = {k: score.evaluate(docs, k).first() for k in score.STRATEGIES}
    assert len({r.table_score for r in by.values()}) == 1 and [by[k].selected_gt for k in score.STRATEGIES] == ["primary", "alt", "per_table_max"]
    assert score.evaluate(docs.drop("gt_alt"), "alt").first().selected_gt == "primary (alt unavailable)"
    with pytest.raises(ValueError):
        score.evaluate(docs, "best")


def test_reports(spark, results):
    text = {r.doc_id: r.report for r in report.document_reports(results).collect()}
    assert "- Final Score: 100.0000" in text["same"] and "- primary GT table 0 -> Pred table 0: pair=100.0000" in text["same"] and "- No matched tables." in text["gone"]
    summary = score.summary(results).withColumn("document", F.col("doc_id"))
    whole = report.summary_report(summary, "X").first().report
    assert "| same | same | 100.00 |" in whole and whole.startswith("# X")


def test_leaderboard(spark):
    rows = spark.createDataFrame([("a", 0, 90.0), ("b", 1, 95.0), ("c", 2, 90.0)], "system_id string, system_ordinal int, final_score double")
    for s in score.SCORES[1:]:
        rows = rows.withColumn(s, F.col("final_score"))
    assert [(r.rank, r.system_id) for r in score.leaderboard(rows).orderBy("rank").collect()] == [(1, "b"), (2, "a"), (3, "c")]


def test_cleanup(spark):
    pred = "Annual Report\nbody\nAnnual Report\n7\nbody"
    docs = spark.createDataFrame([("d", pred, "Annual Report"), ("e", "x", None), ("f", None, "x")], "doc_id string, pred string, gt string")
    got = {r.doc_id: (r.text, r.removed_line_count, list(r.removed_line_examples)) for r in cleanup.remove_repeated(docs, ["doc_id"], "pred", "gt").collect()}
    assert got["d"] == ("Annual Report\nbody\nbody", 2, ["Annual Report", "7"]) and got["e"][0] == "x" and got["f"][1] == 0
    config = ScoringConfig(remove_pred_header_footer=True)
    one = spark.createDataFrame([("s", "d", "body", "body\n12\n12")], "system_id string, doc_id string, gt string, pred string")
    assert score.evaluate(one, "primary", config).first().removed_line_count == 2


def test_level_alignment_takes_all_rows(spark, tmp_path):
    rows = [(k, "Customer" + "x" * (k % 7), 0 if k <= 330 else 1) for k in range(1, 601)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    a, b = (np.array([len(n) + k % 3 for k, n, g in rows if g == nation], float) for nation in (0, 1))
    cost, ops = headings.align(len(a), len(b), np.abs(a[:, None] - b[None, :]))
    got = catalogue.queries()["level_alignment"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(0, cost, len(ops))] and len(ops) >= 330


def test_level_rows_align_as_the_matrix_does():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = ([int(x) for x in rng.integers(-3, 4, n)] for n in rng.integers(0, 13, 2))
        want = headings.align(len(a), len(b), np.abs(np.array(a, float)[:, None] - np.array(b, float)[None, :]))
        assert headings.level_cost(a, b) == want[0] and headings.align_levels(a, b) == want
    assert headings.level_cost([1, None], [1, None]) == 2 == headings.align_levels([1, None], [1, None])[0]


def test_level_alignment_memory_grows_with_one_list():
    rng = np.random.default_rng(3)
    a, b = ([int(x) for x in rng.integers(1, 7, 3000)] for _ in range(2))
    tracemalloc.start()
    cost, (total, ops) = headings.level_cost(a, b), headings.align_levels(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A matrix of 3,000 x 3,000 doubles takes 72 MB.
    assert cost == total and len(ops) >= 3000 and most < 8_000_000


def test_topk_candidates_come_from_short_lists(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "B", rng.choice("xy"), rng.choice([None, *range(30)])) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for k, _, kind, size in rows:
        far = lambda b: 1000 if None in (size, b[3]) else abs(size - b[3])  # noqa: B023, E731
        best = sorted((b for b in rows if b[2] == kind and b[0] != k), key=lambda b: (far(b), b[0]))[:6]
        want |= {(k, b[0], None if far(b) == 1000 else round(0.7 * (100 - far(b)) + 15, 6)) for b in best}
    got = catalogue.queries()["topk_candidates"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 2400 and {tuple(r) for r in got} == want
    lists = rendered._nearest_parts(spark.read.parquet(f"{tmp_path}/part.parquet")).groupBy("p_type", "p_size").count().collect()
    assert len(lists) == 62 and max(r["count"] for r in lists) <= 14


def test_nearest_customers():
    rng = np.random.default_rng(6)
    for n, m in [(40, 300), (5, 3), (3, 0), (0, 4), (200, 200)]:
        values = np.where(rng.random(m) < 0.1, np.nan, rng.integers(0, 60, m) / 4)
        wanted = np.where(rng.random(n) < 0.1, np.nan, rng.integers(-8, 260, n) / 16)
        keys = rng.permutation(m)
        far = lambda a, b: float("inf") if np.isnan(a) or np.isnan(b) else abs(a - b)
        want = [(i, *x) for i, a in enumerate(wanted) for x in sorted((far(a, b), int(k)) for b, k in zip(values, keys))[:6]]
        key, gap, other = rendered.nearest(np.arange(n), keys, values, wanted, 6)
        assert list(zip(key.tolist(), gap.tolist(), other.tolist())) == want


def test_greedy_of_many_edges(spark):
    edges = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(29999)), lambda i: F.struct((i % 20000).cast("int").alias("p"), i.cast("int").alias("g"))).alias("e"))
    began = time.monotonic()
    kept = edges.select(tables.greedy(F.col("e")).alias("k")).first().k
    assert len(kept) == 20000 and [tuple(x) for x in kept[:2]] == [(0, 0), (1, 1)] and time.monotonic() - began < 60


def test_plain_rows_of_cells_need_no_parser():
    rng = random.Random(7)
    plain = 0
    for _ in range(2000):
        cell = lambda: "<td" + rng.choice(["", " rowspan=2", ' colspan="3" rowspan=0', " rowspan=2 rowspan=3"]) + ">" + rng.choice(["a", "<b>x y</b> ", " ", "*b*", "[l](u)", "é  ", "\n", "&amp;"]) + rng.choice(["</td>", "</td>", "</td>", "</th>", ""])
        raw = "<table>" + "".join("<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>" for _ in range(rng.randint(0, 3))) + "</table>"
        parser = markup._Cells()
        parser.feed(raw)
        parser.close()
        found = markup.simple_cells(raw)
        plain += found is not None
        assert found is None or found == parser.rows
    assert plain > 500 and markup.simple_cells("<table><tr><td>open</tr></table>") is None


def test_relative_levels_of_a_long_list(spark):
    levels = F.transform(F.sequence(F.lit(0), F.lit(59999)), lambda i: (i * 7 % 5).cast("int"))
    began = time.monotonic()
    got = spark.range(1).select(levels.alias("l")).select(extract.relative_levels(F.col("l")).alias("r")).first().r
    # Listing the distinct levels once for each level takes minutes.
    assert list(got) == [i * 7 % 5 + 1 for i in range(60000)] and time.monotonic() - began < 30
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS l").select(extract.relative_levels(F.col("l")).alias("r")).first().r is None


def test_lines_of_a_long_document(spark):
    text = "".join(f"line {i} of many" + ("\r\n" if i % 3 else "\n") for i in range(30000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a\n\nb")], "doc_id int, text string")
    began = time.monotonic()
    found = extract.lines(docs, ["doc_id"])
    size, end, n = found.where("doc_id = 1").agg(F.sum(F.length("text")), F.max("end"), F.count(F.lit(1))).first()
    # With the whole text at each of its lines this takes minutes.
    assert (n, end) == (30000, len(text)) and size == sum(map(len, text.split())) + 3 * 30000 and time.monotonic() - began < 40
    assert [(r.line_no, r.start, r.end, r.text) for r in found.where("doc_id = 3").orderBy("line_no").collect()] == [(0, 0, 2, "a"), (1, 2, 3, ""), (2, 3, 4, "b")]


def test_body_scores_take_few_python_workers(spark):
    from veritext.operators import body

    docs = spark.createDataFrame([("# A\nb\n\n3\nc", "# A\nb  d\nc")], "a string, b string")
    plan = body.score(docs, "a", "b", ScoringConfig())._jdf.queryExecution().executedPlan().toString()
    # Two for the normal forms and one for long texts' distances; before, each side had its own two.
    assert plan.count("ArrowEvalPython") <= 3
