"""Text normal forms: kernels, columns, and that both agree."""

import pytest
from pyspark.sql import functions as F

from veritext.config import ScoringConfig
from veritext.functions import kernels, rules, text
from veritext.operators import adapters

CONFIG = ScoringConfig()


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


FLAT = ["a  b\n c", "<b>x</b><br/>y", "![alt](u) [link](v) *em* `c`", "中 文 ， 字", "<!-- a\nb -->z", " x ", "a\x1cb", "中　文"]


def test_flat(spark):
    want = [kernels.flat(t) for t in FLAT]
    assert want[:5] == ["a b c", "x y", "alt link em c", "中文 ，字", "z"]
    assert column(spark, text.flat_column, FLAT) == want == column(spark, text.flat_udf, FLAT)
    assert kernels.flat("a &amp; &lt;b&gt;c") == "a & c"


@pytest.mark.parametrize(("given", "want"), [
    ("a<sup>[1]</sup>b", "ab"), ("x$^{2}$y", "xy"), ("x^{三}y", "xy"), ("SSP1-2.63 x", "SSP1-2.6 x"), ("t[注12]u[3]", "tu"), ("<sup>word two</sup>", "<sup>word two</sup>"),
])
def test_footnotes(spark, given, want):
    assert kernels.footnotes(given, CONFIG) == want and column(spark, text.footnotes_column, [given]) == [want]


def test_images():
    assert kernels.merge_markers("![]\n\n![]\n\ntext") == "![]\ntext"
    assert kernels.images("a ![x](y)![z][1] b", CONFIG) == "a ![] b"
    assert kernels.images("<image><x>1</x></image>", CONFIG).strip() == "![]"
    assert kernels.images("[图片]\n<pic/>\nt", CONFIG) == "![]\nt"
    assert kernels.images("<img src=1>", ScoringConfig(normalize_images=False)) == "<img src=1>"


def test_details():
    nested = "<details><summary>Text</summary>a<details><summary>flow-chart</summary>b</details></details>"
    assert kernels.details(nested, CONFIG).split() != [] and "<details>" not in kernels.details(nested, CONFIG)
    assert kernels.details("<details><summary>Natural image</summary>b</details>", CONFIG) == "\n![]\n"
    assert kernels.details("<details><summary>x</summary>```mermaid\ng\n```</details>", CONFIG) == "\n![]\n"
    assert kernels.details("<details><summary>natural image</summary>b</details>", ScoringConfig(normalize_images=False)) == "\n"


def test_semantic():
    assert kernels.semantic("Ａ，甲，乙——“q”", CONFIG) == 'A,甲乙-"q"'
    assert kernels.semantic("a<br>b\t c", CONFIG) == "a\nb c"
    assert kernels.variants("體", ScoringConfig(variants=(("體", "体"),))) == "体" and kernels.variants("體", CONFIG) == "體"


LINES = ["12", "- 12 -", "Page 12 of 90", "第12页/共90页", "第一节 ...... 2", "text 3", "2023年", "", "a...b", "illustration of a cat, no text or symbols", "page 3", "１２"]


def test_line_predicates(spark):
    assert column(spark, text.page_number, LINES) == [True, True, True, True, False, False, False, False, False, False, True, True]
    assert column(spark, text.toc_leader, LINES)[4] is True and sum(column(spark, text.toc_leader, LINES)) == 1
    assert sum(column(spark, text.caption, LINES)) == 1
    assert column(spark, text.report_header, ["Annual Report", "年度报告", "x" * 90 + "report", "none"]) == [True, True, False, False]
    assert column(spark, text.running_header, ["# Some Company Limited", "甲股份有限公司", "x"]) == [True, True, False]
    assert column(spark, text.page_artifact, ["Annual Report", "| a | Report |", "甲有限公司", "甲有限公司，的", "# 收入", "<table> report", "12", ""]) == [True, False, True, False, True, False, True, False]
    assert column(spark, text.pipe_separator, ["|---|:---:|", "| -- | --- |", "a|b", "---"]) == [True, False, False, False]


def test_lines(spark):
    assert column(spark, text.lines, ["a\nb\n", "a\r\nb\x0bc", "", "\n"]) == [x.splitlines() for x in ["a\nb\n", "a\r\nb\x0bc", "", "\n"]]
    assert column(spark, text.line_content, ["> ● [a b]", "- x", "{y}"]) == ["ab", "x", "y"]
    assert column(spark, text.heading_text, ["## T ##", "#x", "   # a", "plain"]) == ["T", "#x", "a", "plain"]


def test_body(spark):
    given = "# A\n\n\n\n12\n目录 ..... 3\n甲，乙\n\n![](x)\n\n![](y)\nend"
    assert column(spark, lambda c: text.body(text.without_heading_marks(c), CONFIG), [given]) == ["A\n\n甲乙\n![]\nend"]
    repeated = "\n".join(["My Report", "x"] * 3)
    rows = spark.createDataFrame([(repeated,)], "t string")
    assert text.with_body(rows, "t", "b", CONFIG, True).first().b == "x\nx\nx" and text.with_body(rows, "t", "b", CONFIG).first().b != "x\nx\nx"


def test_helpers(spark):
    assert column(spark, text.slug, ["My Parser 1.0", "..", "解析"]) == ["My_Parser_1.0", "system", "解析"]
    assert column(spark, lambda c: text.preview(c, 10), ["a\nb", "x" * 20]) == ["a\\nb", "x" * 7 + "..."]


def test_rule_languages(spark):
    rule = rules.Rule(r"^[\s]*x$", "y", "m")
    assert column(spark, rule.column, [" x\nx\r\n x", "  x"]) == [rule.python(" x\nx\r\n x"), "y"]


def test_config():
    with pytest.raises(ValueError):
        ScoringConfig(normalize_zh="x")
    with pytest.raises(ValueError):
        ScoringConfig(table_structure_weight=0, table_content_weight=0)


def test_page_noise_keeps_a_document_whole(spark):
    docs = spark.createDataFrame([("a", "Annual Report\nx\n7\nAnnual Report\n<table>\nAnnual Report\n</table>\nAnnual Report"), (None, "y\nPage 1 of 2"), ("n", None)], "doc_id string, text string")
    out = adapters.remove_page_noise(["doc_id"])(adapters.started(docs))
    got = {r.doc_id: (r.text, {k: n for k, n in r.stats.items() if n}) for r in out.collect()}
    # A document without an id was lost by the join with its lines, and rows were shuffled for it.
    assert got == {"a": ("Annual Report\nx\n<table>\nAnnual Report\n</table>", {"standalone_page_numbers_removed": 1, "duplicate_running_headers_removed": 2}), None: ("y", {"standalone_page_numbers_removed": 1}), "n": ("", {})}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
