"""Ordered rewriting rules, which run in Python workers (re) or as Spark columns (regexp_replace) alike."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """pattern -> replacement, in which $1 is the first group. flags: letters of i, m, s."""

    pattern: str
    replacement: str = ""
    flags: str = ""

    def python(self, text: str) -> str:
        return compiled(self.pattern, self.flags).sub(re.sub(r"\$(\d)", r"\\\1", self.replacement.replace("\\", "\\\\")), text)

    def column(self, c: Column) -> Column:
        return F.regexp_replace(c, self.java, self.replacement)

    @property
    def java(self) -> str:
        """The pattern with Python's meaning: LF alone ends lines, classes are Unicode's, and white space has the ASCII separators."""
        return f"(?dU{self.flags})" + self.pattern.replace(r"[\s", r"[\s\x1c-\x1f").replace(r"[^\s", r"[^\s\x1c-\x1f")


_CACHE: dict[tuple[str, str], re.Pattern] = {}


def compiled(pattern: str, flags: str = "") -> re.Pattern:
    if (found := _CACHE.get((pattern, flags))) is None:
        found = _CACHE[pattern, flags] = re.compile(f"(?{flags})" * bool(flags) + pattern)
    return found


def apply(rules: tuple[Rule, ...], text: str) -> str:
    for rule in rules:
        text = rule.python(text)
    return text


def columns(rules: tuple[Rule, ...], c: Column) -> Column:
    for rule in rules:
        c = rule.column(c)
    return c


# --- fixed values: patterns of the protocol ---
WIDE = "㐀-鿿"
WIDE_OR_MARK = WIDE + "、-〿！-／：-＠［-｀｛-･"
NOTE = "[0-9A-Za-z０-９一二三四五六七八九十]+"

NEWLINES = (Rule(r"\r\n?", "\n"),)
COMMENT = Rule(r"<!--.*?-->", " ", "s")
LINK = Rule(r"\[([^\]]+)\]\([^)]+\)", "$1")
EMPHASIS = Rule(r"[*_`~]+")

#: Flat text, after entities: comments, images, links, breaks, tags, emphasis, white space.
FLAT = (
    COMMENT, Rule(r"!\[([^\]]*)\]\([^)]+\)", "$1"), LINK, Rule(r"<br[\s]*/?>", " ", "i"), Rule(r"<[^>]+>", " "), EMPHASIS,
    Rule(" ", " "), Rule(r"[\s]+", " "), Rule(rf"([{WIDE_OR_MARK}])[\s]+([{WIDE_OR_MARK}])", "$1$2"), Rule(r"^[\s]+|[\s]+\Z"),
)
FOOTNOTES = (
    Rule(rf"<sup\b[^>]*>[\s]*[\[\(（]?[\s]*{NOTE}[\s]*[\]\)）]?[\s]*</sup>", "", "i"),
    Rule(rf"\$[\s]*\^[\s]*\{{[\s]*{NOTE}[\s]*\}}[\s]*\$"),
    Rule(rf"\^\{{[\s]*{NOTE}[\s]*\}}"),
    Rule(r"\b(SSP\d+-\d+\.\d)[0-9]\b", "$1", "i"),
    Rule(r"\[[\s]*(?:注)?[0-9０-９]{1,3}[\s]*\]"),
)
IMAGES = (
    Rule(r"<image\b[^>]*>.*?</image[\s]*>", "\n![]\n", "is"),
    Rule(r"<img\b[^>]*>", "\n![]\n", "is"),
    Rule(r"!\[[^\]]*\]\([^)]+\)", "![]"),
    Rule(r"!\[[^\]]*\]\[[^\]]*\]", "![]"),
    Rule(r"^[\s]*(?:\[image\]|\[图片\]|\[圖像\]|\[figure\]|\[fig\]|<image[\s]*/?>|<pic[\s]*/?>|<picture[\s]*/?>)[\s]*$", "![]", "im"),
    Rule(r"^[\s]*!\[\][\s]*$", "![]", "im"),
)
MARKERS = Rule(r"(?:!\[\]){2,}", "![]")
#: Structured text, after images.
LINES_LEFT = (LINK, Rule(r"<br[\s]*/?>", "\n", "i"), Rule(r"<[^>]+>"))
LINES_TIDY = (EMPHASIS, Rule(" ", " "), Rule(r"[ \t\f\v]+", " "), Rule(r" *\n *", "\n"))
FOLDED = ("“”‘’「」『』：；，、（）〔〕【】—–−－", "\"\"''\"\"\"\":;,,()()[]----")
PUNCTUATION = (Rule(r"-{2,}", "-"), Rule(rf"(?<=[{WIDE}]),(?=[{WIDE}])"))
DETAILS = r"<details>\s*<summary>\s*(.*?)\s*</summary>(.*?)</details>"
VISUAL_KINDS = ("natural_image", "flowchart", "figure", "image", "picture", "diagram", "visual")
MERMAID = r"```+\s*mermaid\b|^\s*(?:graph|flowchart)\s+(?:td|lr|rl|bt)\b"
HEADING = r"^ {0,3}(#{1,6})[\s]+(.*?)[\s]*#*[\s]*$"
CROSS_PAGE = r"<!--\s*table\s+spans\s+PDF\s+pages\s+(\d+)\s*-\s*(\d+)\s*-->"
SPLITLINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CAPTION_STARTS = ("illustration of ", "an illustration of ", "image of ", "an image of ", "a photo of ", "the image shows ", "watercolor-style ")
CAPTION_MARKS = ("no text or symbols", "no text or symbols visible", "cartoon character", "rendered in warm yellow tones", "rendered in monochromatic yellow tones")
REPORT_TERMS = ("年度报告", "半年度报告", "中期报告", "季度报告")
ARTIFACT_TERMS = ("年度报告", "年报", "中期报告", "半年度报告", "季度报告", "年度報告", "年報", "中期報告", "中報", "annualreport", "interimreport")
COMPANY_TERMS = ("有限公司", "股份", "集團", "集团", "控股", "公司", "limited", "holdings", "group", "inc.", "corporation")
COMPANY_ENDINGS = ("有限公司", "股份有限公司", "控股有限公司", "limited", "holdingslimited", "corporation")
SENTENCE_MARKS = ("：", ":", "，", ",", "。", "；", ";", "、", "《", "》", "的", "被", "于", "致")
LOW_VALUE_HEADINGS = ("主席報告", "董事會", "企業管治報告", "環境、社會及管治報告", "收入", "成本及開支")
RUNNING_TERMS = ("年度报告", "半年度报告", "中期报告", "季度报告", "年度報告", "中期報告", "annualreport", "interimreport")
ANCHOR_STOPWORDS = ("截至", "年度", "本集团", "本公司", "人民币", "千元", "总计", "合计", "附注", "项目", "2023年", "2024年")
