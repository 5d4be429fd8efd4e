"""Text normal forms as Spark columns; what needs Python goes through Arrow UDFs over the kernels."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.config import DIGITS, ScoringConfig
from veritext.functions import kernels, rules
from veritext.functions.arrow import arrow_udf, settled
from veritext.functions.rules import Rule

# --- Arrow UDFs ----------------------------------------------------------------



def _udf(kernel, *args):
    return arrow_udf(lambda t: None if t is None else kernel(t, *args), "string")


unescape_udf, flat_udf, nfkc_udf = _udf(html.unescape), _udf(kernels.flat), _udf(kernels.nfkc)


def structured_udf(config: ScoringConfig):
    return _udf(kernels.structured, config)


def semantic_udf(config: ScoringConfig):
    return _udf(kernels.semantic, config)


# --- columns -------------------------------------------------------------------

WHITE = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(c, F.lit(Rule(pattern, "", flags).java))


def newlines(c: Column) -> Column:
    return rules.columns(rules.NEWLINES, c)


def flat_column(c: Column) -> Column:
    """flat() of a text without entities."""
    return rules.columns(rules.FLAT, c)


def footnotes_column(c: Column) -> Column:
    return rules.columns(rules.FOOTNOTES, c)


def punctuation_column(c: Column) -> Column:
    return rules.columns(rules.PUNCTUATION, F.translate(c, *rules.FOLDED))


def lines(c: Column) -> Column:
    """All lines as str.splitlines() has them: no last empty one."""
    parts = F.split(c, rules.SPLITLINES, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def compact(c: Column) -> Column:
    """A line without horizontal white space."""
    return F.regexp_replace(strip(c), r"[ \t\f\x0b]+", "")


def line_content(c: Column) -> Column:
    """compact(), without list and quote marks in front and one pair of brackets around."""
    bare = F.regexp_replace(compact(c), "^[>●•·*+\\-]+", "")
    return F.regexp_replace(bare, r"(?d)^[\[{](.*?)[\]}]$", "$1")


def heading_text(c: Column) -> Column:
    """A line without heading markers, white space at both ends removed."""
    inner = F.regexp_extract(c, Rule(rules.HEADING).java, 2)
    return F.when(matches(c, rules.HEADING), strip(inner)).otherwise(c)


def without_heading_marks(c: Column) -> Column:
    """A document whose heading lines keep only their text, fenced blocks included."""
    return F.array_join(F.transform(lines(c), heading_text), "\n")


def cleanup_key(c: Column) -> Column:
    """The key under which repeated lines count: no heading markers, no horizontal white space, compatibility characters folded."""
    return compact(nfkc_udf(strip(heading_text(strip(c)))))


def toc_leader(c: Column) -> Column:
    """A table-of-contents line: leaders, then a page number."""
    dots = r"(?:\.|…|⋯|·|_|-){3,}"
    return matches(c, dots + r"[\s]*\d{1,4}[\s]*\Z") | matches(compact(c), dots + r"\d{1,4}\Z")


def page_number(c: Column) -> Column:
    """A line that is only a page number."""
    small = compact(c)
    return (
        matches(small, r"\A-?\d{1,4}-?\z") | matches(small, r"\A(?:page)?\d{1,4}(?:of|/)\d{1,4}\z", "i")
        | matches(small, r"\A第\d{1,4}页(?:/共?\d{1,4}页?)?\z") | matches(strip(c), r"\Apage[\s]+\d{1,4}(?:[\s]+of[\s]+\d{1,4})?\z", "i"))


def any_of(test, values: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | test(F.lit(v))
    return found


def caption(c: Column, marks: tuple[str, ...] = rules.CAPTION_MARKS) -> Column:
    """A generated English caption of a decorative image."""
    body = strip(c)
    low = F.lower(body)
    return (F.length(body) <= 260) & ~matches(body, f"[{rules.WIDE}]") & any_of(lambda v: F.startswith(low, v), rules.CAPTION_STARTS) & any_of(lambda v: F.contains(low, v), marks)


def report_header(c: Column) -> Column:
    """A short line that names a report."""
    small = compact(c)
    return (F.length(small) <= 80) & (F.contains(F.lower(small), F.lit("report")) | any_of(lambda v: F.contains(small, v), rules.REPORT_TERMS))


def pipe_row(c: Column) -> Column:
    body = strip(c)
    return F.contains(body, F.lit("|")) & ~F.startswith(body, F.lit("```"))


def pipe_cells(c: Column) -> Column:
    """Cells of a pipe row, unescaped but not yet flat."""
    body = F.regexp_replace(F.regexp_replace(strip(c), r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(body, r"(?<!\\)\|", -1), lambda x: F.replace(x, F.lit("\\|"), F.lit("|")))


def pipe_separator(c: Column) -> Column:
    return pipe_row(c) & F.forall(pipe_cells(c), lambda x: F.rlike(F.replace(flat_column(x), F.lit(" "), F.lit("")), F.lit(r"\A:?-{3,}:?\z")))


def page_artifact(c: Column) -> Column:
    """A line of a prediction that repeats a page's header or footer: for repeated-line cleanup."""
    body = strip(c)
    content = strip(heading_text(body))
    small = compact(nfkc_udf(content))
    low = F.lower(small)
    company = any_of(lambda v: F.contains(low, v), rules.COMPANY_TERMS) & (F.length(small) <= 55) & ~any_of(lambda v: F.contains(small, v), rules.SENTENCE_MARKS) & any_of(lambda v: F.endswith(low, v), rules.COMPANY_ENDINGS)
    heading = F.startswith(body, F.lit("#")) & (F.length(small) <= 35) & small.isin(*rules.LOW_VALUE_HEADINGS)
    table = any_of(lambda v: F.contains(F.lower(body), v), ("<table", "</table")) | pipe_row(body)
    listed = page_number(content) | toc_leader(content) | report_header(content) | any_of(lambda v: F.contains(low, v), rules.ARTIFACT_TERMS)
    return (body != "") & ~table & (small != "") & (F.length(small) <= 90) & (listed | company | heading)


def line_key(c: Column) -> Column:
    """The adapter's key of a line: no heading marks or white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\A[\s\x1c-\x1f]*#{1,6}[\s\x1c-\x1f]+", ""), WHITE + "+", ""))


def adapter_page_number(c: Column) -> Column:
    small = F.lower(F.regexp_replace(c, WHITE + "+", ""))
    return matches(small, r"\A-?\d{1,4}-?\z") | matches(small, r"\A(?:page)?\d{1,4}(?:of|/)\d{1,4}\z") | matches(small, r"\A第\d{1,4}页(?:/共?\d{1,4}页?)?\z")


def running_header(c: Column) -> Column:
    """A short line that names a report or a company, as headers on every page do."""
    key = line_key(c)
    return (key != "") & (F.length(key) <= 90) & (any_of(lambda v: F.contains(key, v), rules.RUNNING_TERMS) | any_of(lambda v: F.endswith(key, v), rules.COMPANY_ENDINGS))


def slug(c: Column, default: str = "system") -> Column:
    """A name for files: other characters as underscores."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w.-]+", "_"), r"\A[_.-]+|[_.-]+\z", ""), F.lit("")), F.lit(default))


def relative_path(c: Column, root: str) -> Column:
    """A POSIX path below root; others stay."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"\Afile:/+", "/")
    return F.when(F.startswith(plain, F.lit(root.rstrip("/") + "/")), F.substring(plain, len(root.rstrip("/")) + 2, F.length(plain))).otherwise(plain)


def preview(normal: Column, limit: int) -> Column:
    """A body as one line of at most limit characters."""
    one = F.replace(normal, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.left(one, F.lit(limit - 3)), F.lit("...")))


def clamp(c: Column, high: float = 100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), c))


def rounded(c: Column, digits: int = DIGITS) -> Column:
    """A double at so many decimals, as the protocol rounds: by its exact binary value, ties to even. Spark's own round() goes by the shortest decimal form."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits)).cast("double")


def labelled(rows: DataFrame, key: str, labels: DataFrame, default: str | None) -> DataFrame:
    """rows with `label`, that of labels(key, label) for their key, or the default."""
    return rows.join(labels.select(F.col("key").alias(key), "label"), key, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def body_lines(normal: Column, repeated: Column | None = None) -> Column:
    """The body's normal form from semantic text: noise lines go, others are compacted, runs of blank lines merge.

    repeated: compact lines that go as well.
    """
    kept = F.filter(F.split(normal, "\n", -1), lambda x: ~(toc_leader(x) | page_number(x) | caption(x)))
    if repeated is not None:
        kept = F.filter(kept, lambda x: ~F.array_contains(repeated, compact(x)) | (compact(x) == ""))
    content = F.transform(kept, line_content)
    once = F.filter(F.zip_with(content, F.concat(F.array(F.lit("x")), content), lambda x, before: F.when((x == "") & (before == ""), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return F.regexp_replace(F.array_join(once, "\n"), r"\A\n+|\n+\z", "")


def repeated_headers(normal: Column) -> Column:
    """Compact lines that occur three times or more and name a report."""
    small = F.filter(F.transform(F.split(normal, "\n", -1), compact), lambda x: x != "")
    return F.filter(F.array_distinct(small), lambda x: report_header(x) & (F.size(F.filter(small, lambda y: y == x)) >= 3))


def body(c: Column, config: ScoringConfig) -> Column:
    """The body's normal form of a document without tables."""
    return body_lines(semantic_udf(config)(c))


def with_body(docs: DataFrame, column: str, name: str, config: ScoringConfig, remove_repeated: bool = False) -> DataFrame:
    """docs with the body's normal form; remove_repeated: without lines that name a report and occur three times or more."""
    docs = docs.withColumn("_normal", settled(semantic_udf(config)(F.col(column))))
    known = repeated_headers(F.col("_normal")) if remove_repeated else None
    return docs.withColumn(name, body_lines(F.col("_normal"), known)).drop("_normal")
