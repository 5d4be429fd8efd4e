"""Adapters: each system's wrappers and noise go, content and order stay.

A step takes documents with text and stats (counts of what it changed) and returns
them. Steps are Spark expressions; only wrappers that nest go through an Arrow UDF.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.functions import kernels, rules, text
from veritext.functions.arrow import arrow_udf, settled
from veritext.functions.rules import Rule
from veritext.operators import extract
from veritext.sources import markdown

Step = Callable[[DataFrame], DataFrame]

# --- fixed values: patterns of the adapters ---
ADAPTER_DETAILS = r"<details\b[^>]*>\s*<summary\b[^>]*>(.*?)</summary>(.*?)</details>"
DIV = r"<div\b[^>]*>(.*?)</div>"
COORDINATE_IMAGE = Rule(r"<image\b[^>]*>.*?</image[\s]*>", "\n![]\n", "is")
MARKDOWN_IMAGE = Rule(r"!\[[^\]]*\]\([^\n)]*\)", "![]")
REFERENCE_IMAGE = Rule(r"!\[[^\]]*\]\[[^\]]*\]", "![]")
HTML_IMAGE = Rule(r"<img\b[^>]*?/?>", "\n![]\n", "is")
COMMENTS = Rule(r"<!--.*?-->", "", "s")
PAGEBREAK = Rule(r"^[ \t]*<pagebreak\b[^>]*/?>[ \t]*$", "", "im")
MERMAID_FENCE = Rule(r"```+[\s]*mermaid\b.*?```+", "\n![]\n", "is")
CAPTION_MARKS = ("no text or symbols", "cartoon character", "rendered in warm yellow tones", "rendered in monochromatic yellow tones")


def started(docs: DataFrame) -> DataFrame:
    """docs with normalized line ends and no counts yet."""
    return markdown.adapter_source(docs).withColumn("stats", F.create_map().cast("map<string,bigint>"))


def counted(docs: DataFrame, **counts: Column) -> DataFrame:
    """Adds to stats."""
    for name, n in counts.items():
        now = F.coalesce(F.try_element_at(F.col("stats"), F.lit(name)), F.lit(0)) + F.coalesce(n, F.lit(0)).cast("bigint")
        rest = F.filter(F.map_entries("stats"), _other(name))
        docs = docs.withColumn("stats", F.map_from_entries(F.concat(rest, F.array(F.struct(F.lit(name).alias("key"), now.alias("value"))))))
    return docs


def _other(name: str):
    return lambda e: e["key"] != name


def replaced(rule: Rule, name: str | None = None) -> Step:
    """Applies a rule and counts its matches."""

    def step(docs: DataFrame) -> DataFrame:
        n = F.regexp_count("text", F.lit(rule.java))
        docs = counted(docs, **{name: n}) if name else docs
        return docs.withColumn("text", rule.column(F.col("text")))

    return step


strip_comments = replaced(COMMENTS, "comments_removed")
remove_pagebreaks = replaced(PAGEBREAK, "pagebreaks_removed")
normalize_mermaid = replaced(MERMAID_FENCE, "mermaid_blocks_normalized")


def normalize_images(coordinates: bool = False) -> Step:
    """Image markup of all kinds becomes the marker."""
    steps = [replaced(COORDINATE_IMAGE, "coordinate_images_normalized")] * coordinates + [replaced(MARKDOWN_IMAGE, "markdown_images_normalized"), replaced(REFERENCE_IMAGE, "markdown_images_normalized"), replaced(HTML_IMAGE, "html_images_normalized")]
    return lambda docs: reduce(DataFrame.transform, steps, docs)


def unwrap_inline(*tags: str) -> Step:
    """Inline tags go, their text stays, trimmed."""
    steps = [replaced(Rule(rf"<{t}\b[^>]*>[\s]*(.*?)[\s]*</{t}>", "$1", "is"), f"{t}_wrappers_removed") for t in tags or ("sup", "sub")]
    return lambda docs: reduce(DataFrame.transform, steps, docs)


def _unwrapped_details(source: str) -> dict:
    counts = {"details_wrappers_removed": 0, "visual_details_to_image_marker": 0, "text_details_unwrapped": 0}

    def inner(m: re.Match) -> str:
        kind = re.sub(r"[\s-]+", "_", html.unescape(m[1]).strip().lower())
        body = m[2].strip()
        table = re.search(r"(?i)<table\b", body) or re.search(r"(?m)^\s*\|.*\|\s*$", body)
        shown = not table and (kind in rules.VISUAL_KINDS or rules.compiled(rules.MERMAID, "im").search(body))
        counts["details_wrappers_removed"] += 1
        counts["visual_details_to_image_marker" if shown else "text_details_unwrapped"] += 1
        return "\n![]\n" if shown else f"\n{body}\n"

    return {"text": kernels.to_fixpoint(rules.compiled(ADAPTER_DETAILS, "is"), inner, source), "counts": {k: n for k, n in counts.items() if n}}


def _unwrapped_divs(source: str) -> dict:
    n = 0

    def inner(m: re.Match) -> str:
        nonlocal n
        n += 1
        return f"\n{m[1].strip()}\n"

    done = kernels.to_fixpoint(rules.compiled(DIV, "is"), inner, source)
    return {"text": done, "counts": {"div_wrappers_removed": n} if n else {}}


def _nested(kernel) -> Step:
    def step(docs: DataFrame) -> DataFrame:
        docs = docs.withColumn("_u", arrow_udf(kernel, "struct<text:string,counts:map<string,bigint>>", once=True)("text"))
        merged = F.map_zip_with("stats", "_u.counts", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        return docs.withColumns({"text": F.col("_u.text"), "stats": merged}).drop("_u")

    return step


unwrap_details = _nested(_unwrapped_details)
unwrap_divs = _nested(_unwrapped_divs)


def remove_captions(docs: DataFrame) -> DataFrame:
    """Generated English captions of decorative images go."""
    every = text.lines(F.col("text"))
    docs = docs.withColumn("_l", every).withColumn("_k", F.filter("_l", lambda x: ~text.caption(x, CAPTION_MARKS)))
    return counted(docs, generated_image_captions_removed=F.size("_l") - F.size("_k")).withColumn("text", F.array_join("_k", "\n")).drop("_l", "_k")


def _noise(opened, table, number, key):
    """Which lines go, and how many of them are page numbers and headers. key: a line's key if it reads as a running header."""
    inside, seen, gone, again = 0, set(), [], 0
    for more, begins, numbered, name in zip(opened, table, number, key):
        repeats = False
        if name is not None and not numbered and not begins and inside <= 0:
            repeats = name in seen
            seen.add(name)
        again += repeats
        gone.append(bool(numbered or repeats))
        inside += more
    return {"gone": gone, "numbers": sum(map(bool, number)), "headers": again}


_noise_udf = arrow_udf(_noise, "struct<gone:array<boolean>,numbers:bigint,headers:bigint>", once=True)


def remove_page_noise(keys: list[str]) -> Step:
    """Page numbers go, and all but the first of a running header that repeats outside of tables: a document's lines are told by Spark, their order followed by a kernel, and its row stays whole."""

    def opened(line: Column) -> Column:
        low = F.lower(line)
        return F.when(F.contains(low, F.lit("table")), F.regexp_count(low, F.lit(r"<table\b")) - F.regexp_count(low, F.lit(r"</table\s*>"))).otherwise(0)

    def step(docs: DataFrame) -> DataFrame:
        docs = docs.withColumn("_l", settled(F.coalesce(text.lines(F.col("text")), F.array().cast("array<string>"))))
        told = {
            "_o": opened, "_t": lambda x: F.contains(F.lower(x), F.lit("<table")), "_n": lambda x: F.coalesce(text.adapter_page_number(x), F.lit(False)),
            "_h": lambda x: F.when(text.running_header(x), text.line_key(x))}
        docs = docs.withColumns({k: settled(F.transform("_l", f)) for k, f in told.items()})
        # A page number is never counted as a header's occurrence that goes: it goes before.
        docs = docs.withColumn("_u", _noise_udf(*told))
        docs = docs.withColumn("text", F.array_join(F.filter("_l", lambda x, i: ~F.get(F.col("_u.gone"), i)), "\n"))
        return counted(docs, standalone_page_numbers_removed=F.col("_u.numbers"), duplicate_running_headers_removed=F.col("_u.headers")).drop("_l", "_u", *told)

    return step


FINAL = (
    Rule(r"(?:^|\n)[ \t]*!\[\][ \t]*(?:\n[ \t]*)+(?=!\[\][ \t]*(?:\n|\Z))", "\n"), Rule(r"(?:!\[\][\s]*){2,}", "![]\n\n"), Rule(r"\n{3,}", "\n\n"))


def finalized(c: Column) -> Column:
    """Lines without trailing blanks, markers merged, at most one blank line in a row, one line feed at the end."""
    bare = F.array_join(F.transform(text.lines(F.regexp_replace(text.newlines(c), "^﻿+", "")), lambda x: F.regexp_replace(x, r"[ \t]+\z", "")), "\n")
    return F.concat(text.strip(rules.columns(FINAL, bare)), F.lit("\n"))


# --- registry --------------------------------------------------------------------

def pipelines(keys: list[str]) -> dict[str, list[Step]]:
    """The steps of each kind of source, in order."""
    noise, tidy = remove_page_noise(keys), [unwrap_inline(), strip_comments]
    return {
        "details": [unwrap_details, normalize_mermaid, normalize_images(), remove_captions, *tidy, noise],
        "plain": [normalize_images(), *tidy, noise],
        "coordinates": [remove_pagebreaks, normalize_images(True), *tidy, noise],
        "divs": [unwrap_divs, normalize_images(), *tidy, noise],
        "template": [normalize_images(), strip_comments],
    }


def adapt(docs: DataFrame, kind: str, keys: list[str], more: dict[str, list[Step]] | None = None) -> DataFrame:
    """docs with text adapted and finalized, and stats. more: kinds of the caller's own."""
    steps = (pipelines(keys) | (more or {}))[kind]
    return reduce(DataFrame.transform, steps, started(docs)).withColumn("text", finalized(F.col("text"))).withColumn("stats", F.map_filter("stats", lambda _, n: n > 0))


# --- validation ------------------------------------------------------------------

def _marked(c: Column) -> Column:
    for r in (COORDINATE_IMAGE, MARKDOWN_IMAGE, REFERENCE_IMAGE, HTML_IMAGE):
        c = r._replace(replacement="![]").column(c)
    return c


def _heading_key(h: Column) -> Column:
    bare = F.regexp_replace(_marked(h["text"]), r"(?i)</?(?:sup|sub)\b[^>]*>", "")
    return F.struct(h["level"].alias("level"), text.strip(F.regexp_replace(bare, text.WHITE + "+", " ")).alias("text"))


def validate(before: DataFrame, after: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document: whether an adapter kept tables and headings, and changes nothing on a second pass (again: adapt of after).

    Headings may go only if they read as running headers; none may come or change.
    error names the first rule broken, or is null.
    """
    side = lambda df, n: extract.with_tables(df.select(*keys, F.col("text").alias("_t")).withColumn("text", _marked(F.col("_t")))).select(*keys, F.col("_t").alias(f"{n}_text"), F.col("tables.matrix").alias(f"{n}_m"), F.transform(extract.heading_list(F.col("_t")), _heading_key).alias(f"{n}_h"))
    cells = lambda c: F.transform(c, lambda m: F.transform(m, lambda r: F.transform(r, lambda x: text.strip(F.regexp_replace(x, rf"{text.WHITE}*!\[\]{text.WHITE[4:]}*", "![]")))))
    rows = side(before, "a").join(side(after, "b"), keys).join(again.select(*keys, F.col("text").alias("c_text")), keys)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gone"), F.lit(False).alias("bad"))

    def follow(acc: Column, h: Column) -> Column:
        same = (acc["at"] < F.size("b_h")) & F.coalesce(F.try_element_at(F.col("b_h"), acc["at"] + 1) == h, F.lit(False))
        noise = text.running_header(F.concat(F.lit("# "), h["text"]))
        return F.struct((acc["at"] + same.cast("int")).alias("at"), (acc["gone"] + (~same & noise).cast("int")).alias("gone"), (acc["bad"] | (~same & ~noise)).alias("bad"))

    rows = rows.withColumn("_f", F.aggregate("a_h", start, follow))
    sizes = F.size("a_m") == F.size("b_m")
    matrices = sizes & (cells(F.col("a_m")) == cells(F.col("b_m")))
    order = ~F.col("_f.bad") & (F.col("_f.at") == F.size("b_h"))
    still = F.col("b_text") == F.col("c_text")
    error = F.when(~sizes, "table count changed").when(~matrices, "table matrix changed").when(F.col("_f.bad"), "heading changed or removed").when(~order, "heading added or altered").when(~still, "adapter is not idempotent")
    return rows.select(*keys, F.size("b_m").alias("table_count"), F.size("b_h").alias("heading_count"), F.col("_f.gone").alias("artifact_headings_removed"), matrices.alias("table_matrices_preserved"), order.alias("heading_sequence_preserved"), still.alias("idempotent"), error.alias("error"))


def manifest(before: DataFrame, after: DataFrame, checks: DataFrame, system: str, adapter: str, told: list[str], id_col: str = "doc_id") -> DataFrame:
    """One manifest row: what changed, with hashes of the texts, and the totals over documents."""
    from veritext import schemas

    files = before.select(id_col, F.sha2("text", 256).alias("source_sha256")).join(after.select(id_col, F.sha2("text", 256).alias("output_sha256"), F.col("stats").alias("changes")), id_col).join(checks, id_col)
    valid = F.struct("table_count", "heading_count", "artifact_headings_removed", "table_matrices_preserved", "heading_sequence_preserved", "idempotent")
    name = F.concat(F.col(id_col), F.lit(".md"))
    row = F.struct(F.col(id_col).alias("id"), name.alias("source"), name.alias("output"), "source_sha256", "output_sha256", "changes", valid.alias("validation"))
    totals = files.select(F.explode("changes").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("totals"))
    constraints = F.struct(*[F.lit(False).alias(c) for c in schemas.CONSTRAINTS])
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    listed = files.agg(F.array_sort(F.collect_list(row), by_id).alias("files"))
    return listed.crossJoin(totals).select(F.lit(system).alias("system"), F.lit(adapter).alias("adapter"), constraints.alias("constraints"), F.array(*[F.lit(t) for t in told]).cast("array<string>").alias("rules"), "totals", "files")
