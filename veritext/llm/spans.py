"""Spans of regular expressions in texts, with Spark's own functions.

split() and regexp_extract_all() find the same leftmost non-overlapping matches;
the lengths of the parts between them and of the matches give the places, in code
points. Arrays are folded and compared in blocks of BLOCK, so that a text with very
many matches costs little more than its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,m:string>"
#: Elements of a block.
BLOCK = 128


def find(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """array<SPAN>: the matches of pattern that are valid, from left to right. The pattern must not match the empty string."""
    between = F.split(text, pattern, -1)
    matches = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    pairs = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))

    def spans_of(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none().alias("found"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["b"]
            end = first + F.length(x["m"])
            good = F.length(x["m"]) > 0
            if valid is not None:
                good = good & valid(x["m"])
            span = F.struct(F.lit(kind).alias("kind"), first.alias("start"), end.alias("end"), x["m"].alias("m"))
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

        return F.aggregate(part, start, step, lambda acc: acc["found"])

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["b"] + F.length(x["m"])))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), spans_of))

    return let(in_blocks(pairs), placed)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def in_blocks(items: Column) -> Column:
    """The array cut into arrays of BLOCK elements; one empty one for an empty array."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(x, i, BLOCK)))


def bounded(spans: Column) -> Column:
    """Blocks of the spans in order of their starts, each with its least start and greatest end: what overlapping() looks through."""
    return F.transform(in_blocks(F.array_sort(spans)), lambda part: F.struct(part.alias("spans"), F.get(part, F.lit(0))["start"].alias("low"), F.array_max(F.transform(part, lambda s: s["end"])).alias("high")))


def overlapping(blocks: Column, c: Column, also: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
    """Whether a span of bounded() overlaps c, and `also` holds for it."""
    return F.exists(blocks, lambda b: F.coalesce((b["low"] < c["end"]) & (c["start"] < b["high"]), F.lit(False)) & F.exists(b["spans"], lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]) & also(s)))


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = digits(m)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0),
        lambda a, i: a + _doubled(F.coalesce(F.try_to_number(F.substring(d, F.length(d) - i + 1, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)), i))
    return total % 10 == 0


def _doubled(x: Column, i: Column) -> Column:
    twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.when(i % 2 == 0, twice).otherwise(x)


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def around(text: Column, at: Column, size: int) -> tuple[Column, Column]:
    """Up to `size` code points before at["start"] and after at["end"]."""
    low = F.greatest(at["start"] - size, F.lit(0))
    return F.substring(text, low + 1, at["start"] - low), F.substring(text, at["end"] + 1, F.lit(size))
