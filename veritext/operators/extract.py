"""Tables, headings, lines and tokens of documents.

Documents have key columns (system_id, doc_id, role or whatever the caller uses)
and text. Tables need a parser and come from one Arrow UDF a document; lines and
headings are relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext import schemas
from veritext.functions import markup, rules, text
from veritext.functions.arrow import arrow_udf

extract_udf = arrow_udf(lambda t: None if t is None else markup.extract(t), schemas.EXTRACTED, once=True)


def with_tables(docs: DataFrame) -> DataFrame:
    """docs with tables (array) and body, the text without them. A null text has none."""
    return docs.withColumn("_x", extract_udf(F.coalesce("text", F.lit("")))).select("*", "_x.tables", "_x.body").drop("_x")


def tables(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """One row a table, with its shape."""
    rows = extracted.select(*keys, F.explode("tables").alias("t")).select(*keys, "t.*")
    return rows.withColumns({"rows": F.size("matrix"), "cols": columns_of(F.col("matrix"))})


def columns_of(matrix: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(matrix, lambda r: F.size(r))), F.lit(0))


def cells(tables_: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell: the matrix in relational form."""
    rows = tables_.select(*keys, "index", F.posexplode("matrix").alias("row", "r"))
    return rows.select(*keys, "index", "row", F.posexplode("r").alias("col", "text"))


def lines(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """One row a line, with its number, and where it begins and ends in code points, line end included."""
    # Lines go with their ends, so that no line carries its document's text.
    ends = F.concat(F.regexp_extract_all(F.col(column), F.lit(rules.SPLITLINES), F.lit(0)), F.array(F.lit("")))
    parts = F.arrays_zip(F.split(column, rules.SPLITLINES, -1).alias("text"), ends.alias("end"))
    rows = docs.select(*keys, F.posexplode(parts).alias("line_no", "_l")).select(*keys, "line_no", F.col("_l")["text"].alias("text"), F.length(F.col("_l")["end"]).alias("_e"))
    running = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("text") + F.col("_e")).over(running).cast("int"))
    rows = rows.withColumn("start", (F.col("end") - F.length("text") - F.col("_e")).cast("int"))
    # The end of the last line is no line of its own.
    return rows.where((F.col("text") != "") | (F.col("_e") > 0)).drop("_e")


def headings(docs: DataFrame, keys: list[str], column: str = "body") -> DataFrame:
    """One row a heading outside fences: index, level, text, rel_level (dense rank of its level in the document)."""
    rows = docs.select(*keys, F.posexplode(text.lines(F.col(column))).alias("line_no", "line"))
    order = Window.partitionBy(*keys).orderBy("line_no")
    fence = F.startswith(text.strip(F.col("line")), F.lit("```"))
    rows = rows.withColumns({"fence": fence, "open": F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1})
    pattern = rules.Rule(rules.HEADING).java
    rows = rows.where(~F.col("fence") & ~F.col("open") & F.rlike("line", F.lit(pattern)))
    rows = rows.select(*keys, (F.row_number().over(order) - 1).cast("int").alias("index"), F.length(F.regexp_extract("line", pattern, 1)).cast("int").alias("level"), text.strip(F.regexp_extract("line", pattern, 2)).alias("text"))
    return rows.withColumn("rel_level", F.dense_rank().over(Window.partitionBy(*keys).orderBy("level")).cast("int"))


def heading_list(body: Column) -> Column:
    """array<struct<level,text>> of a document in one expression, for where a document's row stays whole."""
    pattern = rules.Rule(rules.HEADING).java
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<level:int,text:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.startswith(text.strip(line), F.lit("```"))
        item = F.struct(F.length(F.regexp_extract(line, pattern, 1)).cast("int").alias("level"), text.strip(F.regexp_extract(line, pattern, 2)).alias("text"))
        hit = ~fence & ~acc["open"] & F.rlike(line, F.lit(pattern))
        return F.struct((acc["open"] != fence).alias("open"), F.when(hit, F.concat(acc["found"], F.array(item))).otherwise(acc["found"]).alias("found"))

    marked = F.filter(text.lines(body), lambda x: F.contains(x, F.lit("#")) | F.contains(x, F.lit("```")))
    return F.aggregate(marked, start, step, lambda acc: acc["found"])


def relative_levels(levels: Column) -> Column:
    """The rank of each level among the distinct levels."""
    # Bound as one element, or the distinct levels would be listed once for each level.
    known = F.array(F.array_sort(F.array_distinct(levels)))
    return F.transform(known, lambda k: F.transform(levels, lambda x: F.array_position(k, x).cast("int")))[0]


def anchor_text(matrix: Column) -> Column:
    """What identifies a table: header rows and row labels, without numbers, stopwords and marks. Entities go through an Arrow UDF."""
    from veritext.config import ANCHOR_CHARS, ANCHOR_ROWS

    head = F.flatten(F.slice(matrix, 1, ANCHOR_ROWS))
    labels = F.transform(F.filter(F.slice(matrix, ANCHOR_ROWS + 1, 2**30), lambda r: F.size(r) > 0), lambda r: r[0])
    plain = text.flat_udf(F.array_join(F.concat(head, labels), " "))
    plain = F.regexp_replace(plain, r"(?U)\d+(?:[.,:/%-]\d+)*", " ")
    for word in rules.ANCHOR_STOPWORDS:
        plain = F.replace(plain, F.lit(word), F.lit(" "))
    plain = F.regexp_replace(plain, rf"(?U)[^\w{rules.WIDE}]+", " ")
    return F.left(F.lower(text.strip(F.regexp_replace(plain, text.WHITE + "+", " "))), F.lit(ANCHOR_CHARS))


def anchor_words(anchor: Column) -> Column:
    """Distinct words and runs of wide characters, stopwords excluded."""
    found = F.regexp_extract_all(anchor, F.lit(f"[a-z][a-z0-9]{{2,}}|[{rules.WIDE}]{{2,}}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in rules.ANCHOR_STOPWORDS]))


def anchor_bigrams(anchor: Column) -> Column:
    """Distinct pairs of neighbouring wide characters, all others left out."""
    wide = F.regexp_replace(anchor, f"[^{rules.WIDE}]", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(wide) - 1, F.lit(1))), lambda i: F.substring(wide, i, F.lit(2)))
    return F.when(F.length(wide) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def overlaps(a: Column, b: Column, spans: Column) -> Column:
    """Whether [a, b) meets any of array<struct<start,end>>."""
    return F.exists(spans, lambda s: (a < s["end"]) & (b > s["start"]))
