"""Queries over the driver's tables, with their DuckDB oracles.

The tables hold no Markdown, so some queries render rows to Markdown or HTML and
parse them back; the oracle computes the answer from the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.config import ScoringConfig
from veritext.functions import rules, text
from veritext.operators import adapters, body, canonical, cleanup, distance, extract, headings, tables
from veritext.plans import registry, rendered, score
from veritext.plans.registry import lined, query, read, text_of
from veritext.sources import markdown

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


# --- lines and scalar text -----------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents WHERE text <> '')
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS n_blank, max(length(line)) AS longest, count(DISTINCT line) AS n_distinct FROM l GROUP BY doc_id""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts of each document."""
    lines = extract.lines(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("text") == "").alias("n_blank"), F.max(F.length("text")).cast("bigint").alias("longest"), F.count_distinct("text").alias("n_distinct"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), o AS (SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
SELECT doc_id, line_no, CAST(start AS BIGINT) AS start, length(line) AS size FROM o WHERE line <> '' OR line_no < n - 1""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line begins."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = extract.lines(docs, ["doc_id"])
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("start").cast("bigint").alias("start"), F.length("text").cast("bigint").alias("size"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), c AS (SELECT doc_id, line, regexp_replace(trim(line), '[ \t]+', '', 'g') AS small FROM l)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (regexp_full_match(small, '-?[0-9]{1,4}-?') OR regexp_full_match(lower(small), '(page)?[0-9]{1,4}(of|/)[0-9]{1,4}') OR regexp_full_match(lower(trim(line)), 'page[ ]+[0-9]{1,4}([ ]+of[ ]+[0-9]{1,4})?')) AS page_numbers,
  count(*) FILTER (regexp_matches(small, '([.…⋯·_]|-){3,}[0-9]{1,4}$')) AS leaders
FROM c GROUP BY doc_id""")
def line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers and leader lines."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.page_number(F.col("line"))).alias("page_numbers"), F.count_if(text.toc_leader(F.col("line"))).alias("leaders"))


@query(r"""
SELECT page_id, sha256(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '(?i)<br[\s]*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[*_`~]+', '', 'g'), '[\s]+', ' ', 'g')), '^ | $', '', 'g')) AS text_sha256 FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as flat text, entities left as they are."""
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(text.flat_column(F.coalesce("html", F.lit(""))), 256).alias("text_sha256"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comments_removed, sha256(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS text_sha256 FROM pages""")
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments removed and counted."""
    docs = adapters.strip_comments(adapters.started(read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))))
    return docs.select("page_id", F.coalesce(F.try_element_at("stats", F.lit("comments_removed")), F.lit(0)).alias("comments_removed"), F.sha2("text", 256).alias("text_sha256"))


@query(r"""
SELECT p_partkey, '![]' || chr(10) || 'a ' || chr(10) || '![]' || chr(10) || ' b ![]' AS text, 3 AS images FROM part""")
def image_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image markup of three kinds as markers."""
    name = F.col("p_name")
    made = F.concat(F.lit("!["), name, F.lit("](p/"), name, F.lit(".png)\na <img src=\""), name, F.lit("\"/> b !["), name, F.lit("][1]"))
    docs = adapters.normalize_images()(adapters.started(read(spark, sf_dir, "part").select("p_partkey", made.alias("text"))))
    return docs.select("p_partkey", "text", (F.col("stats")["markdown_images_normalized"] + F.col("stats")["html_images_normalized"]).cast("int").alias("images"))


@query("SELECT c_custkey, c_name || ' and ' || c_mktsegment AS text FROM customer")
def footnote_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnote marks of five kinds removed."""
    made = F.concat("c_name", F.lit("<sup>(1)</sup>$^{2}$ and [3]^{a}"), "c_mktsegment", F.lit("[注12]"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.footnotes_column(made).alias("text"))


@query("SELECT s_suppkey, '\"' || s_name || '\", (' || s_nationkey || '): a-b' AS text FROM supplier")
def punctuation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation variants folded."""
    made = F.concat(F.lit("“"), "s_name", F.lit("」，（"), F.col("s_nationkey").cast("string"), F.lit("）：a——b"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.replace(F.replace(text.punctuation_column(made), F.lit(","), F.lit(", ")), F.lit("):"), F.lit("): ")).alias("text"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS compact, p_name AS content FROM part")
def line_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without horizontal white space, list marks and one pair of brackets."""
    line = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")))
    listed = F.concat(F.lit("> • ["), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("]"))
    return read(spark, sf_dir, "part").select("p_partkey", text.compact(line).alias("compact"), F.replace(text.line_content(listed), F.lit("_"), F.lit(" ")).alias("content"))


@query("SELECT n_nationkey, '## ' || n_name AS line, n_name AS heading, replace(lower(n_name), ' ', '') AS key FROM nation")
def heading_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading markers stripped, and the key of a line."""
    line = F.concat(F.lit("## "), "n_name")
    return read(spark, sf_dir, "nation").select("n_nationkey", line.alias("line"), text.heading_text(F.concat(line, F.lit(" ##"))).alias("heading"), text.line_key(line).alias("key"))


@query(r"""
SELECT s_suppkey, regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') AS slug, 'out/' || s_name || '.md' AS path,
  CASE WHEN length(s_name || s_name || s_name) <= 40 THEN s_name || s_name || s_name ELSE left(s_name || s_name || s_name, 37) || '...' END AS preview,
  greatest(0, least(100, s_acctbal / 50)) AS clamped FROM supplier""")
def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, relative paths, previews, clamping."""
    long = F.concat("s_name", "s_name", "s_name")
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", text.slug(F.col("s_name")).alias("slug"), text.relative_path(F.concat(F.lit("file:///data/root/out/"), "s_name", F.lit(".md")), "/data/root").alias("path"),
        text.preview(long, 40).alias("preview"), text.clamp(F.col("s_acctbal") / 50).alias("clamped"))


@query("SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n FROM documents")
def sha_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts."""
    docs = markdown.from_rows(read(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n"))


# --- headings --------------------------------------------------------------------


@query("""
WITH h AS (
  SELECT r_regionkey AS doc, 1 AS level, r_name AS text, -1 AS a, -1 AS b FROM region
  UNION ALL SELECT n_regionkey, 3, n_name, n_nationkey, -1 FROM nation
  UNION ALL SELECT n_regionkey, 6, c_name, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY a, b) - 1 AS INT) AS index, CAST(level AS INT) AS level, text, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY level) AS INT) AS rel_level FROM h""")
def heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a rendered outline, fenced lines ignored."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    none = F.lit(-1).cast("bigint")
    rows = region.select(F.col("r_regionkey").alias("doc"), none.alias("a"), none.alias("b"), F.concat(F.lit("# "), "r_name", F.lit("\n```\n# fenced\n```")).alias("line"))
    rows = rows.unionByName(nation.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").cast("bigint").alias("a"), none.alias("b"), F.concat(F.lit("### "), "n_name", F.lit(" ###\nplain")).alias("line")))
    rows = rows.unionByName(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").cast("bigint").alias("a"), F.col("c_custkey").cast("bigint").alias("b"), F.concat(F.lit("   ###### "), "c_name").alias("line")))
    docs = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return extract.headings(docs, ["doc"])


@query("""
SELECT c_nationkey, list_transform(list(CAST(c_custkey % 5 AS INT) ORDER BY c_custkey), lambda x: CAST(list_position(list_sort(list_distinct(list(CAST(c_custkey % 5 AS INT)))), x) AS INT)) AS levels FROM customer GROUP BY c_nationkey""")
def relative_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels as ranks among a document's distinct levels."""
    level = (F.col("c_custkey") % 5).cast("int")
    docs = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", level.alias("l")))), lambda x: x["l"]).alias("l"))
    return docs.select("c_nationkey", extract.relative_levels(F.col("l")).alias("levels"))


@query()
def heading_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout score of each benchmark item's sentences against the next item's."""
    parts = F.transform(F.split("text", r"(?<=[.])\s+"), lambda s: F.struct((F.length(s) % 3 + 1).cast("int").alias("level"), s.alias("text")))
    items = read(spark, sf_dir, "benchmark").select("item_id", parts.alias("gt"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("gt").alias("pred"))
    scored = headings.score(items.join(after, "item_id"), "gt", "pred")
    return scored.select("item_id", "title.title_layout_score", "title.heading_f1_score", "title.alignment_cost", "title.missing_heading_count", "title.extra_heading_count")


@query("""
WITH RECURSIVE l AS (SELECT c_nationkey AS n, list(CAST(length(c_name) + c_custkey % 3 AS DOUBLE) ORDER BY c_custkey) AS x FROM customer GROUP BY c_nationkey
), d AS (SELECT a.n AS c_nationkey, a.x AS g, b.x AS p FROM l a JOIN l b ON b.n = a.n + 1
), reach AS (
  SELECT c_nationkey, g, p, 0 AS i, list_transform(range(0, len(p) + 1), lambda j: CAST(j AS DOUBLE)) AS cells FROM d
), r AS (
  SELECT * FROM reach
  UNION ALL
  SELECT c_nationkey, g, p, i + 1, list_transform(range(1, len(p) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN i + 1.0 ELSE least(cells[k - 1] + abs(g[i + 1] - p[k - 1]), cells[k] + 1) END + (j - k))))
  FROM r WHERE i < len(g))
SELECT c_nationkey, cells[len(cells)] AS cost FROM r WHERE i = len(g)""")
def level_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of aligning neighbouring nations' customers by levels alone."""
    level = (F.length("c_name") + F.col("c_custkey") % 3).cast("int")
    docs = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", level.alias("l")))), lambda x: x["l"]).alias("gt"))
    after = docs.select((F.col("c_nationkey") - 1).alias("c_nationkey"), F.col("gt").alias("pred"))
    # The work grows with the product of two lists' lengths, and there are few of them: one to a task.
    return docs.join(after, "c_nationkey").repartition(64).select("c_nationkey", headings.level_cost_udf("gt", "pred").alias("cost"))


# --- tables ----------------------------------------------------------------------


@query("""
WITH t AS (
  SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS row, replace(n_name, '_', '') AS n_name, CAST(n_nationkey AS VARCHAR) AS k FROM nation)
SELECT n_regionkey, row, 0 AS col, n_name AS text FROM t UNION ALL SELECT n_regionkey, row, 1, k || '|x' FROM t
UNION ALL SELECT DISTINCT n_regionkey, 0, 0, 'name' FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, 1, 'key' FROM nation""")
def pipe_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of rendered pipe tables."""
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit("\\|x |"))
    docs = lined(read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], line)
    docs = docs.select("n_regionkey", F.concat(F.lit("before\n\n| name | key |\n|---|:---:|\n"), "lines", F.lit("\n\nafter")).alias("text"))
    found = extract.tables(extract.with_tables(docs), ["n_regionkey"])
    return extract.cells(found, ["n_regionkey"]).select("n_regionkey", "row", "col", "text")


@query("""
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_returnflag) - 1 AS INT) AS row, CAST(o_orderkey AS VARCHAR) AS order_text, CAST(l_linenumber AS VARCHAR) AS line_text, l_returnflag AS flag_text, l_returnflag AS again_text
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def html_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered HTML tables with row and column spans, parsed back."""
    items = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    by = Window.partitionBy("o_orderkey")
    items = items.withColumns({"_n": F.count(F.lit(1)).over(by), "_k": F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_returnflag"))})
    key = F.when(F.col("_k") == 1, F.concat(F.lit("<td rowspan=\""), F.col("_n").cast("string"), F.lit("\">"), F.col("o_orderkey").cast("string"), F.lit("</td>"))).otherwise("")
    line = F.concat(F.lit("<tr>"), key, F.lit("<td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td colspan=2><b>"), "l_returnflag", F.lit("</b></td></tr>"))
    docs = lined(items, ["o_custkey"], ["o_orderkey", "_k"], line, "").select("o_custkey", F.concat(F.lit("<table>"), "lines", F.lit("</table>")).alias("text"))
    found = extract.tables(extract.with_tables(docs), ["o_custkey"]).select("o_custkey", F.posexplode("matrix").alias("row", "r"))
    return found.select("o_custkey", "row", *[F.col("r")[k].alias(f"{n}_text") for k, n in enumerate(("order", "line", "flag", "again"))])


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(DISTINCT l_linestatus) + 1 AS ca, count(DISTINCT l_returnflag) + 1 AS cb FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(greatest(0, least(100, (1.0::DOUBLE - abs(a - b)::DOUBLE / greatest(a, b, 1) + 1.0::DOUBLE - abs(ca - cb)::DOUBLE / greatest(ca, cb, 1) + 1.0::DOUBLE - abs(a * ca - b * cb)::DOUBLE / greatest(a * ca, b * cb, 1)) / 3.0::DOUBLE * 100.0::DOUBLE)), 9) AS structure_score FROM s""")
def table_shape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure scores of shapes (A1, A2)."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"), (F.count_distinct("l_linestatus") + 1).alias("ca"), (F.count_distinct("l_returnflag") + 1).alias("cb"))
    return s.select("l_orderkey", F.round(tables.structure_score(F.col("a"), F.col("ca"), F.col("b"), F.col("cb")), 9).alias("structure_score"))


@query("""
WITH a AS (SELECT o_custkey AS n, max(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT s_suppkey AS n, s_acctbal * 50 AS y FROM supplier)
SELECT coalesce(a.n, b.n) AS pred_index, CASE WHEN y IS NOT NULL AND (x IS NULL OR y > x) THEN y ELSE x END AS table_pair_score, CASE WHEN y IS NOT NULL AND (x IS NULL OR y > x) THEN 'alt' ELSE 'primary' END AS selected_gt_variant, x AS primary_pair_score, y AS alt_pair_score
FROM a FULL JOIN b ON a.n = b.n""")
def best_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two references' matches, where either may lack one."""
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pred_index")).agg(F.max("o_totalprice").alias("table_pair_score")).withColumn("doc", F.lit(1))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pred_index"), (F.col("s_acctbal") * 50).alias("table_pair_score"), F.lit(1).alias("doc"))
    return tables.better_of(a, b, ["doc"]).drop("doc")


@query("""
SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 2 END AS start_page, CASE WHEN n_regionkey > 2 THEN CAST(n_regionkey AS INT) END AS end_page FROM nation""")
def cross_page_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a marker right before a table."""
    made = F.concat(F.lit("<!-- table spans PDF pages 9-10 --> text\n<!-- Table spans  PDF pages 2 - "), F.col("n_regionkey").cast("string"), F.lit(" -->\n\n<table><tr><td>"), "n_name", F.lit("</td></tr></table>"))
    found = extract.tables(extract.with_tables(read(spark, sf_dir, "nation").select("n_nationkey", made.alias("text"))), ["n_nationkey"])
    return found.select("n_nationkey", F.col("span_pages.start").alias("start_page"), F.col("span_pages.end").alias("end_page"))


# --- distances -------------------------------------------------------------------


@query("""
WITH n AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS distance FROM n WHERE b IS NOT NULL""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized distances of neighbouring names."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b IS NOT NULL")
    return part.select("p_partkey", distance.normalized(F.col("a"), F.col("b"), 4_000_000).alias("distance"))


#: Letters beyond ASCII of the texts as signs that these lack: the oracle's distance counts bytes.
_LETTERS, _SIGNS = "éèêçàùâîôûëïüöäßñóíáúÉÈÊÇÀÙÜÖÄÑÓÍÁÚ", "!#$%&()*+-/0123456789:;<=>?@[]^_`{|}~"


@query(f"""
WITH t AS (SELECT item_id, translate(text, '{_LETTERS}', '{_SIGNS[: len(_LETTERS)]}') AS text FROM benchmark)
SELECT a.item_id, CAST(levenshtein(a.text, b.text) AS INT) AS segmented, CAST(levenshtein(a.text, b.text) AS INT) AS exact FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def segmented_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented distances of neighbouring benchmark items, which share no line: the exact ones."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", distance.segmented_udf("a", "b", F.lit(True)).alias("segmented"), F.levenshtein("a", "b").alias("exact"))


@query(f"""
WITH t AS (SELECT conv_id, turn, translate(regexp_replace(regexp_replace(text, '[ \\t]+', '', 'g'), '^\\n+|\\n+$', '', 'g'), '{_LETTERS}', '{_SIGNS[: len(_LETTERS)]}') AS a, lead(text) OVER w IS NOT NULL AS has FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), p AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, CASE WHEN a = '' AND b = '' THEN 100.0::DOUBLE ELSE CAST(printf('%.4f', (1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) * 100) AS DOUBLE) END AS text_score, CAST(a <> '' AND b <> '' AS INT) AS matched_block_count FROM p WHERE has""")
def body_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body scores of conversations' turns against the next turn."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    turns = turns.withColumn("pred", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("pred IS NOT NULL")
    return body.score(turns, "text", "pred", ScoringConfig()).select("conv_id", "turn", "text_eval.text_score", "text_eval.matched_block_count")


# --- aggregates ------------------------------------------------------------------


@query("""
SELECT source AS system_id, count(*) AS document_count, CAST(printf('%.2f', avg(quality * 100.0::DOUBLE)) AS DOUBLE) AS final_score, CAST(printf('%.2f', avg(toxic * 100.0::DOUBLE)) AS DOUBLE) AS table_score, CAST(printf('%.2f', avg(least(100.0::DOUBLE, n_chars / 100.0::DOUBLE))) AS DOUBLE) AS title_layout_score, CAST(printf('%.2f', avg(n_chars % 101)::DOUBLE) AS DOUBLE) AS text_score
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of sources."""
    return score.means(_source_scores(spark, sf_dir), ["system_id"], 2)


@query("""
WITH m AS (SELECT source AS system_id, count(*) AS document_count, CAST(printf('%.4f', avg(quality * 100.0::DOUBLE)) AS DOUBLE) AS final_score, CAST(printf('%.4f', avg(toxic * 100.0::DOUBLE)) AS DOUBLE) AS table_score, CAST(printf('%.4f', avg(least(100.0::DOUBLE, n_chars / 100.0::DOUBLE))) AS DOUBLE) AS title_layout_score, CAST(printf('%.4f', avg(n_chars % 101)::DOUBLE) AS DOUBLE) AS text_score
  FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT CAST(row_number() OVER (ORDER BY final_score DESC, CAST(substr(system_id, 4) AS INT)) AS INT) AS rank, * FROM m""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by mean score."""
    return score.leaderboard(_source_scores(spark, sf_dir))


def _source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select(F.col("source").alias("system_id"), F.substring("source", 4, 9).cast("int").alias("system_ordinal"), (F.col("quality") * 100.0).alias("final_score"), (F.col("toxic") * 100.0).alias("table_score"), F.least(F.lit(100.0), F.col("n_chars") / 100.0).alias("title_layout_score"), (F.col("n_chars") % 101).cast("double").alias("text_score"))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS doc_id, CASE WHEN n_regionkey = 0 THEN '/gt/primary/' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.md' WHEN n_regionkey = 1 THEN '/gt/primary/' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '_' || n_name || '.md' ELSE '/old/primary-gt/' || n_name || '_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.md' END AS path FROM nation")
def file_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of ground-truth documents by exact name, by prefix, and by the suffix of older ones."""
    nation = read(spark, sf_dir, "nation")
    doc = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    name = F.when(F.col("n_regionkey") == 0, text_of(doc, ".md")).when(F.col("n_regionkey") == 1, text_of(doc, "_", F.col("n_name"), ".md")).otherwise(text_of(F.col("n_name"), "_", doc, ".md"))
    files = nation.select(name.alias("file_name"), F.concat(F.when(F.col("n_regionkey") < 2, "/gt/primary/").otherwise("/old/primary-gt/"), name).alias("path"))
    return markdown.resolve_ground_truth(files, nation.select(doc.alias("doc_id")), "primary")


# --- adapters and whole documents ----------------------------------------------

#: What _rendered() makes, in SQL: names, and the texts that whole documents' results are told by.
_DOCS = """
WITH kept AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 4000
), n AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS name, replace(n_name, '_', '') AS bare, n_nationkey IN (SELECT k FROM kept) AS kept FROM nation
), seg AS (SELECT n_regionkey AS r, string_agg('| ' || s || ' | ' || c || ' |', chr(10) ORDER BY s) AS segments FROM (SELECT n_regionkey, c_mktsegment AS s, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_regionkey
), d AS (
  SELECT r, r_name, replace(r_name, ' ', '') AS r_bare, any_value(segments) AS segments, count(*) AS n, count(*) FILTER (kept) AS m,
    string_agg(bare || ' ' || k, chr(10) ORDER BY k) AS g, string_agg(bare || ' ' || k, chr(10) ORDER BY k) FILTER (kept) AS p,
    string_agg('<tr><td>' || name || '</td><td>' || k || '</td></tr>', '' ORDER BY k) FILTER (kept) AS pred_rows,
    string_agg('  <tr>' || chr(10) || '    <td>' || name || '</td>' || chr(10) || '    <td>' || k || '</td>' || chr(10) || '  </tr>', chr(10) ORDER BY k) AS canonical_rows,
    string_agg('## ' || name || chr(10) || 'The nation of ' || name || '.' || chr(10), chr(10) ORDER BY k) AS body, string_agg('## ' || name || chr(10) || 'A nation of ' || name || '.' || chr(10), chr(10) ORDER BY k) AS pred_body,
    string_agg(bare || chr(10) || 'Thenationof' || bare || '.', chr(10) || chr(10) ORDER BY k) AS g_text, string_agg(bare || chr(10) || 'Anationof' || bare || '.', chr(10) || chr(10) ORDER BY k) AS p_text
  FROM n JOIN region ON r_regionkey = r JOIN seg USING (r) GROUP BY r, r_name
), x AS (SELECT *, r_bare || chr(10) || chr(10) || g_text AS gt_text, r_bare || chr(10) || chr(10) || p_text AS pred_text, (1 + 2 * m::DOUBLE / n) / 3 * 100 AS structure, (1 - levenshtein(g, p)::DOUBLE / greatest(length(g), length(p))) * 100 AS content FROM d
), z AS (SELECT *, CAST(printf('%.4f', structure) AS DOUBLE) AS s1, CAST(printf('%.4f', content) AS DOUBLE) AS c1, CAST(printf('%.4f', structure * 0.6 + content * 0.4) AS DOUBLE) AS p1 FROM x
), y AS (
  SELECT *, CAST(r AS VARCHAR) AS doc_id, CAST(printf('%.4f', (p1 + 100) / 2) AS DOUBLE) AS table_score, CAST(printf('%.4f', (s1 + 100) / 2) AS DOUBLE) AS table_structure_score, CAST(printf('%.4f', (c1 + 100) / 2) AS DOUBLE) AS table_content_score,
    CAST(printf('%.4f', (1 - levenshtein(gt_text, pred_text)::DOUBLE / greatest(length(gt_text), length(pred_text))) * 100) AS DOUBLE) AS text_score FROM z)
"""
_SCORES = _DOCS + """
SELECT 'rendered' AS system_id, doc_id, CAST(printf('%.4f', table_score * 0.4 + 20 + text_score * 0.4) AS DOUBLE) AS final_score, table_score, 100.0::DOUBLE AS title_layout_score, text_score, table_structure_score, table_content_score, 2 AS matched_table_count, 0 AS missing_table_count, 0 AS extra_table_count, {primary} AS primary_selected_pair_count, 0 AS semi_semantic_selected_pair_count FROM y"""


@query()
def adapted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the adapter for wrapped divisions, with what it changed."""
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))
    out = adapters.adapt(docs, "divs", ["doc_id"])
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.to_json("stats").alias("stats"))


@query(_DOCS + "SELECT doc_id, 2 AS table_count, CAST(n + 1 AS INT) AS heading_count, 0 AS artifact_headings_removed, TRUE AS table_matrices_preserved, TRUE AS heading_sequence_preserved, TRUE AS idempotent, NULL AS error FROM y")
def adapter_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the plain adapter keeps rendered documents' tables and headings, and is idempotent."""
    docs = _rendered(spark, sf_dir).select("doc_id", F.col("pred").alias("text"))
    once = adapters.adapt(docs, "plain", ["doc_id"])
    return adapters.validate(docs, once, adapters.adapt(once.select("doc_id", "text"), "plain", ["doc_id"]), ["doc_id"])


@query(_DOCS + """SELECT doc_id, sha256('# ' || r_name || chr(10) || chr(10) || '<table>' || pred_rows || '</table>' || chr(10) || chr(10) || pred_body || chr(10) || '| segment | customers |' || chr(10) || '|---|---|' || chr(10) || segments || chr(10)) AS text_sha256, 3 AS removed_line_count FROM y""")
def repeated_header_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running headers and page numbers beyond the reference's own removed."""
    docs = _rendered(spark, sf_dir).withColumn("pred", F.concat(F.lit("Annual Report\n"), "pred", F.lit("\nAnnual Report\n12\n")))
    return cleanup.remove_repeated(docs, ["doc_id"], "pred", "gt").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "removed_line_count")


@query(_DOCS + """SELECT doc_id, sha256('# ' || r_name || chr(10) || chr(10) || '<table>' || chr(10) || canonical_rows || chr(10) || '</table>' || chr(10) || chr(10) || body || chr(10) || '| segment | customers |' || chr(10) || '|---|---|' || chr(10) || segments || chr(10)) AS text_sha256, TRUE AS changed, 1 AS tables_formatted, NULL AS error FROM y""")
def canonical_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents in canonical form, with the counts of what changed."""
    docs = _rendered(spark, sf_dir).select("doc_id", F.col("gt").alias("text"))
    return canonical.canonicalize(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "changed", "tables_formatted", "error")


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a region: headings, an HTML table of nations, a pipe table of market segments, body lines; a prediction that lost the nations without a rich supplier, and some words.

    There are as many documents as regions at any size: these queries are about
    whole documents, and the tables hold none. They are kept, as plans read them many
    times, and making them reads all customers and suppliers.
    """
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    rich = read(spark, sf_dir, "supplier").where("s_acctbal > 4000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    gt = lined(nation, ["n_regionkey"], ["n_nationkey"], row, "").withColumnRenamed("lines", "gt_table")
    pred = lined(nation.join(rich, "n_nationkey", "left_semi"), ["n_regionkey"], ["n_nationkey"], row, "").withColumnRenamed("lines", "pred_table")
    seg = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    segments = lined(seg, ["n_regionkey"], ["c_mktsegment"], F.concat(F.lit("| "), "c_mktsegment", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))).withColumnRenamed("lines", "segments")
    names = lined(nation, ["n_regionkey"], ["n_nationkey"], F.concat(F.lit("## "), "n_name", F.lit("\nThe nation of "), "n_name", F.lit(".\n"))).withColumnRenamed("lines", "body")
    docs = gt.join(pred, "n_regionkey").join(segments, "n_regionkey").join(names, "n_regionkey").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = lambda table, content: F.concat(F.lit("# "), "r_name", F.lit("\n\n<table>"), table, F.lit("</table>\n\n"), content, F.lit("\n| segment | customers |\n|---|---|\n"), "segments", F.lit("\n"))
    return docs.select(F.lit("rendered").alias("system_id"), F.col("r_regionkey").cast("string").alias("doc_id"), whole("gt_table", F.col("body")).alias("gt"), whole("pred_table", F.replace("body", F.lit("The nation"), F.lit("A nation"))).alias("pred"), whole("gt_table", F.col("body")).alias("gt_alt")).persist()


@query(_SCORES.format(primary=2))
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against a prediction that lost rows and words: all component scores."""
    return score.summary(score.evaluate(_rendered(spark, sf_dir), "max"))


@query(_SCORES.format(primary=0))
def document_scores_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the primary reference only, tables matched in order."""
    return score.summary(score.evaluate(_rendered(spark, sf_dir), "primary"))


@query(_DOCS + "SELECT doc_id, table_score, table_structure_score, table_content_score, 2 AS matched_table_count, 0 AS missing_table_count, 0 AS extra_table_count FROM y")
def table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table scores of rendered tables, lines of one region's nations missing in the prediction."""
    return score.summary(score.evaluate(_rendered(spark, sf_dir), "max")).select("doc_id", "table_score", "table_structure_score", "table_content_score", "matched_table_count", "missing_table_count", "extra_table_count")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(spark, sf_dir)
