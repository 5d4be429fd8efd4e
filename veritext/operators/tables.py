"""Table pairs: features, retrieval, pair scores, one-to-one matching, and the table score of documents.

Pairs come from an equi-join on the document's keys, never across documents. Cheap
scores rank all of a document's pairs; the expensive content distance is computed
for the best few of each table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.config import EDGE_WEIGHTS, EXACT_TABLE_CELLS, KEYWORD_WEIGHTS, LEAST_KEYWORD, LEAST_MATCH, LEAST_PAIR, ORDERED_CANDIDATES, RETRIEVAL_WEIGHTS, RETRIEVED_CANDIDATES, ScoringConfig
from veritext.functions import kernels, text
from veritext.functions.arrow import arrow_udf, settled
from veritext.operators import distance, extract

# --- features ------------------------------------------------------------------


def _flattener(config: ScoringConfig):
    def flattened(matrix):
        """A table's text in normal form: cells by tabs, rows by line feeds, normalized as a whole once more."""
        if matrix is None:
            return None
        whole = "\n".join("\t".join(kernels.semantic(c, config) for c in row) for row in matrix)
        return [whole, kernels.semantic(whole, config)]

    return arrow_udf(flattened, "array<string>", once=True)


def features(tables: DataFrame, config: ScoringConfig) -> DataFrame:
    """tables with words, bigrams, content (normal form) and has_content."""
    rows = tables.withColumn("_anchor", settled(extract.anchor_text(F.col("matrix")))).withColumn("_flat", _flattener(config)("matrix"))
    return rows.withColumns({"words": extract.anchor_words(F.col("_anchor")), "bigrams": extract.anchor_bigrams(F.col("_anchor")), "content": F.col("_flat")[1], "has_content": F.col("_flat")[0] != ""}).drop("_anchor", "_flat")


def alike(a: Column, b: Column) -> Column:
    """1 less the difference over the larger, of two counts."""
    return 1.0 - F.abs(a - b) / F.greatest(a, b, F.lit(1))


def structure_score(rows_a: Column, cols_a: Column, rows_b: Column, cols_b: Column) -> Column:
    """Mean similarity of row, column and cell counts, in 0 to 100."""
    mean = (alike(rows_a, rows_b) + alike(cols_a, cols_b) + alike(rows_a * cols_a, rows_b * cols_b)) / 3.0 * 100.0
    return F.when((rows_a == 0) & (rows_b == 0), 100.0).otherwise(text.clamp(mean))


def set_similarity(both: Column, n: Column, m: Column) -> Column:
    """The larger of dice and containment of sets of n and m members that share `both`; 0 if either is empty."""
    return F.when((n == 0) | (m == 0), 0.0).otherwise(F.greatest(2.0 * both / (n + m), both / F.least(n, m)))


def with_keyword_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `keyword`, from the words and bigrams of sides a and b; each intersection is taken once."""
    kinds = ("words", "bigrams")
    pairs = pairs.withColumns({f"_{k}": F.size(F.array_intersect(f"{a}_{k}", f"{b}_{k}")) for k in kinds})
    word, bigram = (set_similarity(F.col(f"_{k}"), F.size(f"{a}_{k}"), F.size(f"{b}_{k}")) for k in kinds)
    return pairs.withColumn("keyword", text.rounded(100.0 * (KEYWORD_WEIGHTS["word"] * word + KEYWORD_WEIGHTS["bigram"] * bigram))).drop(*[f"{x}_{k}" for x in ("", a, b) for k in kinds])


# --- pairs ---------------------------------------------------------------------

LIGHT = ("index", "kind", "rows", "cols", "words", "bigrams", "span_pages")


def document_pairs(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs within a document, with structure and keyword scores. Contents don't take part."""
    side = lambda df, name: df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in LIGHT])
    pairs = side(gt, "gt").join(side(pred, "pred"), keys)
    c = F.col
    pairs = pairs.withColumn("structure", structure_score(c("gt_rows"), c("gt_cols"), c("pred_rows"), c("pred_cols")))
    return with_keyword_score(pairs, "pred", "gt")


def retrieved(pairs: DataFrame, keys: list[str], k: int = RETRIEVED_CANDIDATES) -> DataFrame:
    """The k ground-truth tables of each predicted one that words and shape speak for."""
    score = RETRIEVAL_WEIGHTS["keyword"] * F.col("keyword") + RETRIEVAL_WEIGHTS["structure"] * F.col("structure")
    best = Window.partitionBy(*keys, "pred_index").orderBy(F.desc("retrieval"), "gt_index")
    return pairs.withColumn("retrieval", score).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def pair_scores(pairs: DataFrame, gt: DataFrame, pred: DataFrame, keys: list[str], config: ScoringConfig) -> DataFrame:
    """pairs with table_structure_score, table_content_score and table_pair_score, and the cross-page marks."""
    side = lambda df, name: df.select(*keys, F.col("index").alias(f"{name}_index"), F.col("content").alias(f"_{name}"), F.col("has_content").alias(f"_{name}_has"))
    rows = pairs.join(side(gt, "gt"), [*keys, "gt_index"]).join(side(pred, "pred"), [*keys, "pred_index"])
    empty = (F.col("gt_rows") == 0) & (F.col("pred_rows") == 0)
    apart = distance.normalized(F.col("_gt"), F.col("_pred"), EXACT_TABLE_CELLS)
    content = F.when(empty | (~F.col("_gt_has") & ~F.col("_pred_has")), 100.0).when(~F.col("_gt_has") | ~F.col("_pred_has"), 0.0).otherwise(text.clamp((1.0 - apart) * 100.0))
    rows = rows.withColumn("_content", content)
    whole = text.clamp(F.col("structure") * config.structure_share + F.col("_content") * config.content_share)
    return rows.withColumns({
        "table_structure_score": text.rounded(F.col("structure")), "table_content_score": text.rounded(F.col("_content")), "table_pair_score": text.rounded(whole),
        "gt_is_cross_page": F.col("gt_span_pages").isNotNull(), "pred_is_cross_page": F.col("pred_span_pages").isNotNull(),
    }).drop("_gt", "_pred", "_gt_has", "_pred_has", "_content")


# --- matching ------------------------------------------------------------------

EDGE = "array<struct<p:int,g:int>>"


def _greedy(preds, gts):
    used_p, used_g, out = set(), set(), []
    for p, g in zip(preds, gts):
        if p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            out.append((p, g))
    return out


_greedy_udf = arrow_udf(_greedy, EDGE, once=True)


def greedy(edges: Column) -> Column:
    """One-to-one edges from array<struct<..., p, g>> in its order: an edge stays if neither end has one yet."""
    return _greedy_udf(edges["p"], edges["g"])


def global_match(gt: DataFrame, pred: DataFrame, keys: list[str], config: ScoringConfig) -> DataFrame:
    """Matches of predicted tables regardless of their order: the best edges first, each table once."""
    pairs = pair_scores(retrieved(document_pairs(gt, pred, keys), keys), gt, pred, keys, config)
    match = EDGE_WEIGHTS["keyword"] * F.col("keyword") + EDGE_WEIGHTS["pair"] * F.col("table_pair_score") + EDGE_WEIGHTS["structure"] * F.col("table_structure_score")
    weak = (F.col("_match") < LEAST_MATCH) | ((F.col("keyword") < LEAST_KEYWORD) & (F.col("table_pair_score") < LEAST_PAIR))
    edges = pairs.withColumn("_match", match).where(~weak)
    listed = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_match")).alias("a"), (-F.col("keyword")).alias("b"), (-F.col("table_pair_score")).alias("c"), F.col("pred_index").alias("p"), F.col("gt_index").alias("g")))).alias("e"))
    kept = listed.select(*keys, F.explode(greedy(F.col("e"))).alias("k")).select(*keys, F.col("k.p").alias("pred_index"), F.col("k.g").alias("gt_index"))
    return edges.join(kept, [*keys, "pred_index", "gt_index"]).withColumns({"table_keyword_score": F.col("keyword"), "table_match_score": text.rounded(F.col("_match"))}).drop("_match", "retrieval", "keyword", "structure")


def _chooser(config: ScoringConfig):
    """For one document: each ground-truth table in order takes its best free candidate; contents are compared for the few nearest in shape only."""

    def choose(gt, pred):
        def shape(a, b):
            pairs = ((a["rows"], b["rows"]), (a["cols"], b["cols"]), (a["rows"] * a["cols"], b["rows"] * b["cols"]))
            return 100.0 if not a["rows"] and not b["rows"] else sum(1 - abs(x - y) / max(x, y, 1) for x, y in pairs) / 3 * 100

        def whole(a, b, structure):
            if structure == 100.0 and not a["rows"] and not b["rows"] or not a["has_content"] and not b["has_content"]:
                content = 100.0
            elif not a["has_content"] or not b["has_content"]:
                content = 0.0
            else:
                n, m = len(a["content"]), len(b["content"])
                steps = distance.levenshtein(a["content"], b["content"]) if n * m <= EXACT_TABLE_CELLS else distance.segmented(a["content"], b["content"])
                content = (1 - min(1.0, steps / max(n, m, 1))) * 100
            return round(structure * config.structure_share + content * config.content_share, 4)

        free, out = {p["index"]: p for p in pred}, []
        for a in sorted(gt, key=lambda t: t["index"]):
            g = a["index"]
            near = sorted(((-shape(a, b), abs(p - g), p) for p, b in free.items()))[:ORDERED_CANDIDATES]
            best = None
            for less, far, p in near:
                if best is not None and -less * config.structure_share + 100.0 * config.content_share <= best[0]:
                    break
                best = max(filter(None, (best, (whole(a, free[p], -less), -far, p))), key=lambda x: x[:2])
            if best is None:
                break
            del free[best[2]]
            out.append((best[2], g))
        return out

    return arrow_udf(choose, EDGE, once=True)


def ordered_match(gt: DataFrame, pred: DataFrame, keys: list[str], config: ScoringConfig) -> DataFrame:
    """Matches in the order of the ground truth: each table takes its best unused prediction among the nearest in shape.

    Which candidates are free depends on earlier choices, so a fold over the
    document's tables chooses; the pairs chosen are scored as all others are.
    """
    listed = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct("index", "rows", "cols", "content", "has_content")).alias(name))
    both = listed(gt, "g").join(listed(pred, "p"), keys)
    chosen = both.select(*keys, F.explode(_chooser(config)("g", "p")).alias("k")).select(*keys, F.col("k.p").alias("pred_index"), F.col("k.g").alias("gt_index"))
    pairs = document_pairs(gt, pred, keys).join(chosen, [*keys, "pred_index", "gt_index"])
    return pair_scores(pairs, gt, pred, keys, config).drop("keyword", "structure")


def better_of(primary: DataFrame, alt: DataFrame, keys: list[str]) -> DataFrame:
    """Of a predicted table's matches in two references the better one; the primary one unless the other is strictly better."""
    on = [*keys, "pred_index"]
    fields = [c for c in primary.columns if c not in on]
    a = primary.select(*on, F.struct(*fields).alias("p"))
    b = alt.select(*on, F.struct(*fields).alias("a"))
    both = a.join(b, on, "full")
    take = F.col("a").isNotNull() & (F.col("p").isNull() | (F.col("a.table_pair_score") > F.col("p.table_pair_score")))
    chosen = F.when(take, F.col("a")).otherwise(F.col("p"))
    return both.select(*on, chosen.alias("m"), F.when(take, "alt").otherwise("primary").alias("selected_gt_variant"), F.col("p.table_pair_score").alias("primary_pair_score"), F.col("a.table_pair_score").alias("alt_pair_score")).select(*on, "m.*", "selected_gt_variant", "primary_pair_score", "alt_pair_score")


# --- scores --------------------------------------------------------------------

MATCH_FIELDS = ("gt_index", "pred_index", "gt_kind", "pred_kind", "gt_span_pages", "pred_span_pages", "gt_is_cross_page", "pred_is_cross_page", "gt_rows", "gt_cols", "pred_rows", "pred_cols", "table_structure_score", "table_content_score", "table_pair_score")


def total(counts: DataFrame, matches: DataFrame, keys: list[str], by_pred: bool) -> DataFrame:
    """keys and a struct `table` from counts(keys, n_gt, n_alt, n_pred) and matches. n_alt is null without a second reference.

    by_pred: the denominator counts the smaller reference, and matches name the variant that they were taken from.
    """
    fields = [*MATCH_FIELDS, *[c for c in ("table_keyword_score", "table_match_score", "selected_gt_variant", "primary_pair_score", "alt_pair_score") if c in matches.columns]]
    cross = F.col("gt_is_cross_page") | F.col("pred_is_cross_page")
    variant = lambda v: F.count_if(F.col("selected_gt_variant") == v) if by_pred else F.sum(F.lit(0))
    sums = matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"table_{k}_score").alias(k) for k in ("structure", "content", "pair")], F.avg(F.when(cross, F.col("table_pair_score"))).alias("cross"),
        variant("primary").alias("primary"), variant("alt").alias("alt"),
        F.sort_array(F.collect_list(F.struct(F.col("pred_index" if by_pred else "gt_index").alias("_k"), *fields))).alias("m"))
    rows = counts.join(sums.select(*keys, "n", "structure", "content", "pair", "cross", "primary", "alt", "m"), keys, "left")
    n = F.coalesce("n", F.lit(0))
    reference = F.least("n_gt", "n_alt") if by_pred else F.col("n_gt")
    empty = (F.col("n_gt") == 0) & (F.coalesce("n_alt", F.lit(0)) == 0) & (F.col("n_pred") == 0) if by_pred else (F.col("n_gt") == 0) & (F.col("n_pred") == 0)
    over = F.greatest("n_pred", reference, F.lit(1))
    mean = lambda c: F.when(empty, 100.0).otherwise(text.rounded(text.clamp(F.coalesce(c, F.lit(0.0)) / over)))
    return rows.select(*keys, F.struct(
        mean(F.col("content")).alias("table_content_score"), mean(F.col("structure")).alias("table_structure_score"), mean(F.col("pair")).alias("table_matrix_score"), mean(F.col("pair")).alias("final_table_score"),
        n.alias("matched_table_count"), F.greatest(reference - n, F.lit(0)).alias("missing_table_count"), (F.col("n_pred") - n).alias("extra_table_count"), reference.alias("gt_table_count"), F.col("n_pred").alias("pred_table_count"),
        F.coalesce("primary", F.lit(0)).alias("primary_selected_pair_count"), F.coalesce("alt", F.lit(0)).alias("alt_selected_pair_count"), text.rounded(F.col("cross")).alias("cross_page_table_score"),
        F.coalesce(F.transform("m", lambda x: x.dropFields("_k")), F.array()).alias("matches")).alias("table"))
