"""Heading layout: alignment in document order, and the score of what is aligned.

Similarities of all heading pairs of a document are computed by Spark in the
document's row; the alignment takes them as one flat array.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext import schemas
from veritext.config import HEADING_GAP, HEADING_LEAST, HEADING_PREVIEW_CHARS, HEADING_UNLIKE, REPORT_OPS, TITLE_WEIGHTS
from veritext.functions import text
from veritext.functions.arrow import arrow_udf, settled
from veritext.functions.kernels import flat
from veritext.operators import distance, extract


def align(n: int, m: int, cost: np.ndarray) -> tuple[float, list[tuple[str, int, int, float]]]:
    """The cheapest alignment of n and m items, ties in the order match, missing, extra at each step back.

    cost: n x m costs of matches; a gap on either side costs HEADING_GAP.
    """
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = np.arange(n + 1) * HEADING_GAP, np.arange(m + 1) * HEADING_GAP
    for i in range(1, n + 1):
        above = best[i - 1]
        row = best[i]
        reach = np.minimum(above[:-1] + cost[i - 1], above[1:] + HEADING_GAP).tolist()
        left = row[0]
        for j, x in enumerate(reach, 1):
            left = row[j] = min(x, left + HEADING_GAP)
    ops, i, j = [], n, m
    while i or j:
        if i and j and best[i - 1, j - 1] + cost[i - 1, j - 1] == best[i, j]:
            i, j = i - 1, j - 1
            ops.append(("match", i, j, float(cost[i, j])))
        elif i and best[i - 1, j] + HEADING_GAP == best[i, j]:
            i -= 1
            ops.append(("missing", i, -1, HEADING_GAP))
        else:
            j -= 1
            ops.append(("extra", -1, j, HEADING_GAP))
    return float(best[n, m]), ops[::-1]


def _aligned(similarity, gt_level, pred_level, gt_text, pred_text):
    n, m = len(gt_level), len(pred_level)
    sim = np.array(similarity, float).reshape(n, m)
    total, ops = align(n, m, np.where(sim < HEADING_LEAST, HEADING_UNLIKE, 1 - sim))
    out = []
    for op, i, j, cost in ops:
        row = {"op": op, "cost": cost, "gt_index": None, "pred_index": None, "gt_level": None, "pred_level": None, "text_similarity": None, "gt_text_preview": None, "pred_text_preview": None}
        if i >= 0:
            row |= {"gt_index": i, "gt_level": int(gt_level[i]), "gt_text_preview": gt_text[i][:HEADING_PREVIEW_CHARS]}
        if j >= 0:
            row |= {"pred_index": j, "pred_level": int(pred_level[j]), "pred_text_preview": pred_text[j][:HEADING_PREVIEW_CHARS]}
        if op == "match":
            row["text_similarity"] = round(float(sim[i, j]), 4)
        out.append(row)
    return {"cost": total, "ops": out}


align_udf = arrow_udf(_aligned, f"struct<cost:double,ops:array<struct<{schemas.OP}>>>", once=True)


class LevelRows:
    """Rows of the alignment of integer levels, whose costs are their differences: a row's steps from cell to cell are -1, 0 or 1, kept as bits of whole numbers.

    A match that costs more than 2 is dearer than two gaps. A level that is None matches nothing.
    """

    def __init__(self, pred: list[int | None]):
        self.all, self.same = (1 << len(pred)) - 1, {}
        places: dict[int, bytearray] = {}
        for j, x in enumerate(pred):
            if x is not None:
                places.setdefault(x, bytearray(len(pred) // 8 + 1))[j // 8] |= 1 << j % 8
        self.same = {x: int.from_bytes(bits, "little") for x, bits in places.items()}

    def step(self, level: int | None, down: int, flat: int) -> tuple[int, int, int, int]:
        """The next row's (down, flat): where it falls, and where it doesn't rise, from cell to cell; and the same of the steps from the last row to this one."""
        bits = (lambda x: self.same.get(x, 0)) if level is not None else (lambda x: 0)
        free = bits(level)
        cheap = free | bits(level - 1) | bits(level + 1) if level is not None else 0
        rises = self.all ^ flat
        # A fall or a level step from above is passed on along a run of rises, as a carry.
        seeds = rises & free
        fell = (((seeds + rises) ^ rises) | seeds) & rises
        even = flat & ~down & (free | fell << 1)
        seeds = rises & (cheap | even << 1)
        still = even | (((seeds + rises) ^ rises) | seeds) & rises
        fell_before, still_before = fell << 1 & self.all, still << 1 & self.all
        grew = self.all ^ still_before
        closer = free | down
        return grew & closer, (still_before & ~fell_before & closer) | (grew & (cheap | flat)), fell, still


def level_cost(gt: list[int | None], pred: list[int | None]) -> float:
    """The cost of the cheapest alignment of two lists of levels, in memory that grows with one of them."""
    rows, down, flat = LevelRows(pred), 0, 0
    for x in gt:
        down, flat, _, _ = rows.step(x, down, flat)
    return float(len(gt) + len(pred) - flat.bit_count() - down.bit_count())


def align_levels(gt: list[int | None], pred: list[int | None]) -> tuple[float, list[tuple[str, int, int, float]]]:
    """What align() makes of the levels' differences. Only some rows are kept, and the others made again on the way back."""
    rows, every, kept, now = LevelRows(pred), isqrt(len(gt)) + 1, [], (0, 0)
    for i, x in enumerate(gt):
        if i % every == 0:
            kept.append(now)
        now = rows.step(x, *now)[:2]
    at = lambda bits, j: bits >> j & 1
    ops, i, j, first = [], len(gt), len(pred), len(gt)
    while i or j:
        if not i or not j:
            op = "missing" if i else "extra"
        else:
            if i <= first:
                first = (i - 1) // every * every
                now, block = kept[first // every], []
                for x in gt[first:i]:
                    block.append((*now, *(made := rows.step(x, *now))[2:]))
                    now = made[:2]
            down, flat, fell, still = block[i - 1 - first]
            grown = 1 - at(still, j - 1) - at(fell, j - 1)
            a, b = gt[i - 1], pred[j - 1]
            if a is not None and b is not None and grown + 1 - at(flat, j - 1) - at(down, j - 1) == abs(a - b):
                op = "match"
            else:
                op = "missing" if grown == 1 else "extra"
        i, j = i - (op != "extra"), j - (op != "missing")
        ops.append((op, i if op != "extra" else -1, j if op != "missing" else -1, float(abs(gt[i] - pred[j])) if op == "match" else HEADING_GAP))
    return sum(x[3] for x in ops), ops[::-1]


def _level_costs(gt_level, pred_level):
    total, ops = align_levels(gt_level, pred_level)
    return {"cost": total, "ops": [{"op": op, "gt_index": i if i >= 0 else None, "pred_index": j if j >= 0 else None, "cost": c} for op, i, j, c in ops]}


#: The protocol's other alignment, by levels alone; and its cost, which takes half the time.
align_levels_udf = arrow_udf(_level_costs, "struct<cost:double,ops:array<struct<op:string,gt_index:int,pred_index:int,cost:double>>>")
level_cost_udf = arrow_udf(level_cost, "double")


def pair_similarities(gt: Column, pred: Column) -> Column:
    """Row-major similarities of all pairs of two lists of flat texts."""
    return F.flatten(F.transform(gt, lambda g: F.transform(pred, lambda p: distance.similarity(g, p))))


def _flat_list(items):
    return [flat(flat(x)) for x in items]


flat_list_udf = arrow_udf(_flat_list, "array<string>", once=True)


def score(docs: DataFrame, gt: str, pred: str) -> DataFrame:
    """docs with a struct `title`: the layout score of array<struct<level,text>> columns gt and pred."""
    level = lambda c: settled(extract.relative_levels(F.transform(c, lambda h: h["level"])))
    texts = lambda c: settled(F.transform(c, lambda h: h["text"]))
    docs = docs.withColumns({"_gl": level(F.col(gt)), "_pl": level(F.col(pred)), "_gt": texts(F.col(gt)), "_pt": texts(F.col(pred))})
    docs = docs.withColumns({"_gf": flat_list_udf("_gt"), "_pf": flat_list_udf("_pt")})
    docs = docs.withColumn("_s", settled(pair_similarities(F.col("_gf"), F.col("_pf"))))
    docs = docs.withColumn("_a", align_udf("_s", "_gl", "_pl", "_gt", "_pt"))
    n, m = F.size("_gl"), F.size("_pl")
    both = F.filter("_a.ops", lambda o: o["op"] == "match")
    count = lambda op: F.size(F.filter("_a.ops", lambda o: o["op"] == op))
    matched = F.size(both)
    top = F.greatest(F.coalesce(F.array_max(F.concat("_gl", "_pl")), F.lit(1)), F.lit(1))
    precision, recall = matched / F.greatest(m, F.lit(1)), matched / F.greatest(n, F.lit(1))
    none = (n == 0) & (m == 0)
    f1 = F.when(none, 100.0).when(matched == 0, 0.0).otherwise(2.0 * precision * recall / (precision + recall) * 100.0)
    sims = F.aggregate(both, F.lit(0.0), lambda a, o: a + (1.0 - F.abs(o["gt_level"] - o["pred_level"]) / F.greatest(top - 1, F.lit(1))))
    levels = F.when(none, 100.0).when(matched == 0, 0.0).otherwise(sims / F.greatest(matched, F.lit(1)) * 100.0)
    order = F.when(none, 100.0).otherwise(matched / F.greatest(n, m, F.lit(1)) * 100.0)
    total = text.clamp(f1 * TITLE_WEIGHTS["heading_f1"] + levels * TITLE_WEIGHTS["level_accuracy"] + order * TITLE_WEIGHTS["order"])
    unlike = F.size(F.filter(both, lambda o: o["gt_level"] != o["pred_level"]))
    told = F.filter(F.array(
        F.when(unlike > 0, F.concat(unlike.cast("string"), F.lit(" aligned headings have different relative levels."))),
        F.when(count("missing") > 0, F.concat(count("missing").cast("string"), F.lit(" GT headings are missing."))),
        F.when(count("extra") > 0, F.concat(count("extra").cast("string"), F.lit(" predicted headings are extra.")))), lambda x: x.isNotNull())
    result = F.struct(
        text.rounded(total).alias("title_layout_score"), text.rounded(f1).alias("heading_f1_score"), text.rounded(levels).alias("level_accuracy_score"), text.rounded(order).alias("order_score"),
        text.rounded(F.col("_a.cost")).alias("alignment_cost"), matched.alias("matched_heading_count"), count("missing").alias("missing_heading_count"), count("extra").alias("extra_heading_count"), unlike.alias("level_mismatch_count"),
        F.transform(gt, lambda h: h["level"]).alias("gt_raw_heading_levels"), F.transform(pred, lambda h: h["level"]).alias("pred_raw_heading_levels"), F.col("_gl").alias("gt_relative_heading_levels"), F.col("_pl").alias("pred_relative_heading_levels"),
        F.when(F.size(told) == 0, F.array(F.lit("No heading layout penalty."))).otherwise(told).alias("issues"), F.slice("_a.ops", 1, REPORT_OPS).alias("alignment"))
    return docs.withColumn("title", result).drop("_gl", "_pl", "_gt", "_pt", "_gf", "_pf", "_s", "_a")
