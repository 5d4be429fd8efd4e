"""N-gram Jaccard join by vertical partitioning.

The global order of the shingles, from the rarest to the most frequent, is cut at
pivots into fragments, and each fragment has the segment that a document's set has
of it. Overlaps are counted inside each fragment and summed a pair. In this order:

1. Each slice of the input sends the shingle hashes of its sets to be counted. A
   shingle of one set adds to no overlap, and stands first in the order.
2. A set can only reach the threshold t if at least t of its shingles are shared.
   All others leave (with a class of their own). Equal sets become one class.
3. The shingles of the classes left are ordered by the number of classes, and
   pivots cut the order into FRAGMENTS with about the same number of postings.
4. Classes with the same most frequent shingle form blocks, two blocks a tile. Into a
   tile come the classes that share one of their rarest shingles, up to the prefix
   length, with a class of fitting length in its other block. A pair that links is in
   exactly one tile. Where components are enough (keep_one()), each prefix shingle
   first proposes its classes to one hub, and tiles take what that leaves apart.
5. In each fragment the segments of a tile's classes give partial overlaps of all its
   pairs. A pair that couldn't reach the threshold if all its shingles before and
   after the segments were equal is left out there. Partial overlaps are summed a
   pair and held against the threshold in integers. A tile returns each class's
   number of links and what they connect it to, not the pairs.

Shingles are compared by 64-bit hashes, so results are exact but for collisions.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; with fewer words than a shingle the whole sequence is the one
shingle; equal sets always link; rows that share a doc_id but not a set are nodes
of their own; rows with a null doc_id link like others, and a component's id is its
smallest doc_id that isn't null (null if all are).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm import common, exchange

#: Fragments that the order of the shingles is cut into, and the error of the pivots' places in it.
FRAGMENTS, ACCURACY = 8, 1000
#: Classes in a block, about.
BLOCK = 1024
#: About as many members of tiles are taken by one task.
MEMBERS = 4096
#: In a tile, columns of a product of matrices, share of its pairs (one in so many) from which on a shingle gets a column, and pairs made at once.
COLUMNS, DENSE, PAIRS = 2048, 200, 1 << 20
#: The rarest shingles of a list that candidates are compared by before they become pairs.
HEAD = 64

SETS_SQL = "doc_id bigint, sha string, n_shingles bigint, digest binary, shared array<bigint>"


def document_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words lower-cased in A-Z."""
    shingles, sizes = common.shingle_hashes(*common.word_hashes(texts, common.LOWER_TABLE), k)
    return [np.unique(x) for x in np.split(shingles, np.cumsum(sizes)[:-1])] if texts else []


def shared_shingles(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """SETS_SQL of every row: digest of the text, set size, digest of the set, and the shingles that other sets hold too; null where these are too few for any link."""
    slices = exchange.slices(docs, "jaccard-slices")
    deal = exchange.Deal.of(slices, 1 / 6)
    kind = deal.marks(32)

    def dealt(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes], list[int], exchange.Dealt]:
        """The distinct sets, their digests, the set of each text, and what is sent of them."""
        sets = document_sets(texts, k)
        slot: dict[bytes, int] = {}
        own = [slot.setdefault(xxhash.xxh3_128_digest(s.tobytes()), len(slot)) for s in sets]
        first = {o: i for i, o in reversed(list(enumerate(own)))}
        distinct = [sets[first[o]] for o in range(len(slot))]
        return distinct, list(slot), own, exchange.Dealt(deal, np.concatenate([np.zeros(0, np.uint64), *distinct]), kind, 32)

    def send(source: int, body: bytes) -> pa.RecordBatch:
        return dealt(exchange.unpack(body)[1])[3].rows(source)

    def finish(source: int, body: bytes, replies: dict[int, bytes]) -> pa.Table:
        ids, texts, _ = exchange.unpack(body)
        sets, digests, own, sent = dealt(texts)
        hit = sent.sums(replies)[0] > 1
        shared = []
        for s, e in zip(sets, np.cumsum([len(s) for s in sets]).tolist(), strict=True):
            mine = s[hit[e - len(s) : e]]
            shared.append(mine.view(np.int64) if len(s) and den * len(mine) >= num * len(s) else None)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "n_shingles": pa.array([len(sets[o]) for o in own], pa.int64()),
            "digest": pa.array([digests[o] for o in own], pa.binary()), "shared": pa.array([shared[o] for o in own], pa.list_(pa.int64()))})

    replies = exchange.exchange(slices.select("source", "body").mapInArrow(exchange.each_slice(send), exchange.SQL), deal, kind)
    return exchange.at_slices(slices, replies, finish, SETS_SQL)


# --- pairs -------------------------------------------------------------------

def least_overlap(n, num: int, den: int):
    """ceil(n * num / den) in integers."""
    return F.floor((n * num + (den - 1)) / den).cast("bigint")


def ordered_lists(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, lone, s) of classes(rep, n, shared): shingles that two classes share as (count, hash) in the global order; lone others come before."""
    held = classes.select("rep", "n", F.explode("shared").alias("h"))
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = held.join(counts, "h").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    return common.stored(lists.where(F.size("s") * den >= F.col("n") * num).select("rep", "n", (F.col("n") - F.size("s")).alias("lone"), "s"), "jaccard-lists")


def pivots(lists: DataFrame) -> list[float]:
    """Where the global order is cut: ranks (see rank()) that leave about as many postings between them."""
    shares = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    found = lists.select(F.explode("s").alias("x")).agg(F.percentile_approx(rank(F.col("x")), shares, ACCURACY).alias("p")).first()["p"]
    return sorted(set(found or []))


def rank(x: Column) -> Column:
    """A shingle's place in the global order as one number: its count, then its hash. Equal for equal shingles."""
    return x["c"].cast("double") + x["h"].cast("double") / 2.0**64 + 0.5


def segments(lists: DataFrame, cuts: list[float]) -> DataFrame:
    """(rep, n, f, seg, ahead, behind): each class's segment of each fragment, and how many of its shared shingles stand before and after it."""
    # A second parameter of a lambda would be the place in the list.
    upto = lambda cut: F.size(F.filter("s", lambda x: rank(x) <= cut))
    ends = F.array(F.lit(0), *[upto(c) for c in cuts], F.size("s"))
    rows = lists.select("rep", "n", F.transform("s", lambda x: x["h"]).alias("s"), ends.alias("ends")).select("*", F.posexplode(F.slice("ends", 1, len(cuts) + 1)).alias("f", "ahead"))
    end = F.element_at("ends", F.col("f") + 2)
    return rows.select("rep", "n", "f", F.slice("s", F.col("ahead") + 1, end - F.col("ahead")).alias("seg"), "ahead", (F.size("s") - end).alias("behind"))


def can_link(num: int, den: int):
    """The length and position filters for a prefix shingle that l and r share."""
    both = F.col("l.n") + F.col("r.n")
    lengths = F.least("l.n", "r.n") * den >= F.greatest("l.n", "r.n") * num
    ahead = 1 + F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
    return lengths & (ahead * (den + num) >= both * num)


def heads(lists: DataFrame) -> DataFrame:
    """(rep, n, head, tail): numbers of a list's HEAD rarest shingles, and how many more it has. Numbers of 32 bits will do: shingles of a list that coincide count as behind its head."""
    low = F.array_distinct(F.transform(F.slice("s", 1, HEAD), lambda x: F.hash(x["h"])))
    return lists.select("rep", "n", low.alias("head"), (F.col("n") - F.col("lone") - F.size(low)).alias("tail"))


def in_reach(num: int, den: int) -> Column:
    """Whether l and r can reach the threshold by what their heads have in common. What one's head lacks of the other stands behind its end, or is behind the other's."""
    return (F.size(F.array_intersect("l.head", "r.head")) + F.greatest("l.tail", "r.tail")) * (den + num) >= (F.col("l.n") + F.col("r.n")) * num


def overlaps(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps inside each fragment, summed a pair."""
    side = lambda x: parts.select(F.col("rep").alias(x), "f", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "seg", "ahead", "behind")])
    both = F.col("n_a") + F.col("n_b")
    partial = pairs.join(side("a"), "a").join(side("b"), ["b", "f"]).select("a", "b", both.alias("both"), F.size(F.array_intersect("seg_a", "seg_b")).alias("o"), (F.least("ahead_a", "ahead_b") + F.least("behind_a", "behind_b")).alias("rest"))
    # A pair that fails here fails in the sum too, which can only be smaller.
    live = partial.where((F.col("o") > 0) & ((F.col("o") + F.col("rest")) * (den + num) >= F.col("both") * num))
    summed = live.groupBy("a", "b").agg(F.first("both").alias("both"), F.sum("o").alias("o"))
    return common.stored(summed.where(F.col("o") * (den + num) >= F.col("both") * num).select("a", "b"), "jaccard-links")


# --- links by tiles ----------------------------------------------------------

PARTIAL_SQL = "bucket bigint, members binary, sizes binary, counts binary, places binary, sums binary"
PARTIAL = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("members", "sizes", "counts", "places", "sums")]])
LINKS_SQL = "node bigint, root bigint, n bigint"


def prefixes(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, block, h, pos): each class's block (see blocks()) and its rarest shingles up to the prefix length, with their positions in its order."""
    length = F.col("n") - least_overlap(F.col("n"), num, den) + 1 - F.col("lone")
    short = lists.select("rep", "n", "lone", F.transform(F.slice("s", 1, length.cast("int")), lambda x: x["h"]).alias("s"))
    prefix = short.join(blocks(lists), "rep").select("rep", "n", "block", "lone", F.posexplode("s").alias("i", "h"))
    return common.stored(prefix.select("rep", "n", "block", "h", (F.col("lone") + F.col("i") + 1).alias("pos")), "jaccard-prefix")


def blocks(lists: DataFrame) -> DataFrame:
    """(rep, block): classes with the same most frequent shingle stand in a block, or in several of about BLOCK classes. Near copies mostly have that in common, so their pairs lie in few tiles."""
    keyed = common.stored(lists.select("rep", F.element_at("s", -1)["h"].alias("key")), "jaccard-keys")
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    found = common.join_verdicts(keyed, keys, "key", "members", keyed.count())
    return found.select("rep", F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK))).alias("block"))


def tiles(named: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, rep, first, component): the classes of each tile of two blocks x <= y, or of one with itself; first: rep is of x. named is prefixes() with components.

    A class comes into the tile with a block that has a class of fitting size and
    another component with one of its prefix shingles. Both classes of a pair of two
    components that links do, in the one tile of their blocks.
    """
    in_block = named.groupBy("h", "block").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("n", "component") for f in (F.min, F.max)])
    by_shingle = in_block.groupBy("h").agg(F.collect_list(F.struct("block", "min_n", "max_n", "min_component", "max_component")).alias("all"), F.min("min_component").alias("low"), F.max("max_component").alias("high"))
    by_shingle = by_shingle.where("low < high").select("h", "all")
    fits = lambda b: (b["max_n"] * den >= F.col("n") * num) & (F.col("n") * den >= b["min_n"] * num) & ((b["min_component"] != F.col("component")) | (b["max_component"] != F.col("component")))
    met = named.join(by_shingle, "h").select("rep", "block", "component", F.transform(F.filter("all", fits), lambda b: b["block"]).alias("met")).where(F.size("met") > 0)
    other = met.groupBy("rep").agg(F.first("block").alias("block"), F.first("component").alias("component"), F.array_distinct(F.flatten(F.collect_set("met"))).alias("met")).select("rep", "block", "component", F.explode("met").alias("other"))
    return common.stored(other.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", (F.col("block") <= F.col("other")).alias("first"), "component"), "jaccard-tiles")


def tile_overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many values each array of a has in common with each of b; without b, with each one behind it in a. No array has a value twice."""
    both = [*a, *(b or [])]
    values, ids = np.unique(np.concatenate(both), return_inverse=True)
    at = np.repeat(np.arange(len(both)), [len(s) for s in both])
    mine = at < len(a)
    (i, ci), (j, cj) = (at[mine], ids[mine]), (at, ids) if b is None else (at[~mine] - len(a), ids[~mine])
    left, right = np.bincount(ci, minlength=len(values)), np.bincount(cj, minlength=len(values))
    shape = len(a), len(both) if b is None else len(b)
    out = np.zeros(shape, np.float32)
    pairs = left * right
    dense = pairs * DENSE > out.size
    # Values that many hold, by products of matrices.
    columns = np.flatnonzero(dense)
    for low in range(0, len(columns), COLUMNS):
        place = np.full(len(values), -1)
        place[columns[low : low + COLUMNS]] = np.arange(len(columns[low : low + COLUMNS]))
        held = [np.zeros((rows, min(COLUMNS, len(columns) - low)), np.float32) for rows in shape]
        for h, r, c in zip(held, (i, j), (ci, cj), strict=True):
            h[r[place[c] >= 0], place[c][place[c] >= 0]] = 1
        out += held[0] @ held[1].T
    # All others by their pairs.
    rare = ~dense & (pairs > 0)
    i, ci = i[rare[ci]], ci[rare[ci]]
    if len(i):
        j = j[np.argsort(cj, kind="stable")]
        begin, upto = (np.cumsum(right) - right)[ci], np.cumsum(right[ci])
        for low in range(0, int(upto[-1]), PAIRS):
            k = np.searchsorted(upto, np.arange(low, min(low + PAIRS, int(upto[-1]))), "right")
            nth = np.arange(low, low + len(k)) - (upto - right[ci])[k]
            out += np.bincount(i[k] * shape[1] + j[begin[k] + nth], minlength=out.size).reshape(shape)
    return np.triu(out, 1) if b is None else out


def narrow(values: np.ndarray) -> bytes:
    """Small numbers in 16 bits each if all fit, else in 32."""
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32).tobytes()


def widened(body: bytes, size: int) -> np.ndarray:
    return np.frombuffer(body, np.uint16 if len(body) == 2 * size else np.uint32).astype(np.int64)


def partial_overlaps(num: int, den: int):
    """Kernel over the rows of tiles in one fragment: its members in order, and the partial overlaps of the pairs of two components in each tile, in rows by member (PARTIAL_SQL)."""

    def run(table: pa.Table) -> pa.Table:
        x, y, rep, component, n, ahead, behind = (table.column(c).to_numpy() for c in ("x", "y", "rep", "component", "n", "ahead", "behind"))
        second = ~table.column("first").to_numpy()
        order = np.lexsort((rep, second, y, x))
        x, y, rep, component, n, ahead, behind, second = (c[order] for c in (x, y, rep, component, n, ahead, behind, second))
        seg = pa.concat_arrays(table.column("seg").chunks)
        flat, ends = seg.values.to_numpy(), seg.offsets.to_numpy()
        segs = [flat[ends[k] : ends[k + 1]] for k in order.tolist()]
        edges = np.concatenate([[0], np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1, [len(x)]])
        counts = np.zeros(len(x), np.uint32)
        places, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            alone = x[s] == y[s]
            m = s if alone else s + int(np.count_nonzero(~second[s:e]))
            a, b = slice(s, e if alone else m), slice(m, e)
            o = tile_overlaps(segs[a], None if alone else segs[b])
            rest = np.minimum.outer(ahead[a], ahead[b]) + np.minimum.outer(behind[a], behind[b])
            # A pair that fails here fails in the sum too, which can only be smaller.
            i, j = np.nonzero((o > 0) & np.not_equal.outer(component[a], component[b]) & ((o + rest) * (den + num) >= np.add.outer(n[a], n[b]) * num))
            counts[a] = np.bincount(i, minlength=a.stop - s)
            places.append(j + (m - s))
            sums.append(o[i, j].astype(np.int64))
        head, sizes = (np.stack([rep, n]).tobytes(), np.diff(edges).tobytes()) if table.column("f")[0].as_py() == 0 else (None, None)
        row = {"bucket": table.column("bucket")[0].as_py(), "members": head, "sizes": sizes, "counts": counts.tobytes(), "places": narrow(np.concatenate(places)), "sums": narrow(np.concatenate(sums))}
        common.tidy()
        return pa.Table.from_pylist([row], PARTIAL)

    return run


def summed_overlaps(num: int, den: int):
    """Kernel over the fragments of tiles: partial overlaps summed a pair and held against the threshold; per tile and class with links, their number and the smallest class that they lead to inside of the tile (LINKS_SQL)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = next(r for r in rows if r["members"] is not None)
        rep, n = np.frombuffer(first["members"], np.int64).reshape(2, -1)
        sizes = np.frombuffer(first["sizes"], np.int64)
        begin, width = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        counts = [np.frombuffer(r["counts"], np.uint32) for r in rows]
        # Cells of each member with pairs, one for each member of its tile.
        width = np.where(np.sum(counts, axis=0) > 0, width, 0)
        row = np.cumsum(width) - width
        total = np.zeros(int(width.sum()), np.uint32)
        for r, c in zip(rows, counts, strict=True):
            size = int(c.sum())
            total[np.repeat(row, c) + widened(r["places"], size)] += widened(r["sums"], size).astype(np.uint32)
        at = np.flatnonzero(total)
        holders = np.flatnonzero(width)
        i = holders[np.searchsorted(row[holders], at, "right") - 1]
        j = begin[i] + at - row[i]
        linked = total[at].astype(np.int64) * (den + num) >= (n[i] + n[j]) * num
        i, j = i[linked], j[linked]
        links = np.bincount(i, minlength=len(rep)) + np.bincount(j, minlength=len(rep))
        # Members in the order of their classes, so that the smallest label is the smallest class.
        order = np.argsort(rep, kind="stable")
        label = np.empty(len(rep), np.int64)
        label[order] = np.arange(len(rep))
        while len(i):
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[order[low]]
            if (low == label).all():
                break
            label = low
        has = links > 0
        common.tidy()
        return pa.table({"node": rep[has], "root": rep[order[label[has]]], "n": links[has]})

    return run


def tile_links(placed: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root, n) for each class of a tile that links with one of another component: how many do, and the smallest class that they lead to inside of the tile."""
    buckets = max(1, placed.count() // MEMBERS)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("x", "y"), F.lit(buckets))).join(parts, "rep")
    partial = rows.groupBy("bucket", "f").applyInArrow(partial_overlaps(num, den), PARTIAL_SQL)
    return common.stored(partial.groupBy("bucket").applyInArrow(summed_overlaps(num, den), LINKS_SQL), "jaccard-links")


def all_links(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) and (node, component) of the classes (rep, n, shared) that link: every link counts."""
    lists = ordered_lists(classes, num, den)
    placed = tiles(prefixes(lists, num, den).withColumn("component", F.col("rep")), num, den)
    links = tile_links(placed, segments(lists, pivots(lists)), num, den)
    return links.groupBy("node").agg(F.sum("n").alias("n_links")), common.components(links, "node", "root")


def connecting_links(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """all_links() where n_links doesn't matter. First each prefix shingle proposes its classes to one hub, as many pairs as they are; tiles compare only what that has not connected."""
    lists = ordered_lists(classes, num, den)
    parts = common.stored(segments(lists, pivots(lists)), "jaccard-segments")
    prefix = prefixes(lists, num, den)
    hub = prefix.groupBy("h").agg(F.min(F.struct("rep", "n", "pos")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "hub.*")
    first = prefix.alias("r").join(hub.alias("l"), F.col("l.h") == F.col("r.h")).where(F.col("l.rep") < F.col("r.rep")).where(can_link(num, den))
    side = heads(lists)
    first = first.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct().join(side.alias("l"), F.col("a") == F.col("l.rep")).join(side.alias("r"), F.col("b") == F.col("r.rep"))
    links = overlaps(first.where(in_reach(num, den)).select("a", "b"), parts, num, den)
    labels = common.components(links)
    named = common.stored(prefix.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "jaccard-named")
    rest = tile_links(tiles(named, num, den), parts, num, den)
    labels = common.components(links.unionByName(rest.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return labels.select("node", F.lit(1).alias("n_links")), labels


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row: documents link when den * overlap >= num * union of their k-word shingle sets.

    n_links counts the other sets that the row's set links with. All pairs of a
    tile are compared at once, so a hot group of near copies costs rows in proportion
    to its classes and tiles, and arithmetic in proportion to its pairs.
    """
    return _joined(docs, k, num, den, all_links).drop("sha", "component")


def connected(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """join() without n_links."""
    return join(docs, k, num, den).drop("n_links")


def _joined(docs: DataFrame, k: int, num: int, den: int, find) -> DataFrame:
    """doc_id, sha, n_shingles, component_id, n_links, component (null for a row that is alone) of every row."""
    with common.scratch(docs.sparkSession) as keep:
        sets, verdicts = _verdicts(docs, k, num, den, find)
        keep(sets, verdicts)
    out = common.join_verdicts(sets, verdicts, "digest", "rows", sets.count())
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "sha", "n_shingles", own.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component")


def _verdicts(docs: DataFrame, k: int, num: int, den: int, find) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (doc_id, sha, n_shingles, digest), and a verdict for each digest that several rows have or that links; both stored."""
    sets = common.stored(shared_shingles(docs, k, num, den), "jaccard-sets")
    members = sets.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("shared", ignorenulls=True).alias("shared")).where("n > 0")
    # A class is named by its smallest doc_id; without one, or where two share it, by its digest, below any id.
    first = F.row_number().over(Window.partitionBy("rep", F.when(F.col("rep").isNull(), F.col("digest"))).orderBy("digest")) == 1
    node = F.when(first & F.col("rep").isNotNull(), F.col("rep")).otherwise(-1 - F.abs(F.xxhash64("digest")))
    classes = common.stored(members.where("shared IS NOT NULL").withColumn("node", node), "jaccard-classes")
    n_links, labels = find(classes.select(F.col("node").alias("rep"), "n", "shared"), num, den)
    linked = classes.select("digest", "rep", "node").join(labels, "node").join(n_links, "node", "left")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = linked.join(smallest, "component").select("digest", "component", "component_id", "n_links")
    verdicts = members.select("digest", "rows", "rep").join(found, "digest", "left")
    named = F.coalesce(F.col("component").cast("string"), F.hex("digest"))
    verdicts = verdicts.select("digest", "rows", named.alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return common.stored(sets.drop("shared"), "jaccard-slim"), common.stored(verdicts.where("rows > 1 OR n_links > 0"), "jaccard-verdicts")


def keep_one(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row of docs of each component: that with its smallest doc_id (null comes last), of rows that tie the one with the first digest of its text."""
    with common.scratch(docs.sparkSession) as keep:
        found = common.stored(_joined(docs, k, num, den, connecting_links).where("component IS NOT NULL").select("doc_id", "sha", "component"), "jaccard-rows")
        order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("sha"))
        best = common.stored(found.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")), "jaccard-best")
        rows = common.join_verdicts(found.groupBy("component", "doc_id", "sha").agg(F.count(F.lit(1)).alias("n")), best, "component", "rows", found.count())
        stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sha") == F.col("best.sha"))
        acts = common.stored(rows.select(F.col("doc_id").alias("id"), "sha", stays.alias("stays"), "n").where("NOT stays OR n > 1").drop("n"), "jaccard-acts")
        keep(acts)
    return common.settle(docs, acts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def query_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s FROM w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rare AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1
), r AS (SELECT doc_id, s FROM s JOIN rare USING (s)
), able AS (SELECT doc_id, any_value(n.n) AS n FROM r JOIN n USING (doc_id) GROUP BY doc_id HAVING 100 * count(*) >= 90 * any_value(n.n)
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN able x ON a.doc_id = x.doc_id JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id JOIN able y ON b.doc_id = y.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

#: The same with the number of other sets that each row's set links with.
LINKS_ORACLE = ORACLE.replace("""), e AS (""", """), whole AS (SELECT doc_id, list(s ORDER BY s) AS g FROM s GROUP BY doc_id
), linked AS (SELECT l.a AS x, w.g FROM l JOIN whole w ON w.doc_id = l.b UNION ALL SELECT l.b, w.g FROM l JOIN whole w ON w.doc_id = l.a
), counted AS (SELECT x, count(DISTINCT linked.g) AS n_links FROM linked JOIN whole o ON o.doc_id = x WHERE linked.g <> o.g GROUP BY x
), e AS (""").replace("c.component_id\nFROM documents d", "c.component_id, coalesce(k.n_links, 0) AS n_links\nFROM documents d LEFT JOIN counted k ON k.x = d.doc_id")
