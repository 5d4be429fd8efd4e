"""Benchmark decontamination with a distributed positional inverted index.

The index is dealt by document: each shard (some megabytes of text) holds, for
every word of its texts, the sorted positions where they have it. It is built once
and stored; no posting is shuffled. The test items come in blocks of BLOCK_BYTES,
one after another: a block's windows are a broadcast of some ten times its bytes,
and so is what the driver holds, whatever the benchmark's size. A search orders
each window's terms by their number of postings in the whole corpus, and
intersects the offset-adjusted posting lists from the rarest term on, which gives
the exact phrase matches. Proximity matches, stretches of at most NEAR windows'
words in a document with all words of a window in any order, go by the same lists
from the rarest term on, with ranges in place of offsets.

Defined cases: a null or empty text has no words, and no items occur in it; an
item without words has no windows; an item with fewer words than a window is one
window; items that share an id count once; a null item_id is the empty string; an
empty benchmark hits nothing. Words are compared by 64-bit hashes, so results are
exact but for collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common
from veritext.llm.exchange import squeeze, stretch

#: Words of a window; windows that a proximity match may stretch over.
WINDOW, NEAR = 10, 2
#: Text bytes of the items in a block; posting entries that a search follows at once.
BLOCK_BYTES, MOST_ENTRIES = 4 << 20, 2_000_000

INDEX_SCHEMA = "shard bigint, doc_ids array<bigint>, shas array<string>, n_words array<bigint>, terms binary, sizes binary, positions binary"
HITS = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
HITS_SQL = "shard bigint, slot int, spans array<bigint>, items array<string>, near array<string>"


# --- index -------------------------------------------------------------------

def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard: the documents' ids, text digests and word counts, and the postings of all words.

    Positions count the shard's words, with one more between documents.
    """

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = common.task_key()
        for part, texts in common.text_chunks(batches):
            flat, counts = common.word_hashes(texts, common.ALNUM_TABLE)
            at = np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(flat, kind="stable")
            terms, first = np.unique(flat[order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key()], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("sha").to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([squeeze(np.diff(terms, prepend=np.uint64(0)))], pa.binary()), pa.array([squeeze(np.diff(first, append=len(flat)).astype("<u4"))], pa.binary()), pa.array([squeeze(at[order].astype("<u4"))], pa.binary())],
                ["shard", "doc_ids", "shas", "n_words", "terms", "sizes", "positions"])

    rows = common.documents(docs).withColumn("sha", common.text_digest())
    return common.stored(rows.mapInArrow(run, INDEX_SCHEMA), "positional-index", compression="none")


class Postings:
    """A shard's lists, and where its documents begin and end."""

    def __init__(self, row: dict):
        self.shard = row["shard"]
        self.terms = np.cumsum(stretch(row["terms"], "<u8"), dtype=np.uint64)
        self.sizes = stretch(row["sizes"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.positions = stretch(row["positions"], "<u4").astype(np.int64)
        self.counts = np.asarray(row["n_words"], np.int64)
        self.begins = np.cumsum(self.counts + 1) - (self.counts + 1)
        #: Ascending: term and position in one number.
        self.keys = (np.repeat(np.arange(len(self.terms), dtype=np.int64), self.sizes) << 32) | self.positions

    def local(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term here; -1 for others."""
        spot = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[spot] == terms, spot, -1) if len(self.terms) else np.full(len(terms), -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, "right") - 1

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def has_in(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands in [low, high)."""
        return np.searchsorted(self.keys, (term << 32) | low) < np.searchsorted(self.keys, (term << 32) | high)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Postings of each of terms (sorted hashes of a block) in the whole corpus."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for t, s in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                known = np.cumsum(stretch(t, "<u8"), dtype=np.uint64)
                if len(known):
                    spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                    total += np.where(known[spot] == asked, stretch(s, "<u4")[spot], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["i", "n"])

    found = index.select("terms", "sizes").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    out = np.zeros(len(terms), np.int64)
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


# --- queries -----------------------------------------------------------------

class Windows:
    """The windows of a block of items, by length: each one's item, its terms' numbers, and its offsets from the rarest term to the most frequent."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        flat, counts = common.word_hashes([t for _, t in items], common.ALNUM_TABLE)
        self.terms, flat = np.unique(flat, return_inverse=True)
        by_length: dict[int, list] = {}
        for (item, _), words in zip(items, np.split(flat.astype(np.int32), np.cumsum(counts)[:-1]), strict=True):
            if len(words):
                size = min(window, len(words))
                by_length.setdefault(size, []).append((number[item], np.lib.stride_tricks.sliding_window_view(words, size)))
        self.groups = [(size, np.concatenate([np.full(len(w), i, np.int32) for i, w in found]), np.concatenate([w for _, w in found]), None) for size, found in sorted(by_length.items())]

    def order(self, n: np.ndarray) -> None:
        """Orders the offsets by the corpus counts n of the terms. Windows with a term that the corpus lacks go."""
        ordered = []
        for size, item, w, _ in self.groups:
            live = n[w].min(axis=1) > 0
            ordered.append((size, item[live], w[live], np.argsort(n[w[live]], axis=1, kind="stable").astype(np.int16)))
        self.groups = ordered


def rare_entries(asked: Windows, lists: Postings) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, item, terms in order of rarity, their offsets, position) for each posting of each window's rarest term, at most MOST_ENTRIES and one window's at once."""
    local = lists.local(asked.terms)
    for size, item, w, order in asked.groups:
        live = np.flatnonzero((local[w] >= 0).all(axis=1))
        terms = np.take_along_axis(local[w[live]], order[live].astype(np.int64), axis=1)
        n = lists.sizes[terms[:, 0]]
        part = np.cumsum(n) // MOST_ENTRIES
        for rows in np.split(np.arange(len(live)), np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                m = n[rows]
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                row = np.repeat(rows, m)
                yield size, item[live][row], terms[row], order[live][row], lists.positions[np.repeat(lists.starts[terms[rows, 0]], m) + within]


def phrases(asked: Windows, lists: Postings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, items, positions) where windows occur: offset-adjusted lists, intersected from the rarest term on."""
    for size, item, terms, order, position in rare_entries(asked, lists):
        begin = position - order[:, 0]
        live = np.flatnonzero(begin >= 0)
        for k in range(1, size):
            live = live[lists.has(terms[live, k], begin[live] + order[live, k])]
        yield size, item[live], begin[live]


def near(asked: Windows, lists: Postings, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, items) where at most `span` consecutive words of a document hold all words of a window, in any order."""
    for size, item, terms, _, position in rare_entries(asked, lists):
        doc = lists.document(position)
        low, high = lists.begins[doc], lists.begins[doc] + lists.counts[doc]
        live = np.arange(len(position))
        for k in range(1, size):
            live = live[lists.has_in(terms[live, k], np.maximum(low[live], position[live] - span + 1), np.minimum(high[live], position[live] + span))]
        for shift in range(span):
            begin = position[live] - shift
            good = begin >= low[live]
            for k in range(1, size):
                good[good] = lists.has_in(terms[live[good], k], begin[good], np.minimum(high[live[good]], begin[good] + span))
            # A stretch that the document's begin cuts off is part of the one from there.
            yield doc[live[good]], item[live[good]]
            live = live[~good]


def search(index: DataFrame, asked: Windows, span: int | None) -> DataFrame:
    """HITS_SQL of the documents that a block hits: hit words as begin and end pairs, items with occurring windows, and, where span is given, items with proximity matches. Stored."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield shard_hits(sent.value, Postings(batch.slice(k, 1).to_pylist()[0]), span)

    out = common.stored(index.select("shard", "n_words", "terms", "sizes", "positions").mapInArrow(run, HITS_SQL), "positional-hits")
    sent.destroy()
    return out


def shard_hits(asked: Windows, lists: Postings, span: int | None) -> pa.RecordBatch:
    cover, found, close = np.zeros(int((lists.counts + 1).sum()) + 1, np.int64), [], []
    for size, item, begin in phrases(asked, lists):
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size, -1)
        found.append(np.unique(np.stack([lists.document(begin), item], 1), axis=0))
    if span is not None:
        close = [np.unique(np.stack(x, 1), axis=0) for x in near(asked, lists, span)]
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    rows: dict[int, tuple[list, list, list]] = {}
    for d, b, e in zip(lists.document(begin).tolist(), begin.tolist(), end.tolist(), strict=True):
        rows.setdefault(d, ([], [], []))[0].extend([b - int(lists.begins[d]), e - int(lists.begins[d])])
    for at, pairs in ((1, found), (2, close)):
        for d, i in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
            rows.setdefault(d, ([], [], []))[at].append(asked.items[i])
    columns = [[lists.shard] * len(rows), list(rows), *[[r[k] for r in rows.values()] for k in range(3)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, HITS, strict=True)], schema=HITS)


@common.kernel
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the spans that several blocks found in a document."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            spans: list[int] = []
            for b, e in sorted(zip(r["spans"][::2], r["spans"][1::2], strict=True)):
                if spans and b <= spans[-1]:
                    spans[-1] = max(spans[-1], e)
                else:
                    spans += [b, e]
            r["spans"] = spans
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_BYTES, of which the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for k in range(n):
        if items := rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect():
            yield [(r["item_id"], r["text"].encode()) for r in items]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """(doc_id, sha, n_words, spans, items, near) of every document: the words that lie in an occurrence of an item's window, the items that occur, and those with proximity matches within `span` words (none if it's null)."""
    spark = docs.sparkSession
    with common.scratch(spark) as keep:
        index = build_index(docs)
        rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "shas", "n_words")).alias("slot", "d")).select("shard", "slot", F.col("d.doc_ids").alias("doc_id"), F.col("d.shas").alias("sha"), F.col("d.n_words").alias("n_words"))
        rows = common.stored(rows, "positional-documents")
        hits = spark.createDataFrame([], HITS_SQL)
        for items in blocks(benchmark):
            asked = Windows(items, window)
            asked.order(term_counts(index, asked.terms))
            found = search(index, asked, span)
            keep(found)
            hits = hits.unionByName(found)
        keep(rows)
    together = hits.groupBy("shard", "slot").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
    together = together.withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("items", "near")}).mapInArrow(_united, HITS_SQL)
    none = {"spans": "array<bigint>", "items": "array<string>", "near": "array<string>"}
    return rows.join(together, ["shard", "slot"], "left").select("doc_id", "sha", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, without a hit word."""
    with common.scratch(docs.sparkSession) as keep:
        hit = find(docs, benchmark, window).where(F.size("items") > 0)
        acts = common.stored(hit.select(F.col("doc_id").alias("id"), "sha", F.lit(False).alias("stays")).distinct(), "positional-acts")
        keep(acts)
    return common.settle(docs, acts)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near").cast("bigint").alias("n_near"))


# --- proximity of given phrases ------------------------------------------------

def proximity(docs: DataFrame, asked: list[str], span: int) -> DataFrame:
    """(doc_id, phrase, begin, end): the shortest stretches of at most `span` words that hold all words of a phrase, in any order.

    Of stretches that lie within each other the inner one is returned. asked is
    a stated list of bounded size.
    """
    named = [(p, np.unique(common.word_hashes([p.encode()], common.ALNUM_TABLE)[0])) for p in asked]
    index = build_index(docs)
    sent = docs.sparkSession.sparkContext.broadcast([(p, t) for p, t in named if len(t)])

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists, rows = Postings(row), []
                for phrase, terms in sent.value:
                    local = lists.local(terms)
                    if (local >= 0).all():
                        for b, e in stretches([lists.positions[lists.starts[t] : lists.starts[t] + lists.sizes[t]] for t in local], span):
                            d = int(lists.document(np.array([b]))[0])
                            if e <= lists.begins[d] + lists.counts[d]:
                                rows.append((row["doc_ids"][d], phrase, b - int(lists.begins[d]), e - int(lists.begins[d])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "phrase", "begin", "end"])

    return index.mapInArrow(run, "doc_id bigint, phrase string, begin bigint, end bigint")


def stretches(lists: list[np.ndarray], span: int) -> list[tuple[int, int]]:
    """Minimal stretches [begin, end) of at most span positions that hold a member of every list, started from the shortest list."""
    rare = min(range(len(lists)), key=lambda k: len(lists[k]))
    near = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)] for p in lists[rare].tolist() for x in lists]
    if not near:
        return []
    n = len(lists)
    points = sorted({(int(v), k % n) for k, x in enumerate(near) for v in x})
    last, out = {}, []
    for v, k in points:
        last[k] = v
        if len(last) == n:
            b = min(last.values())
            if v + 1 - b <= span and (not out or out[-1][0] != b):
                out.append((b, v + 1))
    return [s for s, following in zip(out, [*out[1:], (None, None)]) if following[1] != s[1]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), span=NEAR * WINDOW))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM bw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM win
), spots AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size
), occ AS (SELECT doc_id, item_id, size, i FROM spots JOIN win USING (size, s)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM occ, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id
), it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM occ GROUP BY doc_id
), pos AS (SELECT doc_id, u.p, w[u.p] AS word FROM dw, unnest(range(1, len(w) + 1)) AS u(p)
), df AS (SELECT word, count(*) AS df FROM pos GROUP BY word
), wid AS (SELECT item_id, s, row_number() OVER () AS k FROM win
), wt AS (SELECT DISTINCT k, item_id, unnest(string_split(s, ' ')) AS word FROM wid
), wk AS (SELECT k, any_value(item_id) AS item_id, count(*) AS size, arg_min(word, (coalesce(df, 0), word)) AS rare FROM wt LEFT JOIN df USING (word) GROUP BY k HAVING min(coalesce(df, 0)) > 0
), cand AS (SELECT wk.k, pos.doc_id, pos.p FROM wk JOIN pos ON pos.word = wk.rare
), around AS (SELECT cand.k, cand.doc_id, cand.p, wt.word, list(pos.p) AS ps FROM cand JOIN wt USING (k) JOIN pos ON pos.doc_id = cand.doc_id AND pos.word = wt.word AND pos.p BETWEEN cand.p - 19 AND cand.p + 19 GROUP BY ALL
), kept AS (SELECT k, doc_id, p, list(ps) AS lists FROM around JOIN wk USING (k) GROUP BY k, doc_id, p HAVING count(*) = any_value(size)
), close AS (SELECT DISTINCT kept.doc_id, wk.item_id FROM kept JOIN wk USING (k), unnest(range(p - 19, p + 1)) AS u(b) WHERE len(list_filter(lists, lambda l: len(list_filter(l, lambda x: x BETWEEN b AND b + 19)) > 0)) = wk.size
), nr AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM close GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(nr.n, 0) AS n_near
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
