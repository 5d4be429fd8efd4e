"""Substring dedup with difference-cover anchors.

With a difference cover modulo v, any two word positions i and j have a shift d
below v for which i + d and j + d both lie in the cover's residues. So two equal
windows of w words share an equal anchor of w - (v - 1) words that starts at a
cover position in both. Only anchors are hashed and exchanged first. A repeated
anchor then extends to the windows that hold it, and only these windows are
hashed (64 bits of another hash) and counted: windows are told apart by 64-bit
hashes, so results are exact but for their collisions. No pairs of documents are
made; a hot passage sends one value a slice.

Defined cases: a null or empty text has no words; texts shorter than a window
lose nothing. Rows that repeat are documents of their own, so copies remove each
other's windows wholly.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common, exchange

WINDOW = 35
#: A perfect difference cover: every difference modulo 21 is one of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
RESULT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"

BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of word sequences at any places of a flat array of word hashes."""

    def __init__(self, flat: np.ndarray, base: int):
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * common.powers(base, len(flat))[:-1], out=self.sums[1:])
        self.back = common.powers(pow(base, -1, 2**64), len(flat))

    def at(self, begin: np.ndarray, size: int) -> np.ndarray:
        return common.mix((self.sums[begin + size] - self.sums[begin]) * self.back[begin])


class Slice:
    """The words of a slice's texts: hashes in one array, and where each document's begin and end."""

    def __init__(self, body: bytes):
        self.ids, self.texts, _ = exchange.unpack(body)
        self.flat, self.counts = common.word_hashes(self.texts, common.PLAIN_TABLE)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts

    def room(self) -> np.ndarray:
        """Words from each place to its document's end."""
        return np.repeat(self.ends, self.counts) - np.arange(len(self.flat))

    def anchors(self, size: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
        """Places of the anchors: cover positions of each document with enough words after them."""
        place = np.arange(len(self.flat))
        within = place - np.repeat(self.begins, self.counts)
        return place[np.isin(within % period, cover) & (self.room() >= size)]


def candidate_starts(cut: Slice, hit: np.ndarray, window: int, size: int) -> np.ndarray:
    """Places of the windows that hold an anchor which was marked."""
    cover = np.zeros(len(cut.flat) + 1, np.int64)
    low = np.maximum(hit + size - window, np.repeat(cut.begins, cut.counts)[hit]) if len(hit) else hit
    np.add.at(cover, low, 1)
    np.add.at(cover, hit + 1, -1)
    return np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (cut.room() >= window))


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return np.cumsum(cover[:-1]) > 0


def results(cut: Slice, gone: np.ndarray, with_text: bool) -> pa.Table:
    out: list[tuple] = []
    for k, text in enumerate(cut.texts):
        g = gone[cut.begins[k] : cut.ends[k]]
        removed, words = int(g.sum()), text.split()
        kept = b" ".join(itertools.compress(words, (~g).tolist()) if removed else words)
        out.append((cut.ids[k], len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
    return pa.table([pa.array([r[i] for r in out], RESULT.field(i).type) for i in range(5)], schema=RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text of every document."""
    size = window - (period - 1)
    if size < 1 or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover must have every difference, and the window be as long as the period")
    slices = exchange.slices(docs, "substring-slices")
    to_anchors = exchange.Deal.of(slices, len(cover) / period / 6)
    to_windows = exchange.Deal.of(slices, 1 / 12)
    anchor_kind, window_kind = to_anchors.marks(32), to_windows.marks(64)

    def anchors_of(cut: Slice) -> tuple[np.ndarray, exchange.Dealt]:
        place = cut.anchors(size, period, cover)
        return place, exchange.Dealt(to_anchors, Rolling(cut.flat, BASE[0]).at(place, size), anchor_kind, 32)

    def windows_of(cut: Slice, replies: dict[int, bytes]) -> tuple[np.ndarray, exchange.Dealt]:
        place, dealt = anchors_of(cut)
        starts = candidate_starts(cut, place[dealt.sums(replies)[0] > 1], window, size)
        return starts, exchange.Dealt(to_windows, Rolling(cut.flat, BASE[1]).at(starts, window), window_kind, 64)

    def send_anchors(source: int, body: bytes) -> pa.RecordBatch:
        return anchors_of(Slice(body))[1].rows(source)

    def send_windows(source: int, body: bytes, replies: dict[int, bytes]) -> pa.Table:
        return pa.Table.from_batches([windows_of(Slice(body), replies)[1].rows(source)])

    def finish(source: int, body: bytes, replies: dict[int, bytes]) -> pa.Table:
        cut = Slice(body)
        starts, dealt = windows_of(cut, {f: x for f, x in replies.items() if f >= 0})
        hit = dealt.sums({-1 - f: x for f, x in replies.items() if f < 0})[0] > 1
        return results(cut, covered(len(cut.flat), starts[hit], window), with_text)

    # The replies about anchors are one bit for each, and needed twice.
    anchors = common.stored(exchange.exchange(slices.select("source", "body").mapInArrow(exchange.each_slice(send_anchors), exchange.SQL), to_anchors, anchor_kind), "substring-anchors")
    windows = exchange.exchange(exchange.at_slices(slices, anchors, send_windows, exchange.SQL), to_windows, window_kind)
    both = anchors.unionByName(windows.withColumn("fragment", -1 - F.col("fragment")))
    out = exchange.at_slices(slices, both, finish, RESULT_SQL)
    return out if with_text else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM w, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35
), rep AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, p FROM s JOIN rep USING (s), unnest(range(i, i + 35)) AS u(p)
), g AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""
