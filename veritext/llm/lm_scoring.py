"""LM scoring by cross-entropy difference.

A target and a background bigram model are matched: one vocabulary (every word of
the corpus), one order, one smoothing, and the background's counts scaled to the
target's number of tokens. Each token's loss under the target model less its loss
under the background model is averaged over a document; lower is nearer to the
target. What is counted grows with the corpus; nothing is broadcast or collected.

The input is stored in numbered slices. The labels' verdicts are joined to the
slices' doc_ids, and come back to the slices as one bit a document. A slice counts
its bigrams and words, in all its documents and in its target ones, sends the
counts to fragments of the hash range, and has the sums over all slices back. A
word goes with the times it ends a document, so that its count as a context is
known. The fragments also say how many words and tokens there are in all.

Target: documents with label quality 1. Background: all documents.

Defined cases: a null or empty text has no tokens and a null score; a null
doc_id is never target; a doc_id with several labels is target if any is 1; with an
empty target both models smooth to the same uniform one and scores are the
background's. Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and are told
apart by 64-bit hashes, bigrams by 48 bits and their fragment.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common, exchange

#: The weights of the bigram and unigram parts, as the bigram's; and what is added to each word's count.
BIGRAM, ADDED = 0.7, 0.1
#: Text bytes of a slice: larger ones repeat fewer bigrams.
SLICE_BYTES = 8 << 20
#: The word before a document's first; what sets the keys of bigrams and words apart; a multiplier for keys.
BEGIN, AS_PAIR, AS_WORD, SPREAD = (np.uint64(x) for x in (1, 2, 5, 0x9E3779B97F4A7C15))
#: Counts of a key: all, in target documents, and how often the word ends a document, all and target.
ROWS = 4


# --- what a slice counts -------------------------------------------------------

class Slice:
    """A slice's distinct bigrams and words: their keys, and the place of each token's bigram, context and word among them.

    The lowest bit of a key is 1 for words and 0 for bigrams and for BEGIN.
    """

    def __init__(self, body: bytes):
        self.ids, texts, _ = exchange.unpack(body)
        flat, self.counts = common.word_hashes(texts, common.LOWER_TABLE)
        self.of = np.repeat(np.arange(len(texts)), self.counts)
        words, now = np.unique(flat, return_inverse=True)
        k = len(words)
        some = self.counts > 0
        self.ends = np.cumsum(self.counts)[some] - 1
        last = np.concatenate([[k], now[:-1]])[: len(now)]
        last[self.ends - self.counts[some] + 1] = k
        pairs, pair = np.unique(last * (k + 1) + now, return_inverse=True)
        contexts = np.append(words, BEGIN)
        as_word = common.mix(common.mix(contexts + AS_WORD) * SPREAD)
        as_word[:k] |= np.uint64(1)
        as_word[k] &= ~np.uint64(1)
        as_pair = common.mix(common.mix(contexts[pairs // (k + 1)] + AS_PAIR) * SPREAD + contexts[pairs % (k + 1)]) & ~np.uint64(1)
        self.keys = np.concatenate([as_pair, as_word])
        self.pair, self.context, self.word = pair, len(pairs) + last, len(pairs) + now
        self.begin = len(self.keys) - 1

    def weights(self, target: np.ndarray) -> np.ndarray:
        """ROWS x keys. target: a boolean for each text."""
        out = np.zeros((ROWS, len(self.keys)), np.int64)
        for row, mine in enumerate((np.ones(len(self.of), bool), target[self.of])):
            out[row] = np.bincount(np.concatenate([self.pair[mine], self.word[mine]]), minlength=len(self.keys))
            ends = self.ends[mine[self.ends]]
            out[row, self.begin] = len(ends)
            out[row + 2] = np.bincount(self.word[ends], minlength=len(self.keys))
        return out


def fragment_stats(values: np.ndarray, sums: np.ndarray) -> bytes:
    """A fragment's distinct words, tokens, and tokens of the target."""
    words = (values & np.uint64(1)).astype(bool)
    return struct.pack("<qqq", int(words.sum()), int(sums[0, words].sum()), int(sums[1, words].sum()))


# --- models --------------------------------------------------------------------

def losses(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n_words: int, total: int, size: int) -> np.ndarray:
    """-log p(word | context) from counts among `total` tokens, scaled to `size` tokens: bigrams interpolated with unigrams of added counts."""
    single = (word * (size / total if total else 0.0) + ADDED) / ((size if total else 0) + ADDED * (n_words + 2))
    return -np.log(np.where(context > 0, BIGRAM * pair / np.maximum(context, 1) + (1 - BIGRAM) * single, single))


def target_bits(slices: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, fragment, body): for each slice that has target documents, a bit for each of its documents."""
    ids = "source bigint, slot int, doc_id bigint"

    def named(source: int, body: bytes) -> pa.RecordBatch:
        own = exchange.unpack(body)[0]
        return pa.RecordBatch.from_arrays([pa.array([source] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.int64())], ["source", "slot", "doc_id"])

    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    slots = slices.select("source", "body").mapInArrow(exchange.each_slice(named), ids).where("doc_id IS NOT NULL").join(good, "doc_id", "left_semi")

    def gathered(group: pa.Table) -> pa.Table:
        slot = group.column("slot").to_numpy()
        bits = np.zeros(int(slot.max()) + 1, bool)
        bits[slot] = True
        return pa.table({"source": group.column("source").slice(0, 1), "fragment": pa.array([0], pa.int64()), "body": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return slots.select("source", "slot").groupBy("source").applyInArrow(gathered, exchange.SQL)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of docs: losses a token under the models, and their difference."""
    slices = exchange.slices(docs, "lm-slices", SLICE_BYTES)
    deal = exchange.Deal.of(slices, 1 / 4)
    kind = exchange.Counts(ROWS, fragment_stats)

    def dealt(cut: Slice) -> exchange.Dealt:
        return exchange.Dealt(deal, cut.keys, kind, 48)

    def send(source: int, body: bytes, bits: dict[int, bytes]) -> pa.Table:
        cut = Slice(body)
        target = np.zeros(len(cut.ids), bool)
        if bits:
            found = np.unpackbits(np.frombuffer(bits[0], np.uint8))[: len(target)].astype(bool)
            target[: len(found)] = found
        return pa.Table.from_batches([dealt(cut).rows(source, cut.weights(target))])

    sent = exchange.at_slices(slices, target_bits(slices, labels), send, exchange.SQL)
    replies = common.stored(exchange.exchange(sent, deal, kind), "lm-counts", compression="none")
    del sent
    common.release(docs.sparkSession)
    told = replies.where("source = -1").select("body").toArrow().column("body").to_pylist()
    n_words, n_tokens, n_target = (sum(x) for x in zip((0, 0, 0), *[struct.unpack("<qqq", b) for b in told], strict=True))
    size = n_target or n_tokens

    def finish(source: int, body: bytes, found: dict[int, bytes]) -> pa.Table:
        cut = Slice(body)
        sums = dealt(cut).sums(found)
        n, mean = cut.counts, []
        for row, total in ((0, n_tokens), (1, n_target)):
            context = sums[row] - sums[row + 2]
            each = losses(sums[row, cut.pair], context[cut.context], sums[row, cut.word], n_words, total, size)
            mean.append(np.bincount(cut.of, each, len(n)) / np.maximum(n, 1))
        return pa.table({"doc_id": pa.array(cut.ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "background_loss": pa.array(mean[0], mask=n == 0), "target_loss": pa.array(mean[1], mask=n == 0)})

    out = exchange.at_slices(slices, replies, finish, "doc_id bigint, n_tokens bigint, background_loss double, target_loss double")
    return out.select("doc_id", "n_tokens", F.round("target_loss", 4).alias("target_loss"), F.round("background_loss", 4).alias("background_loss"), F.round(F.col("target_loss") - F.col("background_loss"), 4).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target FROM documents
), t AS (SELECT r, target, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(i)
), v AS (SELECT word, row_number() OVER (ORDER BY word) AS k FROM t GROUP BY word
), size AS (SELECT count(*) + 2 AS s FROM v
), ids AS (SELECT r, target, i, k AS now FROM t JOIN v USING (word)
), pairs AS (SELECT r, target, now, coalesce(lag(now) OVER (PARTITION BY r ORDER BY i), (SELECT s - 1 FROM size)) AS before FROM ids
), c AS (SELECT before, now, CAST(count(*) AS DOUBLE) AS b, CAST(count(*) FILTER (target) AS DOUBLE) AS a FROM pairs GROUP BY 1, 2
), n AS (SELECT sum(a) AS a, sum(b) AS b, CASE WHEN sum(a) > 0 THEN sum(a) ELSE sum(b) END AS m FROM c
), sc AS (SELECT before, now, CASE WHEN n.a > 0 THEN c.a * n.m / n.a ELSE 0 END AS a, c.b * n.m / n.b AS b FROM c, n
), one AS (SELECT now, sum(a) + {ADDED} AS a, sum(b) + {ADDED} AS b FROM sc GROUP BY now
), whole AS (SELECT (SELECT sum(a) FROM sc) + {ADDED} * s AS a, (SELECT sum(b) FROM sc) + {ADDED} * s AS b FROM size
), ctx AS (SELECT before, sum(a) AS a, sum(b) AS b FROM sc GROUP BY before
), l AS (
  SELECT sc.before, sc.now,
    -ln(CASE WHEN ctx.a > 0 THEN {BIGRAM} * sc.a / ctx.a + {1 - BIGRAM} * one.a / whole.a ELSE one.a / whole.a END) AS la,
    -ln(CASE WHEN ctx.b > 0 THEN {BIGRAM} * sc.b / ctx.b + {1 - BIGRAM} * one.b / whole.b ELSE one.b / whole.b END) AS lb
  FROM sc JOIN one USING (now) JOIN ctx USING (before), whole
), s AS (SELECT r, count(*) AS n_tokens, avg(la) AS la, avg(lb) AS lb FROM pairs JOIN l USING (before, now) GROUP BY r)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(la, 4) AS target_loss, round(lb, 4) AS background_loss, round(la - lb, 4) AS score FROM w LEFT JOIN s USING (r)
"""
