"""Exact dedup with a minimal perfect hash over historical distinct digests.

The index is dealt over buckets by digest. Each bucket has a minimal perfect hash
(levels of bit arrays, after the public BBHash scheme) and a slot for each digest
that holds the full 32 digest bytes, the winner's locator and the row count. A
lookup hashes to one slot and compares all digest bytes, so a digest that is not
in the index never matches. Rows of incoming data whose digest has no slot are
grouped among themselves.

Defined cases: a null text is empty, and equals other empty texts; of rows that
tie on the largest doc_id all have that keep_id, and each is kept; a null doc_id
wins only among nulls. An empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm import common

#: Distinct digests a bucket holds on average.
BUCKET_KEYS = 40_000
#: Bits of a level for each key that enters it.
GAMMA = 1.7

INDEX_SCHEMA = "bucket int, n_keys int, levels binary, digests binary, winners binary, unnamed binary, counts binary"


def build_levels(keys: np.ndarray, gamma: float = GAMMA) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct keys (n x 2 uint64): a key's level is the first where it is alone."""
    levels: list[np.ndarray] = []
    while len(keys):
        size = max(64, -(-int(gamma * len(keys)) // 64) * 64)
        at = slot_in_level(keys, len(levels), size)
        times = np.bincount(at, minlength=size)
        levels.append(times == 1)
        keys = keys[times[at] > 1]
        if len(levels) > 200:
            raise ValueError("keys aren't distinct")
    return levels


def slot_in_level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    return (common.mix(keys[:, 0] + seed) ^ keys[:, 1]) % np.uint64(size)


def slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key; -1 where no level claims it. A foreign key may get any slot: compare the slot's bytes."""
    out = np.full(len(keys), -1, np.int64)
    left, before = np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        at = slot_in_level(keys[left], i, len(bits)).astype(np.int64)
        rank = np.cumsum(bits) - 1
        hit = bits[at]
        out[left[hit]] = before + rank[at[hit]]
        left, before = left[~hit], before + int(bits.sum())
    return out


def pack_levels(levels: list[np.ndarray]) -> bytes:
    return b"".join(struct.pack("<I", len(x)) + np.packbits(x).tobytes() for x in levels)


def unpack_levels(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, n // 8, at + 4)).astype(bool))
        at += 4 + n // 8
    return out


def _keys(digests: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Digests as n x 32 bytes, and their first 16 bytes as n x 2 uint64."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    return raw, np.ascontiguousarray(raw[:, :16]).view("<u8")


def _build(group: pa.Table) -> pa.Table:
    raw, keys = _keys(group.column("digest"))
    levels = build_levels(keys)
    at = slots(keys, levels)
    order = np.argsort(at)
    winners = np.asarray(group.column("winner").fill_null(0).to_numpy(), np.int64)[order]
    unnamed = np.asarray(group.column("winner").is_null().to_numpy(), bool)[order]
    counts = np.asarray(group.column("n").to_numpy(), np.int64)[order]
    return pa.table({
        "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "n_keys": pa.array([len(raw)], pa.int32()),
        "levels": [pack_levels(levels)], "digests": [raw[order].tobytes()], "winners": [winners.tobytes()], "unnamed": [np.packbits(unnamed).tobytes()], "counts": [counts.tobytes()],
    })


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary) of the normalised whole text."""
    return common.documents(docs).select("doc_id", F.unhex(F.sha2(common.lower_ascii(F.col("text")), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row a distinct digest: its row count and largest doc_id, reduced on the map side first."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("winner"))


def _bucket(n_buckets: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 57, 8), 16, 10).cast("bigint"), F.lit(n_buckets)).cast("int").alias("bucket")


def build_index(groups: DataFrame, n_buckets: int) -> DataFrame:
    """The index of groups(digest, n, winner): one row a bucket."""
    return groups.select(_bucket(n_buckets), "digest", "n", "winner").groupBy("bucket").applyInArrow(_build, INDEX_SCHEMA)


def _probe(asked: pa.Table, index: pa.Table) -> pa.Table:
    n = asked.num_rows
    if not n:
        return pa.table({"digest": pa.array([], pa.binary()), "old_winner": pa.array([], pa.int64()), "old_n": pa.array([], pa.int64())})
    winner, count, member, unnamed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    if index.num_rows:
        row = {c: index.column(c)[0].as_py() for c in ("levels", "digests", "winners", "unnamed", "counts")}
        raw, keys = _keys(asked.column("digest"))
        at = slots(keys, unpack_levels(row["levels"]))
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        safe = np.maximum(at, 0)
        member = (at >= 0) & (stored[safe] == raw).all(axis=1)
        winner, count = np.frombuffer(row["winners"], np.int64)[safe], np.frombuffer(row["counts"], np.int64)[safe]
        unnamed = np.unpackbits(np.frombuffer(row["unnamed"], np.uint8), count=len(stored))[safe].astype(bool)
    return pa.table({
        "digest": asked.column("digest").combine_chunks(),
        "old_winner": pa.array(winner, pa.int64(), mask=~member | unnamed),
        "old_n": pa.array(np.where(member, count, 0), pa.int64()),
    })


def lookup(groups: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """(digest, old_winner, old_n) for each digest of groups: what the index's slot holds, or null and 0 for nonmembers."""
    asked = groups.select(_bucket(n_buckets), "digest")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_probe, "digest binary, old_winner bigint, old_n bigint")


def dedup(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Verdicts on every row of both: doc_id, keep_id, group_size, kept, text_sha256."""
    return verdicts(digest_rows(history).withColumn("old", F.lit(True)).unionByName(digest_rows(incoming).withColumn("old", F.lit(False))))


def verdicts(rows: DataFrame, *further: str) -> DataFrame:
    """Verdicts on rows(doc_id, digest, old), which are read once: doc_id, keep_id, group_size, kept, text_sha256, and further columns of rows.

    The distinct digests of old rows are indexed; the others' are looked up.
    Members join the group of their slot, all others form groups of their own.
    """
    with common.scratch(rows.sparkSession) as keep:
        rows = common.stored(rows, "dedup-digests")
        groups = common.stored(rows.groupBy("old", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("winner")), "dedup-groups")
        old, new = groups.where("old").drop("old"), groups.where("not old").drop("old")
        sizes = groups.agg(F.sum("n").alias("rows"), F.count_if("old").alias("keys")).first()
        n_buckets = max(1, -(-(sizes["keys"] or 0) // BUCKET_KEYS))
        index = common.stored(build_index(old, n_buckets), "dedup-index", compression="none")
        found = lookup(new, index, n_buckets)
        merged = new.join(found, "digest").select(
            "digest", (F.col("n") + F.col("old_n")).alias("group_size"), F.greatest("winner", "old_winner").alias("keep_id"), (F.col("old_n") > 0).alias("member"))
        # A group is the incoming one with what its slot held; of the history, what no member came for.
        untouched = old.join(merged.where("member").select("digest"), "digest", "left_anti").select(
            "digest", F.col("n").alias("group_size"), F.col("winner").alias("keep_id"), F.lit(False).alias("member"))
        several = common.stored(merged.unionByName(untouched).where("group_size > 1").drop("member"), "dedup-verdicts")
        keep(rows, several)
    out = common.join_verdicts(rows.drop("old"), several, "digest", "group_size", sizes["rows"] or 0)
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(single, True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *further,
    )


def is_history():
    """Which rows count as the history: those with an even doc_id, or with none. The others arrive. Both are used whole."""
    return F.coalesce(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit(True))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts, also where rows repeat whole."""
    own = common.documents(docs).select("doc_id", F.unhex(F.sha2(common.lower_ascii(F.col("text")), 256)).alias("digest"), common.text_digest().alias("sha"), is_history().alias("old"))
    with common.scratch(docs.sparkSession) as keep:
        found = common.stored(verdicts(own, "sha").where("group_size > 1"), "dedup-rows")
        gone = found.where("NOT kept").select(F.col("doc_id").alias("id"), "sha", F.lit(False).alias("stays")).distinct()
        # Rows that share the largest doc_id and differ in case only: the first by digest stays, once.
        last = found.where("kept").groupBy("text_sha256", "doc_id", "sha").agg(F.count(F.lit(1)).alias("n"))
        stays = F.col("sha") == F.min("sha").over(Window.partitionBy("text_sha256"))
        more = last.withColumn("stays", stays).where("NOT stays OR n > 1").select(F.col("doc_id").alias("id"), "sha", "stays")
        acts = common.stored(gone.unionByName(more), "dedup-acts")
        keep(acts)
    return common.settle(docs, acts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(digest_rows(common.table(spark, sf_dir, "documents")).withColumn("old", is_history()))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
