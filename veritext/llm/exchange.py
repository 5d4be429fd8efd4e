"""What hashed features sum to over all places that hold them, by one packed exchange.

slices() stores the input once, in numbered slices of some megabytes of text, and
all further steps go by the slices' numbers: a task that is run again reads the
same slices, in whatever order.

A slice deals its distinct features over fragments of the hash range and sends
each fragment one row with the sorted values and their weights, so a feature that
a third of all rows share costs one value a slice. A fragment's task sums the
weights of equal values and replies to each slice in the order that the slice
sent, so a slice that makes its features anew needs no more than the replies.

Fragments have about FRAGMENT_FEATURES features at any input size. A slice sends
rows to at most WIDTH fragments. With more fragments than that, rows go to WIDTH
coarse fragments first, where a group is one block of about WIDTH slices; the
block sums its slices' values and is then itself a sender to the coarse
fragment's fine ones. So a slice's rows don't grow with the input, nor a group.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm import common

#: Features that a fragment's task gets on average; fragments that one sender sends to, and slices of a block.
FRAGMENT_FEATURES, WIDTH = 1_500_000, 4096

SLICE_SQL = "source bigint, n_bytes bigint, body binary"
SQL = "source bigint, fragment bigint, body binary"
ARROW = pa.schema([("source", pa.int64()), ("fragment", pa.int64()), ("body", pa.binary())])


# --- slices --------------------------------------------------------------------

def pack(ids: list, texts: list[bytes], extra: bytes = b"") -> bytes:
    """A slice, compressed: ids with null marks, texts, and further bytes."""
    n = len(ids)
    head = struct.pack("<III", n, len(texts), len(extra)) + np.array([i is None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, extra, *texts]))


def unpack(data: bytes) -> tuple[list, list[bytes], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m, more = struct.unpack_from("<III", raw)
    at = 12
    null = np.frombuffer(raw, np.uint8, n, at)
    ids = np.frombuffer(raw, "<i8", n, at + n)
    sizes = np.frombuffer(raw, "<u4", m, at + 9 * n)
    at += 9 * n + 4 * m
    extra, at = raw[at : at + more], at + more
    ends = at + np.cumsum(sizes.astype(np.int64))
    return [None if z else int(i) for z, i in zip(null, ids, strict=True)], [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], extra


def slices(docs: DataFrame, name: str, most: int = common.CHUNK_BYTES) -> DataFrame:
    """(source, n_bytes, body): the rows of docs(doc_id, text) in packed slices of about `most` text bytes, stored."""

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, size = common.task_key(), [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key()], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(ids, texts)], pa.binary())], ["source", "n_bytes", "body"])

        for part, found in common.text_chunks(batches, most):
            more = sum(map(len, found))
            if ids and size + more > most:
                yield done()
                ids, texts, size = [], [], 0
            ids, texts, size = ids + part.column("doc_id").to_pylist(), texts + found, size + more
        if ids:
            yield done()

    return common.stored(common.documents(docs).mapInArrow(run, SLICE_SQL), name, compression="none")


def each_slice(make: Callable[[int, bytes], pa.RecordBatch]) -> Callable:
    """A kernel over slices: make(source, body) gives a slice's rows."""

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield make(batch.column("source")[k].as_py(), batch.column("body")[k].as_py())

    return run


def at_slices(cut: DataFrame, answers: DataFrame, make: Callable[[int, bytes, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """make(source, body, {fragment: reply}) of each slice with what was answered to it."""

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        replies = dict(zip(found.column("fragment").to_pylist(), found.column("body").to_pylist(), strict=True))
        out = make(mine.column("source")[0].as_py(), mine.column("body")[0].as_py(), replies)
        common.tidy()
        return out

    return cut.select("source", "body").groupBy("source").cogroup(answers.where("source >= 0").groupBy("source")).applyInArrow(run, schema)


# --- values and weights ----------------------------------------------------------

def squeeze(x: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes())


def stretch(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(dtype).ravel()


class Marks:
    """Whether a value occurs more than once: a bit of weight goes with each value, and a bit comes back."""

    rows, stats = 1, None

    def __init__(self, dtype: str):
        self.dtype = dtype

    def pack(self, values: np.ndarray, weights: np.ndarray) -> bytes:
        return struct.pack("<I", len(values)) + values.astype(self.dtype).tobytes() + np.packbits(weights[0] > 1).tobytes()

    def unpack(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        (n,) = struct.unpack_from("<I", body)
        values = np.frombuffer(body, self.dtype, n, 4)
        return values.astype(np.uint64), 1 + np.unpackbits(np.frombuffer(body, np.uint8, offset=4 + values.nbytes), count=n).astype(np.int64)[None]

    def reply(self, sums: np.ndarray) -> bytes:
        return np.packbits(sums[0] > 1).tobytes()

    def read(self, reply: bytes, n: int) -> np.ndarray:
        return 1 + np.unpackbits(np.frombuffer(reply, np.uint8), count=n).astype(np.int64)[None]


class Counts:
    """Sums of `rows` counts for each value. stats(values, sums), if given, makes bytes of each fragment that come back under source -1."""

    def __init__(self, rows: int, stats: Callable[[np.ndarray, np.ndarray], bytes] | None = None):
        self.rows, self.stats = rows, stats

    def pack(self, values: np.ndarray, weights: np.ndarray) -> bytes:
        steps = squeeze(np.diff(values, prepend=np.uint64(0)).astype("<u8"))
        return struct.pack("<I", len(steps)) + steps + self.reply(weights)

    def unpack(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        (n,) = struct.unpack_from("<I", body)
        values = np.cumsum(stretch(body[4 : 4 + n], "<u8"), dtype=np.uint64)
        return values, self.read(body[4 + n :], len(values))

    def reply(self, sums: np.ndarray) -> bytes:
        return squeeze(sums.ravel().astype("<i8"))

    def read(self, reply: bytes, n: int) -> np.ndarray:
        return stretch(reply, "<i8").reshape(self.rows, n)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct values, their summed weights, each part's places among them) of parts of (values, weights)."""
    flat, weights = np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts], axis=1)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(flat) else np.zeros(0, np.int64)
    at = np.empty(len(flat), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(flat))))
    sums = np.add.reduceat(weights[:, order], first, axis=1) if len(first) else weights
    return ordered[first], sums, np.split(at, np.cumsum([len(v) for v, _ in parts])[:-1])


# --- the exchange ------------------------------------------------------------------

class Deal:
    """How features (64-bit hashes) are dealt: n fragments, of which at most WIDTH are sent to directly."""

    def __init__(self, features: float, n_slices: int = 0):
        self.n = max(8, int(-(-features // FRAGMENT_FEATURES)))
        self.direct = min(self.n, WIDTH)
        self.blocks = max(1, -(-n_slices // WIDTH))

    @classmethod
    def of(cls, cut: DataFrame, each_byte: float) -> Deal:
        """For slices that hold `each_byte` features a text byte."""
        size = cut.agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")).first()
        return cls((size["n_bytes"] or 0) * each_byte, size["n"])

    def marks(self, bits: int) -> Marks:
        """Marks of features that `bits` of their hash tell apart in a fragment."""
        return Marks("<u4" if bits == 32 and not self.two_levels else "<u8")

    @property
    def two_levels(self) -> bool:
        return self.n > self.direct

    def fragment(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)) % np.uint64(self.n)

    def split(self, values: np.ndarray, fragment: np.ndarray, n: int) -> list[np.ndarray]:
        """Index arrays of the values of each of n fragments, each in ascending order of value."""
        order = np.lexsort((values, fragment))
        return np.split(order, np.searchsorted(fragment[order], np.arange(1, n)))


class Dealt:
    """A slice's features as they are sent, and as the replies come back."""

    def __init__(self, deal: Deal, hashes: np.ndarray, kind: Marks | Counts, narrow: int):
        """narrow: the bits of a hash that tell features of a fragment apart."""
        self.kind, self.size = kind, len(hashes)
        fragment = deal.fragment(hashes)
        # What is sent to a coarse fragment must hold the bits that its fine ones are dealt by.
        values = hashes if deal.two_levels else hashes & np.uint64((1 << narrow) - 1)
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for f, idx in enumerate(deal.split(values, fragment % np.uint64(deal.direct), deal.direct)):
            if len(idx):
                v = values[idx]
                first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                self.parts.append((f, v[first], first, idx))

    def rows(self, source: int, weights: np.ndarray | None = None) -> pa.RecordBatch:
        """A slice's rows. weights: rows x features; None: 1 for each feature."""
        bodies = []
        for _, v, first, idx in self.parts:
            w = np.diff(np.append(first, len(idx)))[None] if weights is None else np.add.reduceat(weights[:, idx], first, axis=1)
            bodies.append(self.kind.pack(v, w))
        return pa.RecordBatch.from_arrays([pa.array([source] * len(bodies), pa.int64()), pa.array([p[0] for p in self.parts], pa.int64()), pa.array(bodies, pa.binary())], schema=ARROW)

    def sums(self, replies: dict[int, bytes]) -> np.ndarray:
        """rows x features: the sums over all slices."""
        out = np.zeros((self.kind.rows, self.size), np.int64)
        for f, v, first, idx in self.parts:
            if f not in replies:
                raise ValueError("a fragment's reply is missing")
            out[:, idx] = np.repeat(self.kind.read(replies[f], len(v)), np.diff(np.append(first, len(idx))), axis=1)
        return out


def exchange(sent: DataFrame, deal: Deal, kind: Marks | Counts) -> DataFrame:
    """(source, fragment, reply as body) for each row that slices sent."""
    if not deal.two_levels:
        return sent.groupBy("fragment").applyInArrow(_at_fragment(kind), SQL)
    sent = common.stored(sent, "exchange-sent", compression="none")
    block = (F.col("fragment") * deal.blocks + F.pmod(F.xxhash64("source"), F.lit(deal.blocks))).alias("block")
    blocked = sent.select(block, "source", "fragment", "body")

    def forward(group: pa.Table) -> pa.Table:
        values, sums, _ = summed([kind.unpack(b) for b in group.column("body").to_pylist()])
        fine = deal.fragment(values)
        rows = []
        order = np.lexsort((values, fine))
        for idx in np.split(order, np.flatnonzero(np.diff(fine[order])) + 1):
            if len(idx):
                rows.append((int(fine[idx[0]]), kind.pack(values[idx], sums[:, idx])))
        return pa.table([pa.array([group.column("block")[0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=ARROW)

    def back(group: pa.Table, found: pa.Table) -> pa.Table:
        if not group.num_rows:
            return found.rename_columns(ARROW.names)
        values, _, places = summed([kind.unpack(b) for b in group.column("body").to_pylist()])
        sums = np.zeros((kind.rows, len(values)), np.int64)
        fine = deal.fragment(values)
        for f, reply in zip(found.column("fragment").to_pylist(), found.column("body").to_pylist(), strict=True):
            at = np.flatnonzero(fine == f)
            sums[:, at] = kind.read(reply, len(at))
        return pa.table([group.column("source"), group.column("fragment"), pa.array([kind.reply(sums[:, at]) for at in places], pa.binary())], schema=ARROW)

    fine = blocked.groupBy("block").applyInArrow(forward, SQL).groupBy("fragment").applyInArrow(_at_fragment(kind), SQL)
    return blocked.groupBy("block").cogroup(fine.withColumnRenamed("source", "block").groupBy("block")).applyInArrow(back, SQL)


def _at_fragment(kind: Marks | Counts) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        values, sums, places = summed([kind.unpack(b) for b in group.column("body").to_pylist()])
        out = pa.table([group.column("source"), group.column("fragment"), pa.array([kind.reply(sums[:, at]) for at in places], pa.binary())], schema=ARROW)
        if kind.stats is not None:
            out = pa.concat_tables([out, pa.table([pa.array([-1], pa.int64()), group.column("fragment").slice(0, 1), pa.array([kind.stats(values, sums)], pa.binary())], schema=ARROW)])
        common.tidy()
        return out

    return run
