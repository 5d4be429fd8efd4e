"""What the operators share: shared storage, text kernels, heavy-hitter joins and components.

Identifier columns may be null or repeated. Every operator treats a null text as
the empty text and keeps one output row per input row unless it says otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Text bytes that a kernel handles at once.
CHUNK_BYTES = 4 << 20


# --- storage ---------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one where that is unset and one machine runs all (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veritext-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage.

    The files stay until drop(), until the scratch() around ends, or until the cluster clears the shared folder.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if open_ := _open_scratches(df.sparkSession):
        open_[-1].append(out)
    return out


def _open_scratches(spark: SparkSession) -> list[list[DataFrame]]:
    """What stored() wrote inside of each open scratch(); kept at the context, as the package's modules travel with its kernels."""
    return spark.sparkContext.__dict__.setdefault("_veritext_scratches", [])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Drops, at its end, what stored() writes inside, but for the frames given to the function that it yields.

    Nothing else that is still to be read may depend on what is dropped.
    """
    made: list[DataFrame] = []
    kept: set[str] = set()
    open_ = _open_scratches(spark)
    open_.append(made)
    try:
        yield lambda *frames: kept.update(f._stored_at for f in frames)
    finally:
        open_.pop()
        drop(*[f for f in made if f._stored_at not in kept])
        if open_:
            open_[-1].extend(f for f in made if f._stored_at in kept)
        made.clear()
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets go of plans that nothing refers to, so that Spark's cleaner removes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*frames: DataFrame) -> None:
    """Delete what stored() wrote."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) with null texts as empty; further columns are dropped."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


# --- joins that one key cannot stall ----------------------------------------

def join_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, count_col: str, total: int, share: int = 1000) -> DataFrame:
    """rows left join verdicts on key, where verdicts has one row a key and the key's row count.

    Keys with at least total / share rows, of which there are at most share, are
    broadcast; all others are joined by a shuffle in which no key is large.
    """
    least = max(2, total // share)
    hot = verdicts.where(F.col(count_col) >= least)
    cold = verdicts.where(F.col(count_col) < least)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    mild = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, key, "left")
    large = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key, "left")
    return mild.unionByName(large)


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text as it stands, in hex; a null text is empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def settle(docs: DataFrame, acts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that acts(id, sha, stays), a stored table, leaves.

    acts has a row for each doc_id and text digest that it decides on: of the
    rows with both, none stays, or one does. All other rows stay. Null ids are
    compared as equal. docs may have columns of any names.
    """
    key = lambda id_, sha: F.concat_ws(":", F.coalesce(id_.cast("bigint").cast("string"), F.lit("none")), sha)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), key(F.col(id_col), text_digest()).alias("key"))
    # The same join at any size: what would be broadcast grows with the input.
    decided = acts.select(key(F.col("id"), F.col("sha")).alias("key"), "stays").hint("merge")
    if not acts.where("stays").take(1):
        return packed.join(decided, "key", "left_anti").select("row.*")
    joined = packed.join(decided, "key", "left").where("stays IS NULL OR stays")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return joined.withColumn("nth", nth).where("stays IS NULL OR nth = 1").select("row.*")


# --- connected components ----------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Rounds of minimum labels over neighbours with pointer jumping, each round a
    written table. Every round reduces edges by key before it shuffles them.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = stored(links.union(links.select("v", "u")).distinct(), f"{name}-links")
    labels = stored(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"), F.lit(True).alias("moved")), f"{name}-labels")
    while labels.where("moved").take(1):
        seen = links.join(labels, links.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("low"))
        near = labels.join(seen, "node", "left").select("node", "component", F.least("component", "low").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        following = near.join(roots, "low", "left").select("node", F.least("low", "root").alias("next"), "component")
        before, labels = labels, stored(following.select("node", F.col("next").alias("component"), (F.col("next") < F.col("component")).alias("moved")), f"{name}-labels")
        drop(before)
    drop(links)
    return labels.drop("moved")


# --- text kernels ------------------------------------------------------------

#: Byte tables for bytes.translate: white space to blanks; also A-Z to a-z; and also all other ASCII but digits and letters to blanks.
PLAIN_TABLE = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
LOWER_TABLE = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b for b in PLAIN_TABLE)
ALNUM_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER_TABLE)

#: Bytes of a block in which words are hashed at once, and the base of their polynomials.
HASH_BLOCK = 1 << 15
HASH_BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]).astype(np.uint64), dtype=np.uint64)


@functools.cache
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(HASH_BASE, HASH_BLOCK), powers(pow(HASH_BASE, -1, 2**64), HASH_BLOCK)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at blanks into pieces of at most HASH_BLOCK - 4 bytes, or of one word."""
    at = 0
    while len(text) - at > HASH_BLOCK - 4:
        to = text.rfind(b" ", at, at + HASH_BLOCK - 3)
        if to < at:
            to = text.find(b" ", at)
            to = len(text) if to < 0 else to
        yield text[at:to]
        at = to + 1
    if at < len(text):
        yield text[at:]


def _hash_block(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of pieces, in order, and each piece's number of words. All pieces together, with a blank each, fit into a block."""
    up, down = _block_powers()
    data = np.frombuffer(b" ".join([b"", *pieces, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(data == 0x20)) + 1
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    upto = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in pieces]), "right")
    return hashes, np.diff(upto, prepend=0)


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after another, and the number of words of each text.

    Words are what blanks separate after translation by `table`. Memory beside
    the result is bounded whatever the length of a text.
    """
    counts = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = [np.zeros(0, np.uint64)]
    held: list[bytes] = []
    owners: list[int] = []
    room = HASH_BLOCK - 1

    def flush() -> None:
        nonlocal room
        if held:
            hashes, n = _hash_block(held)
            found.append(hashes)
            np.add.at(counts, owners, n)
            held.clear()
            owners.clear()
            room = HASH_BLOCK - 1

    for k, t in enumerate(texts):
        for piece in _pieces(t.translate(table)):
            if len(piece) + 2 > room:
                flush()
            if len(piece) + 2 > HASH_BLOCK:
                found.append(np.array([xxhash.xxh3_64_intdigest(piece)], np.uint64))
                counts[k] += 1
                continue
            held.append(piece)
            owners.append(k)
            room -= len(piece) + 1
    flush()
    return np.concatenate(found), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, and their number by text; with fewer words, the whole sequence is the one shingle."""
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(len(words))
    size = np.repeat(np.minimum(counts, k), counts)
    at = np.flatnonzero(room >= size)
    size = size[at]
    out = size.astype(np.uint64)
    for i in range(k):
        longer = size > i
        out = np.where(longer, mix(out * np.uint64(0x9E3779B97F4A7C15) + words[np.where(longer, at + i, at)]), out)
    return out, np.where(counts > 0, np.maximum(counts - k, 0) + 1, 0)


def tidy() -> None:
    """Gives the memory that a kernel has freed back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kernel(run: Callable) -> Callable:
    """A kernel over batches that tidies up after its last one."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts in UTF-8, of about `most` text bytes each (one row at least)."""
    for batch in batches:
        texts = batch.column("text")
        if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
            sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        else:
            raise TypeError(f"text has type {texts.type}")
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(at, to - at)
            yield part, part.column("text").cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()
            at = to


def task_key() -> Callable[[], int]:
    """Numbers that no other task of the stage gives out: partition in the upper bits, a count in the lower."""
    from pyspark import TaskContext

    context = TaskContext.get()
    base, count = ((context.partitionId() if context else 0) << 32), [0]

    def following() -> int:
        count[0] += 1
        return base + count[0]

    return following
