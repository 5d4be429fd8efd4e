"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with some records, and a
footer: a skippable frame with the seek table of the public seekable format
(compressed and decompressed size of each frame, their number, a magic number).
A record is found by its identifier through the record map, (frame, offset in the
decompressed frame, length), so that reading it decompresses one frame; reading a
whole bundle goes by the map too. Bundles travel as
binary columns, and Spark's committed Parquet writer stores them, so a lost
executor leaves no half-written archive; export() writes them as files.

Of records with equal payloads of at least 100 bytes the one with the smallest
page_id is a response, all others are revisits that refer to it.

A record's identifier names its page and payload digest, so that pages which share a
page_id have identifiers of their own; without a page_id it also names the record's
place. Only rows with one page_id and one payload share an identifier: to each other
they are the same record.

Defined cases: a null html is an empty payload; a null url is empty; a record of a
null page_id is never referred to unless all copies have null ids, which makes them
responses. Repeated rows with the smallest page_id are all responses. A record larger
than a frame's target gets a frame of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEAST_REVISIT = 100
#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BUNDLE_SCHEMA = "bundle string, data binary, record_ids array<string>, page_ids array<bigint>, frames array<int>, offsets array<int>, lengths array<int>"
RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, bundle string, frame int"


# --- records -----------------------------------------------------------------

def record_id(page_id: int | None, digest: str, place: str) -> str:
    return f"<urn:page:{page_id}:{digest}>" if page_id is not None else f"<urn:page:none:{digest}:{place}>"


def page_of(identifier: str) -> int | None:
    name = identifier.split(":")[2]
    return None if name == "none" else int(name)


def make_record(identifier: str, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": identifier, "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url, safe="/:?#[]@!$&'()*+,;=~"), "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Length": len(payload), "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        head |= {"WARC-Refers-To": record_id(refers_to, digest, ""), "WARC-Profile": PROFILE}
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head["Content-Length"] = len(block)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, offset of the next record)."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


def read_record(head: dict[str, str], block: bytes) -> dict:
    """A row of RECORD_SCHEMA without its place; the payload of a response is hashed anew and held against its header."""
    revisit = head["WARC-Type"] == "revisit"
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
    if not revisit:
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    return {
        "page_id": page_of(head["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"],
        "refers_to": page_of(head["WARC-Refers-To"]) if revisit else None, "url": unquote(head["WARC-Target-URI"]),
    }


# --- bundles -----------------------------------------------------------------

class Bundler:
    """Groups records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.data, self.sizes, self.open = bytearray(), [], bytearray()
        self.ids, self.pages, self.frames, self.offsets, self.lengths = [], [], [], [], []

    def add(self, identifier: str, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.close_frame()
        self.ids.append(identifier)
        self.pages.append(page_id)
        self.frames.append(len(self.sizes))
        self.offsets.append(len(self.open))
        self.lengths.append(len(record))
        self.open += record

    def close_frame(self) -> None:
        frame = self.zip.compress(bytes(self.open))
        self.sizes.append((len(frame), len(self.open)))
        self.data += frame
        self.open = bytearray()

    def finish(self) -> tuple[bytes, list, list, list, list, list]:
        if self.open:
            self.close_frame()
        seek = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return bytes(self.data) + struct.pack("<II", SKIPPABLE_MAGIC, len(seek)) + seek, self.ids, self.pages, self.frames, self.offsets, self.lengths


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, at, entry = [], 0, len(data) - 9 - n * width
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, entry + k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, packed, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def record_at(data: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by its entry in the map: decompresses its frame only."""
    plain = read_frame(data, seek_table(data), frame)
    head, block, end = parse_record(plain, offset)
    if end - offset != length:
        raise ValueError("the record map doesn't fit the bundle")
    return head, block


# --- Spark -------------------------------------------------------------------

def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit) of each row."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = rows.select("digest", "page_id", F.octet_length("payload").alias("size")).where(F.col("size") >= LEAST_REVISIT)
    groups = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    groups = common.stored(groups, "warc-groups")
    joined = common.join_verdicts(rows, groups, "digest", "n", rows.count())
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """One row a bundle, with its map from record identifiers to frames and offsets. Each task holds one bundle at a time."""

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = common.task_key(), Bundler(frame_bytes)
        name = f"bundle-{key():012x}"

        def done() -> pa.RecordBatch:
            data, ids, pages, frames, offsets, lengths = open_.finish()
            i32 = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.string())), pa.array([pages], pa.list_(pa.int64())), pa.array([frames], i32), pa.array([offsets], i32), pa.array([lengths], i32)],
                ["bundle", "data", "record_ids", "page_ids", "frames", "offsets", "lengths"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    payload = r["payload"].encode()
                    identifier = record_id(r["page_id"], r["digest"], f"{name}.{len(open_.ids)}")
                    open_.add(identifier, r["page_id"], make_record(identifier, r["url"], payload, r["digest"], r["refers_to"], r["revisit"]))
                    if len(open_.data) >= bundle_bytes:
                        yield done()
                        open_, name = Bundler(frame_bytes), f"bundle-{key():012x}"
        if open_.ids:
            yield done()

    return records.mapInArrow(run, BUNDLE_SCHEMA)


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("bundle", pa.string()), ("frame", pa.int32())])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """The rows of RECORD_SCHEMA that the archives hold: each record of the map, from its frame and offset. A map and an archive that differ raise an error."""

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                table, frame, rows, end = seek_table(row["data"]), -1, [], 0
                for identifier, f, offset, length in zip(row["record_ids"], row["frames"], row["offsets"], row["lengths"], strict=True):
                    if f != frame:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                        if frame >= 0 and end != len(plain):
                            raise ValueError("the record map leaves records out")
                        frame, plain, rows = f, read_frame(row["data"], table, f), []
                    head, block, end = parse_record(plain, offset)
                    if end - offset != length or head["WARC-Record-ID"] != identifier:
                        raise ValueError("the record map doesn't fit the bundle")
                    rows.append(read_record(head, block) | {"bundle": row["bundle"], "frame": f})
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    return bundles.select("bundle", "data", "record_ids", "frames", "offsets", "lengths").mapInArrow(run, RECORD_SCHEMA)


def record_map(bundles: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle, frame, frame_offset, length) of each record."""
    return bundles.select("bundle", F.explode(F.arrays_zip("record_ids", "page_ids", "frames", "offsets", "lengths")).alias("r")).select(
        F.col("r.record_ids").alias("record_id"), F.col("r.page_ids").alias("page_id"), "bundle", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("frame_offset"), F.col("r.lengths").alias("length"))


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted(page_id), each read through the record map from its own frame. wanted is joined by shuffle."""
    ids = wanted.select(F.col("page_id").cast("bigint").alias("wanted")).distinct()
    spots = record_map(bundles).join(ids, F.col("page_id").eqNullSafe(F.col("wanted"))).groupBy("bundle").agg(F.collect_list(F.struct("frame", "frame_offset", "length")).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [record_at(row["data"], s["frame"], s["frame_offset"], s["length"]) for s in row["spots"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page_of(h["WARC-Record-ID"]) for h, _ in found], pa.int64()), pa.array([h["WARC-Type"] for h, _ in found]), pa.array([b for _, b in found], pa.binary())], ["page_id", "record_type", "block"])

    return bundles.select("bundle", "data").join(spots, "bundle").mapInArrow(run, "page_id bigint, record_type string, block binary")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as folder/<bundle>.warc.zst through the file system that folder's URI names; returns (path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}.warc.zst", compression=None) as out:
                    out.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}.warc.zst"]), pa.array([len(data)], pa.int64())], ["path", "bytes"])

    return bundles.select("bundle", "data").mapInArrow(run, "path string, bytes bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = common.stored(write_bundles(plan_records(common.table(spark, sf_dir, "pages"))), "warc-bundles", compression="none")
    return read_bundles(bundles).drop("bundle", "frame")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to, url
FROM p LEFT JOIN g USING (payload_digest)
"""
