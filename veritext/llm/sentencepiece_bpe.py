"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score (ties: the
leftmost) and merges the best until none is in the vocabulary; symbols without a
piece become byte pieces. The agenda of a short text is a plain list whose least
entry goes next, that of a long one a heap with void entries. A text is first cut
before blanks, around line feeds, and between words and marks after them, where no piece of the
vocabulary spans such places, which is found as it is loaded; long chunks also
between any characters that stand together in no piece. A chunk's ids don't depend on its neighbours and
are kept for the next time the chunk is met.

Each Arrow batch is checked against the sentencepiece library: all chunks that the
worker meets for the first time, put together as texts, and the batch's first whole
text, ids and decoded text alike. A difference raises an error.

Defined cases: a null text is empty; an empty text has the begin and end ids only
and decodes to the empty text. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
import types
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veritext.llm import common

BLANK = "▁"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Chunks that a worker keeps with their ids, and characters up to which the agenda is a list.
KEPT_CHUNKS, SHORT = 300_000, 40
#: Characters of the texts that new chunks are put together to for the check.
CHECK_CHARS = 1 << 16


class Model:
    """A merge-type vocabulary with identity normalisation and a dummy prefix blank."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.rank = {p: (-lib.get_score(i), i) for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {x: k for k, x in enumerate(sorted({r for r, _ in self.rank.values()}))}
        self.base = n + 2
        self.char_ids = {p: i for p, (_, i) in self.rank.items() if len(p) == 1}
        # Two pieces' numbers -> the rank of the piece that they make, and its number.
        self.pairs = {self.rank[p[:k]][1] * self.base + self.rank[p[k:]][1]: order[r] << 20 | i for p, (r, i) in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank}
        #: Scores that several pieces which can be merged share.
        self.tied = {x for x, n in Counter(x >> 20 for x in set(self.pairs.values())).items() if n > 1}
        self.has_bytes = all(lib.is_byte(i) for i in self.byte_ids)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.unused = {i for i in range(n) if lib.is_unused(i)}
        byte_of = {i: b for b, i in enumerate(self.byte_ids)} if self.has_bytes else {}
        self.surface = [bytes([byte_of[i]]) if i in byte_of else b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = [i in byte_of for i in range(n)]
        plain = [p for i, p in enumerate(self.pieces) if not special[i]]
        safe = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in plain)
        #: Neighbouring characters that some piece holds: no piece spans any others.
        self.inner = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        # A word is cut off a mark after it, but for characters that a mark follows in some piece.
        marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        bound = "".join(sorted({before for before, c in self.inner if c in marks and before not in marks}))
        words = rf" *+[^ \n{re.escape(marks + bound)}]++(?=[{re.escape(marks)}])"
        self.cut = re.compile(words + r"| *[^ \n]+| +|\n" if safe else r"(?s).+")
        #: Chunk -> ids in bytes; and the decoded bytes of chunks where these aren't the chunk's own.
        self.kept: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a text whose blanks are escaped."""
        return self.merge_short(text) if len(text) <= SHORT and not self.unused else self.merge_long(text)

    def merge_short(self, text: str) -> list[int]:
        """By an agenda with an entry for each place, of which the leftmost of the best score goes next."""
        base, pairs, at = self.base, self.pairs.get, self.char_ids.get
        none = base - 1
        symbols = [at(c, none) for c in text]
        last = 1 << 60
        agenda = [pairs(a * base + b, last) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < last:
            i = agenda.index(best)
            if best >> 20 in self.tied:
                i = next(k for k, x in enumerate(agenda) if x >> 20 == best >> 20)
                best = agenda[i]
            symbols[i : i + 2] = (merged := best & 0xFFFFF,)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = pairs(merged * base + symbols[i + 1], last)
            if i:
                agenda[i - 1] = pairs(symbols[i - 1] * base + merged, last)
        if none not in symbols:
            return symbols
        out, place = [], 0
        for x in symbols:
            if x == none:
                out.extend((self.byte_ids[b] for b in text[place].encode()) if self.has_bytes else [self.unk])
            else:
                out.append(x)
            place += 1 if x == none else len(self.pieces[x])
        return out

    def merge_long(self, text: str) -> list[int]:
        """By a heap of pairs over a linked list of symbols."""
        base, dead, pairs = self.base, self.base - 2, self.pairs
        at = self.char_ids
        symbols = [at.get(c, base - 1) for c in text]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry is the merged piece's rank and the left symbol's place; it's void once either symbol has changed.
        agenda = [(pairs[k] >> 20) << 32 | i for i, k in enumerate([a * base + b for a, b in zip(symbols, symbols[1:])]) if k in pairs]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or (found := pairs.get(symbols[i] * base + symbols[j])) is None or found >> 20 != entry >> 32:
                continue
            symbols[i] = merged = found & 0xFFFFF
            symbols[j] = dead
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := pairs.get(merged * base + symbols[k])) is not None:
                    heapq.heappush(agenda, (found >> 20) << 32 | i)
            if (h := before[i]) >= 0 and (found := pairs.get(symbols[h] * base + merged)) is not None:
                heapq.heappush(agenda, (found >> 20) << 32 | h)

        if dead + 1 not in symbols and not self.unused:
            return [x for x in symbols if x != dead]
        out: list[int] = []
        place = 0
        while place < n:
            if symbols[place] == base - 1:
                out.extend((self.byte_ids[b] for b in text[place].encode()) if self.has_bytes else [self.unk])
            else:
                out.extend(self.used(symbols[place]))
            place = after[place]
        return out

    def used(self, piece: int) -> list[int]:
        """The piece, or what it was merged from if the vocabulary marks it as unused: its best split, over again."""
        if piece not in self.unused:
            return [piece]
        text = self.pieces[piece]
        splits = [(self.rank[a], i) for i in range(1, len(text)) if (a := text[:i]) in self.rank and text[i:] in self.rank]
        if not splits:
            return [piece]
        i = min(splits)[1]
        return self.used(self.rank[text[:i]][1]) + self.used(self.rank[text[i:]][1])

    def surface_of(self, ids: list[int]) -> bytes:
        """The decoded bytes of ids without the dummy prefix rule; runs of byte pieces that aren't UTF-8 give U+FFFD for each byte."""
        out, run = [], b""
        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
                continue
            if run:
                out.append(repaired(run))
                run = b""
            out.append(self.surface[i])
        return b"".join(out) + repaired(run)

    def chunk(self, raw: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of a chunk of the text with its prefix blank."""
        text = raw.replace(" ", BLANK)
        if len(text) <= SHORT:
            ids = self.merge(text)
        else:
            cuts = [0, *[i for i, pair in enumerate(map(str.__add__, text, text[1:]), 1) if pair not in self.inner], len(text)]
            ids = [x for a, b in zip(cuts, cuts[1:]) for x in self.merge(text[a:b])]
        own, plain = raw.encode(), b"".join([self.surface[i] for i in ids])
        return struct.pack(f"<{len(ids)}I", *ids), own if plain == own else self.surface_of(ids)

    def encode(self, text: str) -> list[int]:
        """All ids of a whole text, with begin and end."""
        return [self.bos, *self.body(text)[0], self.eos]

    def body(self, text: str) -> tuple[list[int], bytes]:
        if not text:
            return [], b""
        parts = [self.chunk(c) for c in self.cut.findall(" " + text.replace(BLANK, " "))]
        data = b"".join(p[0] for p in parts)
        return list(struct.unpack(f"<{len(data) // 4}I", data)), b"".join(p[1] for p in parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces put together, the dummy prefix blank dropped."""
        plain = [i for i in ids if i not in (self.bos, self.eos)]
        first = self.pieces[plain[0]] if plain else ""
        out = self.surface_of(plain)
        return (out[1:] if first.startswith(BLANK) else out).decode()


def repaired(run: bytes) -> bytes:
    """UTF-8 with U+FFFD in place of each byte that belongs to no character."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode() if at + size <= len(run) else 1 / 0)
                    at += size
                    break
                except (UnicodeDecodeError, ZeroDivisionError):
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out).encode()


def worker_model(proto: bytes) -> Model:
    """The model of this worker process; kept, with its chunks, from task to task."""
    state = sys.modules.setdefault("_veritext_worker_state", types.ModuleType("_veritext_worker_state"))
    key = hashlib.sha256(proto).hexdigest()
    if getattr(state, "key", None) != key:
        state.key, state.model = key, Model(proto)
    return state.model


def encode_texts(model: Model, texts: list[str], check: bool = True) -> list[tuple[int, str, str, bytes]]:
    """(n_tokens, ids_sha256, decoded_sha256, ids in bytes) of whole texts; checked against the library."""
    cut, kept, odd = model.cut.findall, model.kept, model.odd
    if len(kept) > KEPT_CHUNKS:
        kept.clear()
        odd.clear()
    plain = [t.replace(BLANK, " ") for t in texts]
    parts = [cut(" " + t) if t else [] for t in plain]
    made = {c: model.chunk(c) for c in set().union(*parts).difference(kept)}
    if check:
        verify(model, made)
    kept.update((c, m[0]) for c, m in made.items())
    odd.update((c, m[1]) for c, m in made.items() if m[1] != c.encode())
    begin, end = struct.pack("<I", model.bos), struct.pack("<I", model.eos)
    out = []
    for t, chunks in zip(plain, parts):
        ids = b"".join([begin, *map(kept.__getitem__, chunks), end])
        # Where all chunks decode to themselves, so does the text.
        text = t.encode() if not odd or odd.keys().isdisjoint(chunks) else b"".join([odd.get(c) or c.encode() for c in chunks])[1:]
        out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), ids))
    if check and texts:
        ids = [model.bos, *model.library.encode(texts[0]), model.eos]
        own = out[0]
        if own[1] != hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() or own[2] != hashlib.sha256(model.library.decode(ids).encode()).hexdigest():
            raise ValueError("a whole text is encoded or decoded otherwise than by the library")
    return out


def verify(model: Model, made: dict[str, tuple[bytes, bytes]]) -> None:
    """Compares all chunks' ids and decoded texts with the library's, in texts that chunks are put together to.

    The library puts a blank before a text, so that of the first chunk is taken
    off. Chunks without a blank follow a line feed each, as in the texts they are from.
    """
    feed = model.chunk("\n")
    for blank in (True, False):
        chunks = [c for c in made if (c[0] == " ") == blank]
        while chunks:
            size, n = 0, 0
            while n < len(chunks) and (not n or size + len(chunks[n]) < CHECK_CHARS):
                size, n = size + len(chunks[n]), n + 1
            now, chunks = chunks[:n], chunks[n:]
            rows = [made[c] for c in now] if blank else [x for c in now for x in (feed, made[c])]
            text = "".join(now)[1:] if blank else "\n" + "\n".join(now)
            data = b"".join([r[0] for r in rows])
            mine, theirs = list(struct.unpack(f"<{len(data) // 4}I", data)), model.library.encode(text)
            head = [] if blank else model.library.encode("\n")[:-1]
            if text and (head + mine != theirs or b"".join([r[1] for r in rows])[int(blank):] != model.library.decode(theirs).encode()):
                wrong = next((c for c in now if alone(model, c) != made[c]), now[0])
                raise ValueError(f"chunk {wrong[:80]!r} is encoded or decoded otherwise than by the library")


def alone(model: Model, chunk: str) -> tuple[bytes, bytes]:
    """What the library makes of one chunk."""
    head = [] if chunk[0] == " " else model.library.encode("\n")
    ids = model.library.encode(chunk[1:] if chunk[0] == " " else "\n" + chunk)
    text = model.library.decode(ids).encode()
    return struct.pack(f"<{len(ids) - len(head)}I", *ids[len(head) :]), b" " + text if chunk[0] == " " else text[1:]


def encoder(proto: bytes, check: bool, with_ids: bool):
    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(proto)
        for part, texts in common.text_chunks(batches):
            rows = encode_texts(model, [t.decode() for t in texts], check)
            arrays = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *[r[0] for r in rows]], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([r[3] for r in rows]), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_rows(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each document, for use rather than for comparison."""
    proto = read_model(model_file)

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(proto)
        for part, texts in common.text_chunks(batches):
            ids = [model.encode(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return common.documents(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def read_model(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_file: str | None = None, check: bool = True, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row. The model file is read by the driver and sent with the tasks."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return common.documents(docs).mapInArrow(encoder(read_model(model_file or default_model()), check, with_ids), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
