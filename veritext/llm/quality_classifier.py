"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

Statistics of a document's whole text are standardised and mapped to cosines with
random frequencies, whose inner products approximate a Gaussian kernel. Each
partition sums its part of the normal equations; the sums are added up by blocks
of rows and solved by the driver (a matrix of FEATURES + 1 rows, whatever the
input's size). A histogram of raw scores on a fold that the regression has not
seen gives the isotonic calibration.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0: folds 2
to 4 fit the regression, fold 1 the calibration. Nothing but the text is an input
of a score.

Defined cases: a null text is empty and has a score; a null doc_id is not held
out and has no label; a doc_id with several labels has their mean; without any
label every score is 0.5; a label for an unknown doc_id is of no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common

#: Random features, width of the Gaussian kernel on standardised statistics, ridge penalty a row, and the seed of the frequencies.
FEATURES, WIDTH, PENALTY, SEED = 256, 3.0, 1e-4, 20240229
THRESHOLD = 0.3
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
BINS = 2048

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "pipe", "shout", "symbol", "blank", "feed", "high", "entropy",
    "distinct", "adjacent", "commonest", "line_words", "repeated_lines", "marked_words", "upper_words",
)


# --- statistics --------------------------------------------------------------

def _classes() -> np.ndarray:
    """256 x 9: the byte classes whose shares are statistics."""
    c = np.array([chr(i) for i in range(256)])
    ascii_ = np.arange(256) < 128
    mark = ascii_ & ~np.char.isalnum(c) & (np.arange(256) > 32) & (np.arange(256) < 127)
    rows = [ascii_ & np.char.isupper(c), ascii_ & np.char.isdigit(c), mark, c == "|", c == "!", np.isin(c, list("#$%&*@^~<>{}[]=+_\\")), c == " ", c == "\n", ~ascii_]
    return np.stack(rows, 1).astype(np.float64)


CLASSES = _classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES a text."""
    out = np.zeros((len(texts), len(NAMES)))
    counts = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        if not t:
            continue
        counts[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words = t.split()
        lines = [x for x in t.split(b"\n") if x.strip()]
        n = len(words)
        out[i, 0], out[i, 1] = np.log1p(len(t)), np.log1p(n)
        if n:
            times: dict[bytes, int] = {}
            for w in words:
                times[w] = times.get(w, 0) + 1
            out[i, 2] = np.log1p(sum(map(len, words)) / n)
            out[i, 13] = len(times) / n**0.8
            out[i, 14] = sum(map(bytes.__eq__, words, words[1:])) / n
            out[i, 15] = max(times.values()) / n
            out[i, 18] = sum(1 for w in words if w[-1] < 127 and not chr(w[-1]).isalnum() and w[-1] not in b".,") / n
            out[i, 19] = sum(map(bytes.isupper, words)) / n
        if lines:
            out[i, 16] = np.log1p(n / len(lines))
            out[i, 17] = 1 - len(set(lines)) / len(lines)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    out[:, 3:12] = np.sqrt(counts @ CLASSES / total)
    p = counts / total
    out[:, 12] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return out


# --- model -------------------------------------------------------------------

@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        frequency = rng.normal(0, 1 / WIDTH, (len(NAMES), FEATURES))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ frequency + phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to value under weight."""
    blocks: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist(), strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


# --- Spark -------------------------------------------------------------------

def fold(column: str = "doc_id"):
    return (F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS).cast("int")


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of each row."""

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(statistics(texts)), pa.list_(pa.float64()))], ["doc_id", "stats"])

    return common.documents(docs).mapInArrow(run, "doc_id bigint, stats array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES))


def partition_sums(rows: DataFrame, terms, width: int) -> np.ndarray:
    """The sum over all rows of terms(batch), an array with `width` columns: summed by partition, then by blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                t = terms(batch)
                total = t if total is None else total + t
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "body"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in group.column("body").to_pylist()], axis=0)
        return pa.table({"row": group.column("row").slice(0, 1), "body": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "row int, body binary").groupBy("row").applyInArrow(add, "row int, body binary").toArrow()
    out = np.zeros((max(found.column("row").to_pylist(), default=-1) + 1, width))
    for r, b in zip(found.column("row").to_pylist(), found.column("body").to_pylist(), strict=True):
        out[r] = np.frombuffer(b)
    return out


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, y, fold) of the rows to learn from."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    return stats.join(y.groupBy("doc_id").agg(F.avg("y").alias("y")), "doc_id").select("stats", "y", fold().alias("fold")).where(F.col("fold") != HELD_OUT)


def fit(rows: DataFrame) -> Model | None:
    """The model learned from rows(stats, y, fold); None without rows."""
    rows = common.stored(rows, "quality-rows")
    k = len(NAMES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.stack([x.sum(0), (x * x).sum(0), np.full(k, float(len(x)))])

    sums = partition_sums(rows, moments, k)
    if not len(sums):
        return None
    mean = sums[0] / sums[2]
    model = Model(mean, np.sqrt(np.maximum(sums[1] / sums[2] - mean**2, 1e-6)), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_matrix(batch)), batch.column("y").to_numpy()
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    learn = rows.where(F.col("fold") != CALIBRATION)
    calibrate = rows.where(F.col("fold") == CALIBRATION)
    sums = partition_sums(learn, equations, FEATURES + 2)
    if not len(sums):
        learn = calibrate = rows
        sums = partition_sums(learn, equations, FEATURES + 2)
    n = sums[-1, -2]
    model.weights = np.linalg.solve(sums[:, :-1] + PENALTY * n * np.eye(FEATURES + 1), sums[:, -1])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(_matrix(batch)), batch.column("y").to_numpy()
        at = np.clip(((raw + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)]).astype(float)

    seen = partition_sums(calibrate, histogram, BINS)
    if not len(seen):
        seen = partition_sums(learn, histogram, BINS)
    used = seen[0] > 0
    weight, good, raw = seen[:, used]
    model.knots, model.values = raw / weight, isotonic(weight, good / weight)
    return model


def scores(stats: np.ndarray, model: Model | None) -> np.ndarray:
    return np.full(len(stats), 0.5) if model is None else model.score(stats)


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of document_statistics()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(_matrix(batch), model))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. The texts are read once."""
    with common.scratch(docs.sparkSession) as keep:
        stats = common.stored(document_statistics(docs), "quality-statistics")
        model = fit(labelled(stats, labels))
        keep(stats)
    return score(stats, model)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    with common.scratch(docs.sparkSession):
        model = fit(labelled(common.stored(document_statistics(docs), "quality-statistics"), labels))
    at = docs.columns.index("text")
    # The text goes by the kernel's name, all other columns under names that can't clash with it.
    names = ["text" if i == at else f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)

    @common.kernel
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_chunks(batches):
            yield part.filter(pa.array(scores(statistics([t or b"" for t in texts]), model) >= THRESHOLD))

    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
