"""Quality classifier: a hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read
from .linear import fit_hinge, fit_sigmoid, margins

BITS = 16
DIMS = 1 << BITS
#: Rows of the sample that the hinge-loss model is fitted on; the log-count ratios come from all labelled rows.
FIT_ROWS = 6000
#: Labels are broadcast up to this many rows (two numbers each), and joined by a shuffle beyond it.
BROADCAST_LABELS = 2_000_000
STEP = 1 << 17


class Indicators:
    """Which hashed byte 2- to 4-grams a text holds, as sorted bucket numbers. Whole texts, in steps of fixed memory."""

    def __init__(self) -> None:
        self.seen = np.zeros(DIMS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        self.seen[:] = False
        for at in range(0, len(data), STEP):
            code = data[at : at + STEP + 3].astype(np.uint32)
            for n in (2, 3, 4):
                if len(code) >= n:
                    gram = code[: len(code) - n + 1].copy()
                    for j in range(1, n):
                        gram |= code[j : len(code) - n + 1 + j] << np.uint32(8 * j)
                    self.seen[(gram + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BITS)] = True
        return np.flatnonzero(self.seen)


@dataclass
class QualityModel:
    scaled: np.ndarray  # log-count ratio times weight, by bucket
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        m = float(self.scaled[ids].sum()) / (float(np.sqrt(r @ r)) or 1.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def _labelled(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """text and y (0 or 1) of the documents that may be learned from; one row per document and label row."""
    y = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(target).cast("int").alias("y"))
    if y.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        y = F.broadcast(y)
    return docs.select("doc_id", "text").join(y, "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS, smoothing: float = 1.0) -> QualityModel:
    """Learn from (doc_id, text) and (doc_id, quality); rows whose crc32(doc_id) mod 5 is 0 are never looked at.

    Counts of buckets by class cover all labelled rows: each task adds them up before the shuffle, so no more than
    2^16 rows leave it. The hinge-loss model is fitted in one task on the ``fit_rows`` labelled rows of least hash: on
    four fifths of them, and its sigmoid on the fifth left out. Without labels of both classes every score is the share
    of label 1 (0.5 if there are none).
    """
    rows = _labelled(docs, labels, target)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_in, ind = np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64), Indicators()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total[y][ind(text.as_py())] += 1
                docs_in[y] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, DIMS)), pa.array(np.append(total[0][some], docs_in[0])), pa.array(np.append(total[1][some], docs_in[1]))], ["bucket", "n0", "n1"])

    table = rows.select("text", "y").mapInArrow(counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = np.zeros((2, DIMS + 1))
    n[0, table.bucket], n[1, table.bucket] = table.n0, table.n1
    total = n[:, DIMS]
    if not total.all():
        share = total[1] / total.sum() if total.sum() else 0.5
        return QualityModel(np.zeros(DIMS), np.zeros(DIMS), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    p = (n[:, :DIMS] + smoothing) / (total[:, None] + 2 * smoothing)
    ratio = np.log(p[1] / p[0])

    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # at most fit_rows ids

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ind = Indicators()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([ind(t.as_py()).astype(np.uint16).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "y", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # one text for each id and label, so that an id that rows repeat doesn't flood the driver: 2 * fit_rows rows at most
    few = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = few.select("doc_id", "text", "y").mapInArrow(indicators, f"doc_id {kind}, y int, ids binary").repartition(1).sortWithinPartitions("doc_id", "y")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            for b in batch.column(2).to_pylist():
                i = np.frombuffer(b, np.uint16)
                r = ratio[i]
                x.append((i, (r / (np.sqrt(r @ r) or 1.0)).astype(np.float32)))  # six bytes for each bucket of a row
        if not x:
            return
        y = np.where(np.array(y) > 0, 1.0, -1.0)
        away = np.arange(len(x)) % 5 == 4
        part = lambda keep: [r for r, k in zip(x, keep, strict=True) if k]
        share = max((y > 0).mean(), 1e-3), max((y < 0).mean(), 1e-3)
        balance = np.where(y > 0, 0.5 / share[0], 0.5 / share[1])
        w = fit_hinge(part(~away), y[~away], DIMS, weight=balance[~away])
        slope, offset = fit_sigmoid(margins(part(away), w), y[away])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([slope]), pa.array([offset])], ["w", "slope", "offset"])

    # the bounded sample goes to one task, the model to the driver
    got = sample.mapInArrow(fit, "w binary, slope double, offset double").first()
    w = np.frombuffer(got.w)
    return QualityModel(w[:DIMS] * ratio, ratio, float(w[DIMS]), got.slope, got.offset)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text); other columns are ignored.

    Null and empty texts have no n-grams and get the score of the bias. Repeated rows are scored alike, and an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^16 numbers

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ind, m = Indicators(), shared.value
        for batch in batches:
            s = [m.score(ind(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(scores, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, held-out ones too."""
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more. No shuffle.

    Null and empty texts get the score of the bias, repeated rows go or stay alike, an empty table stays empty.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ind, m = Indicators(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(ind(t.as_py())) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
