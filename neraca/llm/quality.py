"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are hashed byte trigrams of the whole text and words that follow themselves (two, three and
four in a row).  Each is scaled by its class log-count ratio, then a linear hinge-loss model is fitted by
dual coordinate descent and interpolated with the mean weight; a sigmoid turns margins into scores.

The model is fitted on about ``PER_CLASS`` labelled whole texts of each class, at most twice that; every
document is scored.  Defined results: a null or empty text has no indicator and gets the score of
the bias alone; ids labelled both ways, null labels and null ids teach nothing; with one class or none
every score is its share or 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.llm import tokens
from neraca.llm.arrow import append, field
from neraca.llm.linear import calibrate, dual_descent, sigmoid

BITS = 15
#: Trigram features, then the three runs of one word; the bias comes last.
TRIGRAMS = 1 << BITS
SIZE = TRIGRAMS + 3
PER_CLASS = 1500
#: Share of the fitted weights against their mean size; smoothing of the counts; bound of the dual variables.
MIXED, SMOOTH, COST = 0.5, 1.0, 4.0


def indicators(column: pa.Array, most_rows: int = 64):
    """(first row, rows, row, feature) of the distinct features of whole texts, in order."""
    raw, at = tokens.buffers(column)
    for found in tokens.words(column, fold=tokens.LOWER, most_rows=most_rows):
        low, high = found.first, found.first + found.rows
        seen = np.zeros(found.rows * SIZE, bool)
        step = tokens.SLICE if found.rows == 1 else 1 << 62
        for a in range(int(at[low]), int(at[high]), step):
            b = min(int(at[high]), a + step + 2)
            part = raw[a:b].astype(np.uint32)
            if len(part) < 3:
                continue
            code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            cell = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
            if found.rows == 1:
                seen[cell] = True
            else:
                row = np.repeat(np.arange(found.rows), np.diff(at[low : high + 1]))
                inside = row[:-2] == row[2:]
                seen[(row[:-2] * SIZE + cell)[inside]] = True
        again = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
        for k in range(3):
            run = again[: max(0, len(again) - k)].copy()
            for n in range(1, k + 1):
                run &= again[n : len(again) - k + n]
            seen[found.row[:-1][: len(run)][run].astype(np.int64) * SIZE + TRIGRAMS + k] = True
        flat = np.flatnonzero(seen)
        yield low, found.rows, flat // SIZE, flat % SIZE


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, rows, row, at in indicators(column):
            n = np.maximum(np.bincount(row, minlength=rows), 1)
            margin = np.bincount(row, self.weights[at], minlength=rows) / np.sqrt(n) + self.bias
            out[first : first + rows] = sigmoid(self.slope * margin + self.shift)
        return out


def train(features: list[np.ndarray], y: np.ndarray) -> Model:
    """``y`` is +1 or -1; a constant model where one class is missing."""
    plus, minus = int((y > 0).sum()), int((y < 0).sum())
    if not plus or not minus:
        share = 0.5 if not len(y) else (plus + 0.5) / (len(y) + 1)
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    p, q = np.full(SIZE, SMOOTH), np.full(SIZE, SMOOTH)
    for at, side in zip(features, y, strict=True):
        (p if side > 0 else q)[at] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    rows = [(np.append(at, SIZE), np.append(ratio[at] / np.sqrt(max(1, len(at))), 1.0)) for at in features]
    cost = COST * len(y) / (2 * np.where(y > 0, plus, minus))
    w = dual_descent(rows, y, SIZE + 1, cost)
    mean = np.abs(w[:-1]).mean()
    weights = (MIXED * w[:-1] + (1 - MIXED) * mean) * ratio
    margins = np.array([weights[at].sum() / np.sqrt(max(1, len(at))) + w[-1] for at in features])
    slope, shift = calibrate(margins, y)
    return Model(weights, float(w[-1]), slope, shift)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from labelled ids for which ``learn`` (over a column ``id``) holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter(learn & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most and label in (0, 1)").drop("most")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return train([], np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_class / n))]), F.col("label"))
    drawn = known.filter(F.xxhash64(F.col("id").cast("string"), F.lit(5)) / 2.0**64 + 0.5 < share)
    drawn = drawn.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(5))).limit(2 * per_class * len(counts))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id").dropDuplicates(["id"])

    def run(batches):
        for batch in batches:
            out = []
            for _, rows, row, at in indicators(batch.column("text")):
                out += [x.astype(np.uint16).tobytes() for x in np.split(at, np.searchsorted(row, np.arange(1, rows)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    found = sorted(((r["id"], r["label"], bytes(r["x"])) for r in texts.mapInArrow(run, f"id {kind}, label int, x binary").collect()), key=lambda r: r[:2])
    return train([np.frombuffer(x, np.uint16).astype(np.int64) for _, _, x in found], np.array([1.0 if k else -1.0 for _, k, _ in found]))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    return append(docs, [field(name, T.DoubleType())], lambda batch: [pa.array(model.scores(batch.column(text)))])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("quality", F.col("quality").cast("int"))
    model = fit(docs, labels, ~held_out(F.col("id")))
    rows = scored(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
