"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Features are the square roots of hashed byte-trigram shares over letters, so a text's length
does not matter.  Families compete in one-versus-one SVMs of their own; the winner's languages
do the same.  The score is the product of the winner's lowest duel chance in both, so a clear winner
scores near 1 among any number of classes.

Duels only compare, so a foreign text has a winner too.  The affinity tells it apart: the mean, over a text's
trigrams, of the log-likelihood ratio of the language's own trigram shares, mixed in equal parts with blind
chance, to blind chance alone; the best language counts.  Below 0 blind chance explains the text better than any language.

Defined results: a null text, an empty one and one without any letter give ``und`` and score 0.
Rows with a null id or null language are predicted but not learned from.  Repeated rows get
equal results.  With one learned language every text with a letter gets it; with none, ``und``.
A learned sample holds about ``per_language`` whole texts of each language, at most twice that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.llm import tokens
from neraca.llm.arrow import append, field
from neraca.llm.linear import calibrate, dual_descent, sigmoid

SIZE = 4096
#: Texts learned from, for each language.
PER_LANGUAGE = 400
#: Language families by ISO code; an unlisted language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}

#: A-Z to a-z, every byte that is no letter of ASCII and no part of a longer character to a space.
_FOLD = tokens.LOWER.copy()
_FOLD[[b for b in range(0x80) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 0x20


def shares(column: pa.Array, rows: int = 256):
    """(first row, matrix): square-root trigram shares of each whole text and a constant."""
    raw, at = tokens.buffers(column)
    for low, high in tokens.slices(at, most_rows=rows):
        counts = np.zeros((high - low) * SIZE, np.float32)
        for a in range(int(at[low]), int(at[high]), tokens.SLICE) if high == low + 1 else [int(at[low])]:
            b = min(int(at[high]), a + tokens.SLICE + 2) if high == low + 1 else int(at[high])
            folded = _FOLD[raw[a:b]].astype(np.uint32)
            if len(folded) < 3:
                continue
            code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
            cell = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
            inner = at[low + 1 : high] - a
            row = np.repeat(np.arange(high - low), np.diff(at[low : high + 1])) if high > low + 1 else np.zeros(b - a, np.int64)
            good = (folded[:-2] != 0x20) | (folded[1:-1] != 0x20)
            if len(inner):
                good &= row[:-2] == row[2:]
            counts += np.bincount((row[:-2] * SIZE + cell)[good], minlength=len(counts)).astype(np.float32)
        counts = counts.reshape(high - low, SIZE)
        total = counts.sum(axis=1, keepdims=True)
        x = np.sqrt(counts / np.maximum(total, 1))
        yield low, np.hstack([x, np.ones((high - low, 1), np.float32)])


class Duel:
    """One-versus-one SVMs among named classes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.names = sorted(set(names))
        self.pairs = list(combinations(range(len(self.names)), 2))
        self.weights = np.zeros((x.shape[1], len(self.pairs)), np.float32)
        self.sigmoids = np.zeros((2, len(self.pairs)), np.float32)
        every = np.arange(x.shape[1])
        for k, (i, j) in enumerate(self.pairs):
            picked = np.isin(names, [self.names[i], self.names[j]])
            own, y = x[picked].astype(float), np.where(names[picked] == self.names[i], 1.0, -1.0)
            cost = 10.0 * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
            w = dual_descent([(every, r) for r in own], y, x.shape[1], cost)
            self.weights[:, k] = w
            self.sigmoids[:, k] = calibrate(own @ w, y)

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of the largest sum of duel chances for each text, and its lowest duel chance."""
        k = len(self.names)
        if k == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        p, total, lowest = sigmoid(self.sigmoids[0] * (x @ self.weights) + self.sigmoids[1]), np.zeros((len(x), k)), np.ones((len(x), k))
        for n, (i, j) in enumerate(self.pairs):
            for c, chance in ((i, p[:, n]), (j, 1 - p[:, n])):
                total[:, c] += chance
                lowest[:, c] = np.minimum(lowest[:, c], chance)
        best = total.argmax(axis=1)
        return best, lowest[np.arange(len(x)), best]


class Hierarchy:
    """Families, and the languages of each."""

    def __init__(self, x: np.ndarray, languages: np.ndarray, families: dict[str, str]):
        family = np.array([families.get(v, f"only {v}") for v in languages], object)
        self.top = Duel(x, family)
        self.inside = {f: Duel(x[family == f], languages[family == f]) for f in self.top.names}
        own = np.stack([np.square(x[languages == v, :-1], dtype=float).mean(axis=0) for v in sorted(set(languages))], axis=1)
        self.ratios = np.log((1 + SIZE * own) / 2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, score = self.top.winners(x)
        name = np.empty(len(x), object)
        for n, f in enumerate(self.top.names):
            rows = np.flatnonzero(best == n)
            if len(rows):
                pick, own = self.inside[f].winners(x[rows])
                name[rows] = np.array(self.inside[f].names, object)[pick]
                score[rows] *= own
        return name, score

    def affinity(self, x: np.ndarray) -> np.ndarray:
        """The best language's mean log-likelihood ratio to blind chance; 0 for a text without trigrams."""
        return (np.square(x[:, :-1], dtype=float) @ self.ratios).max(axis=1)


def fit(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None,
) -> Hierarchy | None:
    """Learn from rows where ``learn`` holds; None without any."""
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("draw")
    )
    counts = {r["lang"]: r["n"] for r in docs.filter(learn & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.2 * per_language / n))]), F.col("lang"))
    drawn = known.filter(F.col("draw") / 2.0**64 + 0.5 < share)
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    drawn = drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= 2 * per_language).select("lang", "text")

    def run(batches):
        for batch in batches:
            rows = np.vstack([x[:, :-1] for _, x in shares(batch.column("text"))]) if batch.num_rows else np.zeros((0, SIZE), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "x"])

    # Arrow batches stream to the driver; the sample is held there once, as the matrix.
    rows = drawn.mapInArrow(run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    order = pc.sort_indices(rows, [("lang", "ascending"), ("x", "ascending")])
    names = np.array(rows["lang"].take(order).to_pylist(), object)
    x = np.ones((len(names), SIZE + 1), np.float32)
    for k, n in enumerate(order.to_pylist()):
        x[k, :-1] = np.frombuffer(rows["x"][n].as_buffer(), np.float32)
    del rows
    return Hierarchy(x, names, FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Hierarchy | None, text: str = "text", name: str = "lang_pred", score: str = "score", affinity: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, its score and, if named, the text's affinity."""
    letters = "__letters"

    def compute(batch: pa.RecordBatch):
        names, scores, near = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        seen = np.asarray(batch.column(letters).fill_null(False)).astype(bool)
        if model is not None:
            for low, x in shares(batch.column(text)):
                own = seen[low : low + len(x)]
                if own.any():
                    names[low : low + len(x)][own], scores[low : low + len(x)][own] = model.predict(x[own])
                    if affinity:
                        near[low : low + len(x)][own] = model.affinity(x[own])
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), *([pa.array(near, pa.float64())] if affinity else [])]

    marked = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [field(name, T.StringType()), field(score, T.DoubleType()), *([field(affinity, T.DoubleType())] if affinity else [])]
    return append(marked, fields, compute, drop=[letters])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
