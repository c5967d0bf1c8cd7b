"""Quality rules: base rules, then robust multivariate outliers per language and source.

Base statistics come from every whole text.  Texts that pass the base rules are judged by their
transformed statistics (log word count, mean word length, and the square roots of the shares of symbols,
repeated lines and repeated words).  For each language and source a minimum-covariance-determinant
estimate is made from all of its texts: start from medians and absolute deviations, then repeat
concentration steps, each taking mean and covariance of the ``HALF`` share of nearest texts, and reweight
once.  A text whose squared Mahalanobis distance exceeds ``CUTOFF`` is rejected.

Every step is one aggregate of a few sums per group, so a hot source costs no single task its rows.
Quantiles are taken of rounded values, which are few.  ``FLOOR`` is added to each
variance, so a statistic that hardly varies rejects only by more than a text resolves; for the same end distances are
scaled down to the normal median where they exceed it, never up.

Defined results: a null or empty text has no words and fails the base rules.  Null language or source is
a group of its own.  Groups of fewer than ``LEAST_ROWS`` passing texts are judged by the estimate of all texts;
if those are too few as well, they are kept.  Repeated rows count each time and share a verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.llm import tokens
from neraca.llm.arrow import append, field
from neraca.llm.jaccard import small
from neraca.session import cut_lineage, discard

HALF, STEPS, LEAST_ROWS = 0.75, 6, 50
#: Squared distance beyond which a text is rejected: five dimensions, about 1 normal text in 70 000.
CUTOFF = 30.0
#: Of the last two, what the coarsest text resolves: one repeated line of two is half of the lines, and two repeated
#: triples of words in the 50 words a text has at least cover 0.24. Alone, in a group without any, more than that rejects.
FLOOR = (0.15, 0.1, 0.0025, 0.5 / CUTOFF, 0.24 / CUTOFF)
#: Median of chi-square with five degrees of freedom, and its 97.5 % quantile.
MEDIAN, REWEIGHT = 4.351, 12.833
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIMS = range(len(FLOOR))


def _per_row(found: tokens.Words, values: np.ndarray) -> np.ndarray:
    return np.bincount(found.row, values, minlength=found.rows).astype(np.int64)


def statistics(column: pa.Array) -> list[np.ndarray]:
    """The arrays of ``STATS`` over whole texts."""
    out: list[list[np.ndarray]] = [[] for _ in STATS]
    for found in tokens.words(column, tokens.WORD, tokens.SAME, mark=tokens.HEADS):
        out[0].append(np.bincount(found.row, minlength=found.rows))
        out[1].append(_per_row(found, found.marked))
        row, value = tokens.ngrams(found.row, found.hash, 3)
        covered = np.zeros(len(found.row) + 2, bool)
        if len(row):
            starts = np.flatnonzero(found.row[:-2] == found.row[2:])
            order = np.lexsort((value, row))
            same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
            twice = np.zeros(len(row), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            for k in range(3):
                covered[starts[twice] + k] = True
        out[4].append(_per_row(found, covered[: len(found.row)]))
    for found in tokens.words(column, tokens.WORD, tokens.SAME, mark=_SYMBOL):
        out[2].append(_per_row(found, found.marked))
    for found in tokens.words(column, tokens.LINE, tokens.SAME, mark=tokens.WORD):
        own = found.marked > 0
        row, value = found.row[own], found.hash[own]
        lines = np.bincount(row, minlength=found.rows)
        order = np.lexsort((value, row))
        again = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
        out[3].append(np.bincount(row[order][1:][again], minlength=found.rows))
        out[5].append(lines)
    return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return append(docs, [field(s, T.LongType()) for s in STATS], lambda batch: [pa.array(x) for x in statistics(batch.column(text))])


def vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.least(F.col("word_chars") / words, F.lit(1000.0)),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. to centre m and precision p of the row's group."""
    total = F.lit(0.0)
    for i in _DIMS:
        for j in range(i + 1):
            cell = F.col("p")[i * len(FLOOR) + j] * (F.col(f"x{i}") - F.col("m")[i]) * (F.col(f"x{j}") - F.col("m")[j])
            total = total + (cell if i == j else 2 * cell)
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    """Centre and precision of each group from sums around a fixed origin."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in _DIMS]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in _DIMS for j in range(i + 1)]
    table = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums)

    def run(batches):
        for batch in batches:
            groups, centres, precisions = [], [], []
            for r in batch.to_pylist():
                m = np.array([r[f"s{i}"] for i in _DIMS]) / r["n"]
                cov = np.zeros((len(FLOOR), len(FLOOR)))
                for i in _DIMS:
                    for j in range(i + 1):
                        cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - m[i] * m[j]
                groups.append(r["grp"])
                centres.append(m.tolist())
                precisions.append(np.linalg.inv(cov + np.diag(FLOOR)).ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(centres, kind), pa.array(precisions, kind)], ["grp", "m", "p"])

    return table.mapInArrow(run, "grp string, m array<double>, p array<double>")


def _held(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    return rows.join(small(estimate, estimate.count()), "grp").withColumn("d", _distance())


def _quantile(held: DataFrame, share: float) -> DataFrame:
    """The quantile of the distances of each group, from logarithms rounded to 0.01."""
    return held.groupBy("grp").agg(F.percentile(F.round(F.log(F.col("d") + 1e-3), 2), F.lit(share)).alias("cut"))


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, m, p, scale) of rows (grp, x0..): the reweighted minimum-covariance-determinant fit."""
    middle = rows.groupBy("grp").agg(*[F.percentile(F.round(f"x{i}", 3), F.lit(0.5)).alias(f"c{i}") for i in _DIMS])
    spread = rows.join(small(middle, middle.count()), "grp").groupBy("grp").agg(
        *[F.first(f"c{i}").alias(f"c{i}") for i in _DIMS],
        *[F.percentile(F.round(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 3), F.lit(0.5)).alias(f"w{i}") for i in _DIMS],
    )
    cells = [1.0 / (F.pow(F.col(f"w{i}") * 1.4826, 2) + FLOOR[i]) if i == j else F.lit(0.0) for i in _DIMS for j in _DIMS]
    now = cut_lineage(spread.select("grp", F.array(*[F.col(f"c{i}") for i in _DIMS]).alias("m"), F.array(*cells).alias("p")))
    for _ in range(STEPS):
        held = _held(rows, now)
        cuts = _quantile(held, HALF)
        near = held.join(small(cuts, now.count()), "grp").filter(F.round(F.log(F.col("d") + 1e-3), 2) <= F.col("cut"))
        fresh = cut_lineage(_moments(near))
        discard(now)
        now = fresh
    for last in (False, True):
        held = _held(rows, now)
        scale = _quantile(held, 0.5).select("grp", F.greatest(F.exp("cut") / MEDIAN, F.lit(1.0)).alias("scale"))
        if last:
            out = cut_lineage(now.join(scale, "grp"))
        else:
            near = held.join(small(scale, now.count()), "grp").filter(F.col("d") / F.col("scale") <= REWEIGHT)
            out = cut_lineage(_moments(near))
        discard(now)
        now = out
    return now


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, statistics, base_failed, kept and the squared distance (null where not judged)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))).alias("home"), F.col(text).alias("text"))
    base = with_statistics(named, "text").drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    xs = [x.alias(f"x{i}") for i, x in enumerate(vector())]
    table = cut_lineage(base.select("doc_id", "home", *STATS, failed.alias("base_failed"), *xs))
    good = table.filter(~F.col("base_failed"))
    sizes = cut_lineage(good.groupBy("home").agg(F.count(F.lit(1)).alias("n")))
    groups, total, fewest = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.min("n")).first()
    own = small(sizes.filter(F.col("n") >= LEAST_ROWS).select("home", F.col("home").alias("grp")), groups)
    grouped = table.join(own, "home", "left").withColumn("grp", F.coalesce("grp", F.lit("all")))
    if not total or total < LEAST_ROWS:
        return table.select("doc_id", *STATS, "base_failed", (~F.col("base_failed")).alias("kept"), F.lit(None).cast("double").alias("distance"))
    learned = grouped.filter(~F.col("base_failed") & (F.col("grp") != "all")).select("grp", *[f"x{i}" for i in _DIMS])
    if fewest < LEAST_ROWS:
        learned = learned.unionByName(good.select(F.lit("all").alias("grp"), *[f"x{i}" for i in _DIMS]))
    fitted = estimates(learned)
    held = grouped.join(small(fitted, fitted.count()), "grp", "left").withColumn("d", _distance() / F.col("scale"))
    distance = F.when(~F.col("base_failed"), F.col("d"))
    kept = ~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= CUTOFF)
    return held.select("doc_id", *STATS, "base_failed", kept.alias("kept"), distance.alias("distance"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark.read.parquet(f"{folder}/documents.parquet"))
