"""Mixing by iterative proportional fitting (raking).

Words are counted per cell of source, language and topic.  Raking scales the cells until their sums
meet the target share of each source, language and topic; a cell's factor is its fitted over its
counted words.  A document's weight is ``keep`` * factor: the expected number of its copies in a mix that
meets the targets and has ``keep`` of all words.  ``weighted`` makes whole copies of it, the fraction by a
draw.  ``sample`` repeats nothing: chance = min(1, level * factor), the level chosen so that the expected
number of words is ``keep`` of all; cells that should grow beyond their words miss their targets there.
A document's draw is a hash of its id, so the mix is the same in every run and for every partitioning.

The fitted table has a row per cell, not per document.  Up to ``CELLS`` cells it is fitted in memory on
the driver; more cells are fitted by the same steps as Spark aggregates.

Defined results: null source, language or topic is a value of its own; null and empty texts have no
words, don't count and keep the chance of their cell; a cell without words, or targets that leave
one out, gives chance 0 only where the target is 0; repeated rows share one decision, null ids too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.llm.jaccard import small
from neraca.session import cut_lineage

CELLS = 200_000
ROUNDS = 50
#: Shares of words kept, and the power that flattens the observed shares to targets.
KEEP, FLATTEN = 0.9, 0.7
SEED = 17
DIMS = ("source", "lang", "topic")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """The default topic: a coarse form of the text."""
    n = F.length(text)
    marks = F.length(F.translate(text, "#$%&*!|", "")) * 20 < n * 19
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(text.contains(" | "), "table")
        .when(marks, "marked")
        .when(n < 500, "note")
        .when(n < 5000, "article")
        .otherwise("long")
    )


def rake(n: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], rounds: int = ROUNDS, close: float = 1e-9) -> np.ndarray:
    """Cell totals with the shares of ``targets`` in each dimension, as near as the filled cells allow."""
    w = n.astype(float)
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, minlength=len(target))
            factor = np.divide(target * n.sum(), have, out=np.ones(len(target)), where=have > 0)
            off = max(off, float(np.abs(factor - 1)[have > 0].max(initial=0)))
            w = w * factor[code]
        if off < close:
            break
    return w


def level(n: np.ndarray, factor: np.ndarray, keep: float) -> float:
    """The level at which min(1, level * factor) keeps that share of the words."""
    low, high = 0.0, 1.0
    want = keep * n[factor > 0].sum()
    while (n * np.minimum(1, high * factor)).sum() < want and high < 1e12:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.minimum(1, mid * factor)).sum() < want else (low, mid)
    return high


def tempered(totals: dict, power: float = FLATTEN) -> dict:
    raised = {k: float(v) ** power if v else 0.0 for k, v in totals.items()}
    return {k: v / (sum(raised.values()) or 1.0) for k, v in raised.items()}


def chances(
    profile: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, cells: int = CELLS, clipped: bool = True
) -> DataFrame:
    """(source, lang, topic, chance) of each cell of ``profile``, which has a row per document with n_words.

    Not ``clipped``, the chance is the weight and may exceed 1.  ``targets`` has shares by dimension and value; a dimension it lacks gets its flattened shares.
    """
    spark = profile.sparkSession
    table = cut_lineage(profile.groupBy(*DIMS).agg(F.sum("n_words").alias("n")))
    count = table.count()
    if count > cells:
        return _chances_in_spark(table, targets, keep, clipped)
    kinds = ", ".join(f"{d} {table.schema[d].dataType.simpleString()}" for d in DIMS)
    if not count:
        return spark.createDataFrame([], f"{kinds}, chance double")
    rows = sorted(table.collect(), key=lambda r: tuple((r[d] is None, str(r[d])) for d in DIMS))
    n = np.array([r["n"] or 0 for r in rows], float)
    codes, wanted = [], []
    for d in DIMS:
        values = sorted({r[d] for r in rows}, key=lambda v: (v is None, str(v)))
        number = {v: k for k, v in enumerate(values)}
        code = np.array([number[r[d]] for r in rows], int)
        totals = dict(zip(values, np.bincount(code, n, minlength=len(values)), strict=True))
        share = (targets or {}).get(d) or tempered(totals)
        codes.append(code)
        wanted.append(np.array([share.get(v, 0.0) for v in values]))
    fitted = rake(n, codes, wanted)
    factor = np.divide(fitted, n, out=np.ones(len(n)), where=n > 0)
    at, most = (level(n, factor, keep), 1.0) if clipped else (keep, np.inf)
    out = [(*(r[d] for d in DIMS), float(min(most, at * f))) for r, f in zip(rows, factor, strict=True)]
    return spark.createDataFrame(out, f"{kinds}, chance double")


def _chances_in_spark(table: DataFrame, targets: dict[str, dict] | None, keep: float, clipped: bool, rounds: int = ROUNDS, close: float = 1e-6) -> DataFrame:
    total = float(table.agg(F.sum("n")).first()[0] or 0)
    now = table.withColumn("w", F.col("n").cast("double"))
    for _ in range(rounds):
        off = 0.0
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum("n").alias("had"), F.sum("w").alias("has"))
            given = (targets or {}).get(d)
            if given:
                share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(d)), F.lit(0.0))
            else:
                raised = F.pow("had", F.lit(FLATTEN))
                share = raised / sums.agg(F.sum(raised)).scalar()
            factor = F.when(F.col("has") > 0, share * total / F.col("has")).otherwise(1.0)
            sums = cut_lineage(sums.select(F.col(d).alias("value"), factor.alias("factor")))
            off = max(off, sums.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            now = now.join(sums, F.col(d).eqNullSafe(F.col("value"))).withColumn("w", F.col("w") * F.col("factor")).drop("value", "factor")
        now = cut_lineage(now)
        if off < close:
            break
    now = cut_lineage(now.withColumn("f", F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(1.0)))
    if not clipped:
        return now.select(*DIMS, (F.col("f") * keep).alias("chance"))
    want = keep * float(now.filter("f > 0").agg(F.sum("n")).first()[0] or 0)
    kept = lambda x: float(now.agg(F.sum(F.col("n") * F.least(F.lit(1.0), F.col("f") * x))).first()[0] or 0)
    low, high = 0.0, 1.0
    while kept(high) < want and high < 1e12:
        high *= 2
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < want else (low, mid)
    return now.select(*DIMS, F.least(F.lit(1.0), F.col("f") * high).alias("chance"))


def profile(docs: DataFrame, id_col: str = "doc_id", text: str = "text", topic: Column | None = None) -> DataFrame:
    topic = form(F.col(text)) if topic is None else topic
    return docs.select(F.col(id_col).alias("doc_id"), "source", "lang", topic.alias("topic"), words(F.col(text)).alias("n_words"))


def draw(id_col: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 for each id."""
    return (F.xxhash64(id_col.cast("string"), F.lit(seed)) / F.lit(2.0**64)) + 0.5


def placed(df: DataFrame, chance: DataFrame) -> DataFrame:
    """``df`` with the chance of its cell; both have the three dimensions."""
    side = chance.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("chance").alias("__chance"))
    same = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMS]
    return df.join(small(side, side.count()), same, "left").drop(*[f"__{d}" for d in DIMS])


def copies(id_col: Column, weight: Column) -> Column:
    """Whole copies of a document: the weight rounded up or down by its draw."""
    return (F.floor(weight) + (draw(id_col) < weight - F.floor(weight)).cast("long")).cast("long")


def weighted(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, id_col: str = "doc_id", text: str = "text", added: tuple[str, str] = ("weight", "copies")) -> DataFrame:
    """All documents, with their weight and copies under the names of ``added``; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in added]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__in_{k}") for k, c in enumerate(names)], "source", "lang", form(F.col(text)).alias("topic"))
    decided = placed(inner, chances(profile(docs, id_col, text), targets, keep, clipped=False))
    own, weight = F.col(f"__in_{names.index(id_col)}"), F.col("__chance")
    return decided.select(*[F.col(f"__in_{k}").alias(c) for k, c in enumerate(names)], weight.alias(added[0]), copies(own, weight).alias(added[1]))


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled documents, all columns kept."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__in_{k}") for k, c in enumerate(names)], "source", "lang", form(F.col(text)).alias("topic"))
    decided = placed(inner, chances(profile(docs, id_col, text), targets, keep))
    own = F.col(f"__in_{names.index(id_col)}")
    return decided.filter(draw(own) < F.col("__chance")).select(*[F.col(f"__in_{k}").alias(c) for k, c in enumerate(names)])


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(profile(spark.read.parquet(f"{folder}/documents.parquet")))
    decided = placed(rows, chances(rows, clipped=False)).withColumnRenamed("__chance", "weight")
    mixed = decided.withColumn("copies", copies(F.col("doc_id"), F.col("weight")))
    return mixed.withColumn("chance", F.least("weight", F.lit(1.0))).withColumn("kept", F.coalesce(F.col("copies") > 0, F.lit(False)))
