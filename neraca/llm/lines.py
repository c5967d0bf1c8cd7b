"""Line de-duplication over a suffix array of line numbers, built by distributed prefix doubling.

A document is its sequence of non-blank lines, each named by a hash of its trimmed text; documents follow
each other by id, and every line has a position that grows by one inside a document.  Round k
ranks the suffixes by their first 2**k lines: a rank is made from the ranks of the two halves, and is
called by the earliest position that has it.  Suffixes whose rank nobody shares drop out, so a round
holds only what still repeats, and the rounds end with the longest repeat.  The suffixes of one rank
are an interval of the suffix array with that common prefix.

A suffix that has an earlier one of its rank starts a later copy.  Its run is its longest common prefix
with any earlier suffix.  Descending from its longest such rank, each round asks whether an earlier member
of the interval goes on with the same 2**k lines; if so, the suffix moves to that smaller interval, called by
its length and earliest position.  An interval's members are followed as long as a suffix waits in it, so a
member may be in several.  Suffixes whose run the line before them always extends to the left are not
followed.  Runs of at least ``LEAST_CHARS`` characters are deleted from the later document.

All steps are joins and aggregates with partial sums; none gathers more than a document's own lines.  Defined
results: null and empty texts have no line and stay as they are; blank lines never match and stay; a
repeated row (same id and text) is one document, and its rows share a result; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.session import cut_lineage, discard

#: Characters of a repeated run from which later copies are deleted: about thirty words.
LEAST_CHARS = 160


def split_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, key, and of its non-blank lines the name, length and place among all lines."""
    named = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("key"), split_lines(F.col(text)).alias("raw"))
    line = lambda x, k: F.struct(F.xxhash64(x).alias("name"), F.length(x).alias("chars"), k.alias("at"))
    kept = F.filter(F.transform("raw", line), lambda x: x["chars"] > 0)
    return named.select("id", "key", kept.alias("lines")).filter(F.size("lines") > 0).dropDuplicates(["key"])


def positions(lines: DataFrame) -> DataFrame:
    """(pos, key, k, left, name): a row per line; pos follows the order of documents and lines."""
    ordered = lines.orderBy(F.col("id").asc_nulls_last(), "key")
    each = ordered.select("key", F.size("lines").alias("size"), F.posexplode("lines").alias("k", "line"))
    return each.select(
        F.monotonically_increasing_id().alias("pos"), "key", "k", (F.col("size") - F.col("k")).alias("left"), F.col("line.name").alias("name")
    )


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """(pos, left, rank) of the rows whose ``by`` others share; the rank is the earliest pos."""
    ranks = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("rank")).filter("n > 1").drop("n")
    return rows.join(ranks, list(by)).select("pos", "left", "rank")


def doubling(lines: DataFrame) -> list[DataFrame]:
    """Written tables (pos, left, rank), one per round, for prefixes of 1, 2, 4, ... lines."""
    rounds = [cut_lineage(_repeated(lines.select("pos", "left", "name"), "name"))]
    while not rounds[-1].isEmpty():
        half = 1 << (len(rounds) - 1)
        follow = rounds[-1].select((F.col("pos") - half).alias("pos"), F.col("rank").alias("second"))
        head = rounds[-1].filter(F.col("left") >= 2 * half).select("pos", "left", F.col("rank").alias("first"))
        rounds.append(cut_lineage(_repeated(head.join(follow, "pos"), "first", "second")))
    return rounds


def _heads(rounds: list[DataFrame]) -> DataFrame:
    """(pos, k, rank): the longest rank with an earlier member, unless every place of the line follows one same line.

    Then the line before has the same earlier copies, and its run holds this one.
    """
    later = None
    for k, table in enumerate(rounds[:-1]):
        own = table.filter("rank < pos").select("pos", F.struct(F.lit(k).alias("k"), "rank").alias("best"))
        later = own if later is None else later.unionByName(own)
    best = later.groupBy("pos").agg(F.max("best").alias("best")).select("pos", "best.k", "best.rank")
    count = lambda table, name: table.groupBy("rank").agg(F.count(F.lit(1)).alias(name), F.min("pos").alias("first"))
    pairs = count(rounds[1], "pairs").select((F.col("first") + 1).alias("second"), "pairs")
    named = rounds[0].join(pairs, F.col("pos") == F.col("second")).select("rank", "pairs")
    bound = named.join(count(rounds[0], "places"), "rank").filter("pairs = places").select("rank")
    return best.join(rounds[0].join(bound, "rank").select("pos"), "pos", "left_anti")


def later_runs(rounds: list[DataFrame]) -> DataFrame:
    """(pos, size): the longest run of lines from pos that any earlier place has, left out where the one before holds it."""
    if len(rounds) == 1:
        return rounds[0].select("pos", F.lit(0).alias("size"))
    heads = cut_lineage(_heads(rounds))
    # A row per member of an interval: own, where the suffix itself waits in it.
    state = None
    for k in reversed(range(len(rounds) - 1)):
        waiting = heads.filter(F.col("k") == k)
        members = rounds[k].join(waiting.select("rank").distinct(), "rank").join(waiting.select("pos", F.lit(True).alias("own")), "pos", "left")
        fresh = members.select("pos", "left", F.lit(1 << k).alias("size"), F.col("rank").alias("first"), F.coalesce("own", F.lit(False)).alias("own"))
        if state is None:
            state = cut_lineage(fresh)
            continue
        follow = rounds[k].select((F.col("pos")).alias("there"), F.col("rank").alias("next"))
        asked = state.filter(F.col("left") >= F.col("size") + (1 << k)).withColumn("there", F.col("pos") + F.col("size")).join(follow, "there")
        by = ["size", "first", "next"]
        smaller = asked.groupBy(*by).agg(F.min("pos").alias("lead"), F.max(F.when(F.col("own"), F.col("pos"))).alias("last")).filter("lead < last")
        inner = cut_lineage(asked.join(smaller.drop("last"), by).select("pos", "left", "size", "first", "lead", "own", (F.col("own") & (F.col("lead") < F.col("pos"))).alias("moves")))
        moved = inner.select("pos", "left", (F.col("size") + (1 << k)).alias("size"), F.col("lead").alias("first"), F.col("moves").alias("own"))
        gone = inner.filter("moves").select("pos", "size", "first", F.lit(True).alias("gone"))
        stay = state.join(gone, ["pos", "size", "first"], "left").withColumn("own", F.col("own") & F.col("gone").isNull()).drop("gone")
        awaited = stay.filter("own").select("size", "first").distinct()
        after = cut_lineage(stay.join(awaited, ["size", "first"]).select(*fresh.columns).unionByName(moved).unionByName(fresh))
        discard(state, inner)
        state = after
    return state.filter("own").select("pos", "size")


def deletions(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lines, deleted) of documents with lines; deleted has the places of lines to go."""
    lines = cut_lineage(document_lines(docs, id_col, text))
    table = cut_lineage(positions(lines))
    runs = later_runs(doubling(table))
    placed = table.select("pos", "key", "k").join(runs, "pos").groupBy("key").agg(F.collect_list(F.struct("k", "size")).alias("runs"))
    joined = lines.select("key", "lines").join(placed, "key", "left")
    chars = lambda r: F.aggregate(F.slice("lines", r["k"] + 1, r["size"]), F.lit(0), lambda a, x: a + x["chars"])
    long = F.filter(F.coalesce("runs", F.array().cast("array<struct<k:int,size:int>>")), lambda r: chars(r) >= least_chars)
    marked = joined.withColumn("runs", long)
    covered = lambda k: F.exists("runs", lambda r: (k >= r["k"]) & (k < r["k"] + r["size"]))
    gone = F.transform(F.filter(F.transform("lines", lambda x, k: F.struct(x["at"].alias("at"), covered(k).alias("gone"))), lambda x: x["gone"]), lambda x: x["at"])
    return marked.select("key", F.size("lines").alias("n_lines"), F.when(F.size("runs") > 0, gone).otherwise(F.array().cast("array<int>")).alias("deleted"))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the later copies of repeated runs; a document may end up with an empty text."""
    found = deletions(docs, least_chars, id_col, text).filter(F.size("deleted") > 0).select(F.col("key").alias("__key"), F.col("deleted").alias("__gone"))
    joined = docs.withColumn("__key", F.xxhash64(id_col, text)).join(found, "__key", "left")
    kept = F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains("__gone", k))
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__key", "__gone")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = deletions(docs).withColumn("n_deleted", F.size("deleted").cast("long"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).join(found, "key", "left")
    none = F.array().cast("array<int>")
    return rows.select(
        "doc_id", F.coalesce(F.col("n_lines").cast("long"), F.lit(0)).alias("n_lines"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"),
        F.coalesce("deleted", none).alias("deleted"),
    )
