"""Prefix trie of conversations by the recursion of van Emde Boas, on Spark tables.

Sequences of turns are cut at half their depth (of the next power of two).  A prefix at the cut has a name; the upper
trie ends at the named prefixes, and each of them is the root of a lower forest.  Upper tries and lower forests are
sequences of half the height, so one table holds them all and one step cuts them all, until height 1, where a row is a node.
Equal pieces under equal roots are merged in each step, so a thousand copies of a conversation are one row from the first step on.
Totals are then grafted upward: the sum over a lower forest is added, once, to its root and to all nodes above it in
the upper trie, level by level and without a step per depth.

A name is the exclusive or of hashes of (depth, turn) in two words of 64 bits: the name of a prefix is that of its
first half with that of its second, however it was cut.  Steps grow with the logarithm of the longest conversation.
No join meets a key twice but the one for the parents, whose hot ones are broadcast, at most one in ``HOT`` nodes.

Defined results: rows without conversation id are left out; turns are ordered by number, null first, then by
a digest of role and text; repeated rows are turns of their own; null role and text are empty.  An empty table has no node.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.llm.manifest import crc32_sql
from neraca.operators.ordered import rank_rows
from neraca.session import cut_lineage

#: A node of more children than this is looked up by broadcast.
HOT = 1_000_000
#: Conversation ids written together before they are hashed.
RUN = 256
WORD = r"[^\x20\x09-\x0D]+"


class Sequences(NamedTuple):
    """Turns (conv, pos from 1, turn, words) and all conversations (conv), those without turns too."""

    turns: DataFrame
    convs: DataFrame


def sequences(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Sequences:
    """Conversations in order, each turn as a digest of role and text and the number of its words."""
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("number"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))).alias("turn"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    ranked = cut_lineage(rank_rows(cut_lineage(rows), ["conv"], ["number", "turn"], "pos").drop("number"))
    return Sequences(ranked, ranked.filter("pos = 1").select("conv"))


def shared_starts(given: Sequences, family: int = 20, most: int = 4) -> Sequences:
    """Conversations rebuilt on the start of the first one of their family.

    The first ``h`` turns of conversation ``c`` give way to the first ``h`` of ``c - c % family``, all if that has
    fewer, none if it is absent; ``h`` is the CRC-32 of the decimal ``c`` modulo ``most``.
    """
    height = F.crc32(F.col("conv").cast("string")) % most
    first = F.col("conv") - F.col("conv") % family
    starts = given.turns.filter((F.col("pos") < most) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "first")
    asked = given.convs.select("conv", first.alias("first"), height.alias("h")).filter("h > 0")
    sizes = starts.groupBy("first").agg(F.max("pos").alias("size"))
    lent = asked.join(starts, "first").filter("pos <= h").select("conv", "pos", "turn", "words")
    short = asked.join(sizes, "first", "left").select("conv", (F.col("h") - F.least("h", F.coalesce("size", F.lit(0)))).alias("short")).filter("short > 0")
    own = given.turns.filter(F.col("pos") > height).join(short, "conv", "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "turn", "words")
    return Sequences(cut_lineage(lent.unionByName(own)), given.convs)


def _meet(a: Column, b: Column) -> Column:
    """The name of a prefix followed by a piece."""
    return F.struct(a["p"].bitwiseXOR(b["p"]).alias("p"), a["q"].bitwiseXOR(b["q"]).alias("q"))


def _empty() -> Column:
    return F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))


def _pieces(turns: DataFrame) -> list[DataFrame]:
    """Per height 2**k the pieces (conv, at, name, left, right) of the sequences; ``right`` is null at an end."""
    longest = turns.agg(F.max("pos")).first()[0] or 0
    name = F.struct(F.xxhash64("turn", "pos").alias("p"), F.xxhash64("pos", "turn", F.lit(1)).alias("q"))
    out = [turns.select("conv", (F.col("pos") - 1).alias("at"), name.alias("name"))]
    while 1 << (len(out) - 1) < longest:
        half = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        pairs = out[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(half(0).alias("left"), half(1).alias("right"))
        whole = F.when(F.col("right").isNull(), F.col("left")).otherwise(_meet(F.col("left"), F.col("right")))
        out.append(cut_lineage(pairs.withColumn("name", whole)))
    return out


def _merged(paths: DataFrame) -> DataFrame:
    """Equal pieces under equal roots as one: its smallest conversation and the number of all."""
    return paths.groupBy("root", "end", "at").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"))


def _cuts(pieces: list[DataFrame], paths: DataFrame) -> list[DataFrame]:
    """Paths (root, end, at, conv, n and, above height 1, mid) of each height, from the lowest; ``mid`` names the cut."""
    out = []
    for piece in reversed(pieces[1:]):
        halves = piece.select("conv", "at", "left", F.col("right").isNotNull().alias("parted"))
        cut = cut_lineage(paths.join(halves, ["conv", "at"]).withColumn("mid", _meet(F.col("root"), F.col("left"))).drop("left"))
        out.append(cut)
        low = cut.filter("parted").select(F.col("mid").alias("root"), "end", (2 * F.col("at") + 1).alias("at"), "conv", "n")
        high = cut.select("root", F.col("mid").alias("end"), (2 * F.col("at")).alias("at"), "conv", "n")
        paths = _merged(high.unionByName(low))
    out.append(cut_lineage(paths))
    return out[::-1]


def _totals(cuts: list[DataFrame], values: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums over all nodes below each node (end, names), and below the root of all; ``values`` is (end, names)."""
    sums = [F.sum(n).alias(n) for n in names]
    forests = [cut_lineage(cuts[0].join(values, "end").groupBy("root", "at").agg(*sums))]
    for paths in cuts[:-1]:
        # The forests below the cuts of the next height join the sums of the tries above them.
        low = forests[-1].filter("at % 2 = 1").select(F.col("root").alias("end"), *names)
        grafted = paths.filter("at % 2 = 0").select("root", "at", "end").join(low, "end").drop("end")
        both = forests[-1].filter("at % 2 = 0").unionByName(grafted.select("root", "at", *names))
        forests.append(cut_lineage(both.groupBy("root", F.shiftright("at", 1).alias("at")).agg(*sums)))
    added = cuts[-1].select("root", "end", *[F.lit(0).cast("long").alias(n) for n in names])
    for k in range(len(cuts) - 1, 0, -1):
        # What lies below a path lies below both of its halves; the lower forest lies below the upper half.
        split = cuts[k].join(added, ["root", "end"])
        low = split.filter("parted").select(F.col("mid").alias("root"), "end", *names)
        high = split.groupBy("root", F.col("mid").alias("end")).agg(*sums)
        grafts = forests[k - 1].filter("at % 2 = 1").select(F.col("root").alias("end"), *[F.col(n).alias(f"_{n}") for n in names])
        high = high.join(grafts, "end", "left").select("root", "end", *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])
        added = cut_lineage(high.unionByName(low))
    return added.drop("root"), forests[-1].select(*names)


def _ends(convs: DataFrame) -> DataFrame:
    """(end, ends_sha256, n_ends): hash of the ascending decimal ids of the conversations that end at a node.

    Ids are joined in runs and the runs of a node hashed one after the other, in order, so no list is held.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    runs = convs.groupBy("end", F.floor(F.col("conv") / RUN).alias("run")).agg(F.array_join(ids, ",").alias("ids"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("end.p", "end.q", "run", "ids", "n").repartition("p", "q").sortWithinPartitions("p", "q", "run")

    def hashed(batches):
        node, state, n = None, None, 0
        for batch in batches:
            found = []
            for p, q, ids_, count in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "ids", "n"))):
                if (p, q) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        found.append((*node, state.hexdigest(), n))
                    node, state, n = (p, q), hashlib.sha256(), 0
                state.update(ids_.encode())
                n += count
            yield _batch(found)
        if node is not None:
            yield _batch([(*node, state.hexdigest(), n)])

    return runs.mapInArrow(hashed, "p long, q long, ends_sha256 string, n_ends long").select(F.struct("p", "q").alias("end"), "ends_sha256", "n_ends")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"p": pa.int64(), "q": pa.int64(), "ends_sha256": pa.string(), "n_ends": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _with_parents(nodes: DataFrame, hot: int | None) -> DataFrame:
    """``nodes`` and the smallest conversation of each one's parent."""
    names = nodes.select(F.col("end").alias("root"), F.col("conv").alias("parent_conv_id"), "n_children")
    crowded = F.col("n_children") > (HOT if hot is None else hot)
    few = F.broadcast(names.filter(crowded).select("root", F.col("parent_conv_id").alias("_hot")))
    marked = nodes.join(few, "root", "left")
    alone = marked.filter("_hot is null").drop("_hot").join(names.filter(~crowded).drop("n_children"), "root", "left")
    return alone.unionByName(marked.filter("_hot is not null").withColumnRenamed("_hot", "parent_conv_id"))


def trie(given: Sequences, hot: int | None = None) -> DataFrame:
    """Nodes of the trie: node (its name), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, n_ends and ends_sha256 of the conversations that end there."""
    turns = given.turns
    pieces = _pieces(turns)
    wholes = pieces[-1].select("conv", "at", F.col("name").alias("end"))
    paths = _merged(wholes.select(_empty().alias("root"), "end", "at", "conv", F.lit(1).cast("long").alias("n")))
    cuts = _cuts(pieces, paths)
    children = cuts[0].groupBy(F.col("root").alias("end")).agg(F.count(F.lit(1)).alias("n_children"))
    words = turns.select("conv", (F.col("pos") - 1).alias("at"), "words")
    nodes = cuts[0].join(children, "end", "left").join(words, ["conv", "at"]).select(
        "root", "end", (F.col("at") + 1).alias("depth"), "conv", "n",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("words")).alias("saved"),
    )
    nodes = cut_lineage(nodes)
    names = ["leaves", "saved"]
    below, all_below = _totals(cuts, nodes.select("end", *names), names)
    below = below.select("end", *[F.col(n).alias(f"_{n}") for n in names])
    every = given.convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    first = children.filter(F.col("end") == _empty()).agg(F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"))
    rest = all_below.agg(F.coalesce(F.max("leaves"), F.lit(1)).alias("_leaves"), F.coalesce(F.max("saved"), F.lit(0)).alias("_saved"))
    root = every.join(F.broadcast(first)).join(F.broadcast(rest)).select(
        F.lit(None).cast("struct<p:bigint,q:bigint>").alias("root"), _empty().alias("end"), F.lit(0).cast("long").alias("depth"), "conv", "n", "n_children", "_leaves", "_saved"
    )
    summed = nodes.join(below, "end").withColumn("_leaves", F.col("leaves") + F.col("_leaves")).withColumn("_saved", F.col("saved") + F.col("_saved"))
    whole = cut_lineage(root.unionByName(summed.drop("leaves", "saved").select(*root.columns)))
    mute = given.convs.join(turns.filter("pos = 1").select("conv"), "conv", "left_anti")
    ends = _ends(wholes.select("conv", "end").unionByName(mute.select("conv", _empty().alias("end"))))
    none = hashlib.sha256(b"").hexdigest()
    found = _with_parents(whole, hot).join(ends, "end", "left")
    return found.select(
        F.col("end").alias("node"), F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"),
        F.coalesce("n_ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    return trie(shared_starts(sequences(table))).drop("node", "n_ends")


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT conv_id, list({{'k': sha256(sha256(role) || sha256(text)),
    'words': len(regexp_extract_all(text, '{WORD}'))}} ORDER BY pos) AS l
  FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, {crc32_sql("conv_id")} % 4 AS h FROM s),
r AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.l, 1, c.h), []), list_slice(c.l, c.h + 1, len(c.l))) AS l
  FROM h c LEFT JOIN s b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (
  SELECT conv_id, d, list_transform(list_slice(l, 1, d), lambda x: x.k) AS k, l[d].words AS words, len(l) = d AS ends
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM r)),
n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words), 0) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, k),
c AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.k = n.k),
a AS (
  SELECT list_slice(k, 1, up) AS k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM v) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, a.n_leaves, a.saved_tokens, v.ends_sha256
FROM v JOIN a ON a.k = v.k LEFT JOIN v u ON v.d > 0 AND u.k = list_slice(v.k, 1, v.d - 1)"""
