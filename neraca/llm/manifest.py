"""Merkle manifest of a dataset: a digest of each row, a root for all, and each row's proof.

Rows of a key are ordered by id and cut into aligned blocks of ``fanout ** levels`` leaves, so a hot key is many
blocks.  A block hashes its own subtree.  Blocks then reach the root by butterfly exchange: in round r, ``fanout``
blocks at distance ``fanout ** r`` swap the roots of their subtrees, and each of them hashes the common ancestor.  Every
block thus ends with all siblings on its way up, and nothing is sent down.  The last subtree of a key may hold
fewer blocks than its neighbours; its blocks then answer several partners each, at most twice the blocks in a round.
The roots of the keys, in order of the key, exchange in the same way.

A leaf is the hash of its columns, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value.  A node is
the hash of the hexadecimal digests of a run of ``fanout`` nodes, the last run of a level being shorter, even one.

Defined results: a null key is a key of its own, the first; a null id comes first in its key; rows with equal ids
are ordered by leaf, and repeated rows have equal leaves but places of their own; empty texts differ from nulls;
an empty table has no rows and no root.  Other columns of the input are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.operators.ordered import rank_rows
from neraca.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree inside one block: 4,096 leaves at two to a node.
LEVELS = 12
#: A level of a proof: the digests left and right of the path, each run together.
STEP = "struct<before:string,after:string>"


def field_bytes(value: Column) -> Column:
    """A column as the text that is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_bytes(v) for v in values]), 256)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    up = lambda node, step: digest(F.concat(step["before"], node, step["after"]))
    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """All digests of a proof run together, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _node(run: Sequence[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def subtree(leaves: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """Digests of each level of a block; the block of a key that has no other stops at one node."""
    grown = [leaves]
    while len(grown) <= levels and not (alone and len(grown[-1]) == 1):
        low = grown[-1]
        grown.append([_node(low[k : k + fanout]) for k in range(0, len(low), fanout)])
    return grown


def exchanged(nodes: DataFrame, key: str, fanout: int, rounds: int) -> DataFrame:
    """Butterfly rounds over ``(key, place, nodes, root, proof)``: the root of each key and the way to it.

    ``place`` counts the nodes of a key from 0 and ``nodes`` is their number.
    """
    wide = F.lit(1).cast("long")
    for _ in range(rounds):
        whole = wide * fanout
        group, member = F.expr("_group"), F.col("place") % wide
        sent = nodes.withColumn("_group", F.floor(F.col("place") / whole)).withColumn("_digit", F.floor(F.col("place") / wide) % fanout)
        # A subtree of fewer nodes than its neighbours answers for the places that it lacks.
        own = F.least(wide, F.col("nodes") - (F.col("place") - member))
        widest = F.least(wide, F.col("nodes") - group * whole)
        sent = sent.withColumn("_at", F.explode(F.sequence(member, widest - 1, own)))
        mine = F.when(F.col("_at") == member, F.struct("place", "nodes", "proof"))
        seen = F.struct(F.col("_digit").alias("digit"), F.col("root").alias("root"), mine.alias("own"))
        met = sent.groupBy(key, "_group", "_at").agg(F.sort_array(F.collect_list(seen)).alias("_met"))
        each = met.select(key, "_met", F.explode(F.filter("_met", lambda m: m["own"].isNotNull())).alias("_me"))
        run = lambda keep: F.array_join(F.transform(F.filter("_met", keep), lambda m: m["root"]), "")
        step = F.struct(
            run(lambda m: m["digit"] < F.col("_me.digit")).alias("before"), run(lambda m: m["digit"] > F.col("_me.digit")).alias("after")
        )
        # A key whose nodes were one subtree before this round has its root.
        done = F.col("_me.own.nodes") <= wide
        nodes = each.select(
            key,
            F.col("_me.own.place").alias("place"),
            F.col("_me.own.nodes").alias("nodes"),
            F.when(done, F.col("_me.root")).otherwise(digest(run(lambda m: F.lit(True)))).alias("root"),
            F.when(done, F.col("_me.own.proof")).otherwise(F.concat("_me.own.proof", F.array(step))).alias("proof"),
        )
        wide = whole
    return nodes


def _rounds(most: int, fanout: int) -> int:
    rounds = 0
    while fanout**rounds < most:
        rounds += 1
    return rounds


def proofs(leaves: DataFrame, key: str = "key", order: Sequence[str] = ("id", "leaf"), fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (with a column ``leaf``) and ``subroot``, ``root`` and ``proof`` of each row."""
    if fanout < 2 or levels < 1:
        raise ValueError("a run holds at least two nodes and a block at least one level")
    names = {c: f"_x{i}" for i, c in enumerate(leaves.columns)}
    rows = leaves.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    key_, leaf = names[key], names["leaf"]
    size = fanout**levels
    placed = rank_rows(rows, [key_], [names[c] for c in order], "_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / size))
    placed = cut_lineage(placed)
    kind = placed.schema[key_].dataType.simpleString()

    def root_of(found: pa.Table) -> pa.Table:
        found = found.sort_by("_pos")
        block = found.column("_block")[0].as_py()
        top = subtree(found.column(leaf).to_pylist(), fanout, levels, block == 0 and len(found) < size)[-1][0]
        return pa.table({key_: found.column(key_).slice(0, 1), "place": pa.array([block], pa.int64()), "root": pa.array([top])})

    roots = placed.select(key_, "_block", "_pos", leaf).groupBy(key_, "_block").applyInArrow(root_of, f"{key_} {kind}, place long, root string")
    roots = cut_lineage(roots)
    counts = roots.groupBy(key_).agg(F.count(F.lit(1)).alias("nodes"))
    most = counts.agg(F.max("nodes"), F.count(F.lit(1))).first()
    none = F.array().cast(f"array<{STEP}>")
    mine, other = F.col(f"r.{key_}"), F.col(f"c.{key_}")
    nodes = roots.alias("r").join(counts.alias("c"), mine.eqNullSafe(other)).select(mine.alias(key_), "place", "nodes", "root", none.alias("proof"))
    inside = cut_lineage(exchanged(nodes, key_, fanout, _rounds(most[0] or 0, fanout)))

    # Every node of a key holds its root now; the first one speaks for the key among the keys.
    heads = inside.filter("place = 0").select(F.lit(0).alias("_all"), key_, F.col("root").alias("_sub"))
    ranked = cut_lineage(rank_rows(heads, ["_all"], [key_], "_n"))
    tops = ranked.select("_all", (F.col("_n") - 1).alias("place"), F.lit(most[1]).cast("long").alias("nodes"), F.col("_sub").alias("root"), none.alias("proof"))
    tops = exchanged(tops, "_all", fanout, _rounds(most[1], fanout)).select((F.col("place") + 1).alias("_n"), F.col("root").alias("_root"), F.col("proof").alias("_more"))
    tops = ranked.join(tops, "_n").select(F.col(key_).alias("_key"), "_sub", "_root", "_more")
    upper = inside.join(tops, F.col(key_).eqNullSafe(F.col("_key"))).select(key_, F.col("place").alias("_block"), "_sub", "_root", F.concat("proof", "_more").alias("_up"))

    kept = [f for f in placed.schema.fields if f.name not in ("_pos", "_block")]
    schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in ("_sub", "_root")], T.StructField("_proof", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("before", "after")])))])

    def finish(found: pa.Table, way: pa.Table) -> pa.Table:
        found = found.sort_by("_pos")
        block, up = found.column("_block")[0].as_py(), way.column("_up")[0].as_py()
        grown = subtree(found.column(leaf).to_pylist(), fanout, levels, block == 0 and len(found) < size)
        steps = []
        for nodes in grown[:-1]:
            level = []
            for k in range(len(nodes)):
                low = k - k % fanout
                level.append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + fanout])))
            steps.append(level)
        up = [(s["before"], s["after"]) for s in up]
        flat = [step for k in range(len(found)) for step in [*(level[k // fanout**n] for n, level in enumerate(steps)), *up]]
        length = len(steps) + len(up)
        pairs = pa.StructArray.from_arrays([pa.array([s[n] for s in flat], pa.string()) for n in (0, 1)], ["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, length * len(found) + 1, length) if length else [0] * (len(found) + 1), pa.int32()), pairs)
        found = found.drop_columns(["_pos", "_block"])
        for name in ("_sub", "_root"):
            found = found.append_column(name, pa.array([way.column(name)[0].as_py()] * len(found), pa.string()))
        return found.append_column("_proof", proof)

    whole = placed.groupBy(key_, "_block").cogroup(upper.groupBy(key_, "_block")).applyInArrow(finish, schema)
    back = {n: c for c, n in names.items()} | {"_sub": "subroot", "_root": "root", "_proof": "proof"}
    return whole.select(*[F.col(n).alias(c) for n, c in back.items()])


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "lang", id_col: str = "doc_id", fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """(id, key, leaf, subroot, root, proof) of each row of ``docs``."""
    leaves = docs.select(F.col(id_col).alias("id"), F.col(key).cast("string").alias("key"), leaf_of(*[F.col(c) for c in columns]).alias("leaf"))
    return proofs(cut_lineage(leaves), fanout=fanout, levels=levels)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = [F.col(c) if c != "n_chars" else F.col(c) + 1 for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_of(*more))
    leaves = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("key"), leaf_of(*[F.col(c) for c in COLUMNS]).alias("leaf"), tampered.alias("tampered")
    )
    rows = proofs(cut_lineage(leaves))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        digest(siblings(F.col("proof"))).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Unsigned CRC-32 of a decimal number, bit by bit.
CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''),
  lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"""


def crc32_sql(number: str) -> str:
    return f"xor({CRC32.format(number)}, 4294967295)"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf_sql(more: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c if c != "n_chars" else f"n_chars + {more}") for c in COLUMNS) + ")"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("0")} AS leaf, {_leaf_sql("1")} AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
  FROM documents),
low AS (
  SELECT 0 AS level, lang, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM low) WHERE n > 1 GROUP BY level, lang, pos // 2),
subs AS (SELECT lang, arg_max(h, level) AS subroot, max(level) AS levels FROM low GROUP BY lang),
keys AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM subs),
high AS (
  SELECT 0 AS level, pos, subroot AS h FROM keys
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, pos // 2),
tip AS (SELECT arg_max(h, level) AS root, max(level) AS levels FROM high),
steps AS (
  SELECT l.doc_id, g.level, (l.pos >> g.level) & 1 AS side, n.h
  FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang, range(64) g(level) LEFT JOIN low n
    ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = g.level AND n.pos = xor(l.pos >> g.level, 1)
  WHERE g.level < s.levels
  UNION ALL
  SELECT l.doc_id, s.levels + g.level, (k.pos >> g.level) & 1, n.h
  FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN keys k ON k.lang IS NOT DISTINCT FROM l.lang,
    tip t, range(64) g(level) LEFT JOIN high n ON n.level = g.level AND n.pos = xor(k.pos >> g.level, 1)
  WHERE g.level < t.levels),
proofs AS (
  SELECT doc_id, list({{'side': side, 'h': coalesce(h, '')}} ORDER BY level) AS proof FROM steps GROUP BY doc_id),
ways AS (
  SELECT l.*, p.proof, CASE WHEN {crc32_sql("l.doc_id")} % 7 = 0 THEN other ELSE leaf END AS given
  FROM leaves l LEFT JOIN proofs p ON p.doc_id IS NOT DISTINCT FROM l.doc_id),
fold AS (
  SELECT doc_id, lang, leaf, proof, 0 AS n, given AS h FROM ways
  UNION ALL
  SELECT doc_id, lang, leaf, proof, n + 1,
    sha256(CASE WHEN proof[n + 1].side = 1 THEN proof[n + 1].h || h ELSE h || proof[n + 1].h END)
  FROM fold WHERE n < len(proof))
SELECT f.doc_id, f.leaf, s.subroot, t.root, sha256(coalesce(list_aggregate(list_transform(proof, lambda p: p.h), 'string_agg', ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = t.root AS verified
FROM fold f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.lang, tip t WHERE f.n = coalesce(len(f.proof), 0)"""
