"""Exact Jaccard join of word-shingle sets over a token-group matrix, and its components.

1. Equal sets are one node.  Every node's tokens are dealt by hash into ``m`` parts, ``m`` fixed
   per class of set sizes.  Linked sets differ in at most ``D`` tokens, so at least ``m - D``
   of their parts are equal; a part's content is its signature.
2. Nodes are verified against the most central nodes among those they share signatures with.  Verified
   stars, joined to components, are the groups: each holds similar documents.
3. Nodes of signatures that several groups still share meet in the token-group matrix: a row says that
   a token is among the rarest of some member of a group.  A query looks up its own rarest tokens;
   rarest by the count among these nodes, and as many as a link can't do without, so a text that only shares a
   common passage, or differs from its like in tokens of its own, finds nothing.
4. The tokens of each group found are united, as 1024 bits: tokens of a query on bits that the union lacks are in no
   member, which bounds its overlap with any.  Only groups that reach what a link needs are opened, and their members
   verified, but for those whose sketch differs in more bits than a link may differ in tokens.

Of its parts beyond ``D + 1`` a node leaves out the smallest, by size and content, and of the others those that
are frequent, if they are no more than the spare ones.  Both sides judge a part by its content alone, so
equal parts fall together and at least one that both keep remains: no link is lost.

Defined results: null and empty texts, and texts of separators only, have no shingle and link with
nothing; with fewer words than a shingle the whole sequence is one.  Repeated rows are equal sets.
Null ids are taken as the largest; a component of null ids alone has a null id.  Extra columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.llm import tokens
from neraca.llm.components import components
from neraca.session import cut_lineage, discard

#: Parts beyond ``D + 1``, as shares of it: the smallest, which are left out, and those that may be left out
#: as frequent; documents of a frequent part.
SMALLEST, SPARE, FREQUENT = 0.3, 0.1, 8
#: Leads that a node is held against before groups are made.
LEADS = 3
#: One signature of so many serves to find leads.
LEAD_PART = 4
#: Bits of a set's sketch, in longs.
SKETCH = 16
#: Rows of a table of a few long columns that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@lru_cache
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First size, number of parts, smallest and spare parts of each class.

    A link reaches at most the next class: the classes widen by more than 100 / percent.
    """
    widen, first = max(1.4, 1.3 * 100 / percent), [1]
    while first[-1] < 1 << 40:
        first.append(int(first[-1] * widen) + 1)
    far = np.array([(100 - percent) * 2 * (b - 1) // (100 + percent) for b in first[1:]])
    least, spare = (np.ceil(share * (far + 1)).astype(np.int64) * (far > 0) for share in (SMALLEST, SPARE))
    return np.array(first), far + 1 + least + spare, least, spare


def parts(row: np.ndarray, value: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and tag of the parts of each set; a set that can only equal others has none.

    The tag is the number of frequent parts the row may leave out; a row's two schemes are told apart by the
    lowest bit.
    """
    first, count, least, spare = size_classes(percent)
    size = np.bincount(row, minlength=rows)
    own = np.maximum(np.searchsorted(first, size, "right") - 1, 0)
    out = []
    for step in (0, 1):
        scheme = own + step
        take = (size > 0) & (count[scheme] > 1)
        if step:
            take &= size * 100 >= percent * first[scheme]
        if not take.any():
            continue
        picked = take[row]
        r, v = row[picked], value[picked]
        m = np.where(take, count[scheme], 0)
        start = np.concatenate([[0], np.cumsum(m)])
        # One cell for each part of each row, empty ones too; tokens come in the order of their parts.
        part = ((v >> np.uint64(32)) * m[r].astype(np.uint64)) >> np.uint64(32)
        cell = start[r] + part.astype(np.int64)
        bounds = np.searchsorted(cell, np.arange(start[-1] + 1))
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(tokens.mix(v), out=total[1:])
        n, content = np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]
        pr = np.repeat(np.arange(rows), m)
        number = (np.arange(start[-1]) - start[pr]).astype(np.uint64)
        key = tokens.mix(content + tokens.mix((number << np.uint64(16)) + scheme[pr].astype(np.uint64)) + n.astype(np.uint64))
        order = np.lexsort((key, n, pr))
        keep = order[np.arange(start[-1]) - start[pr] >= least[scheme[pr]]]
        out.append((pr[keep], key[keep], (spare[scheme[pr[keep]]] * 2 + step).astype(np.int32)))
    if not out:
        return row[:0], value[:0], np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nodes_of(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles and 64-bit name of each set."""
    size = np.bincount(row, minlength=rows)
    return size, tokens.mix(tokens.sums_by_row(row, tokens.mix(value), rows) + size.astype(np.uint64))


def sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Per row, ``SKETCH`` longs whose bits are toggled by the tokens that fall on them."""
    size = 64 * SKETCH
    odd = np.bincount(row.astype(np.int64) * size + (value & np.uint64(size - 1)).astype(np.int64), minlength=rows * size) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, size), axis=1).view(np.int64)


def present(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Per row, ``SKETCH`` longs with the bits that its tokens fall on."""
    size = 64 * SKETCH
    on = np.zeros(rows * size, np.uint8)
    on[row.astype(np.int64) * size + (value & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(on.reshape(rows, size), axis=1).view(np.int64)


def apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ: at most the tokens that only one of the sets has."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """Per document: id, key, number of shingles, node, sketch and bits of its tokens."""

    def run(batches):
        for batch in batches:
            size, node, bits, on = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for found in tokens.words(batch.column("text"), most_rows=512):
                row, value = tokens.word_sets(found, words)
                n, name = nodes_of(row, value, found.rows)
                size.append(n)
                node.append(name)
                bits.append(sketches(row, value, found.rows).ravel())
                on.append(present(row, value, found.rows).ravel())
            size, node = np.concatenate(size), np.concatenate(node).view(np.int64)
            sketch = [tokens.lists(np.concatenate(x), np.arange(len(size) + 1) * SKETCH, pa.int64()) for x in (bits, on)]
            arrays = [batch.column("id"), batch.column("key"), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), *sketch]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "n_shingles", "node", "bits", "on"])

    return docs.mapInArrow(run, "id long, key long, n_shingles long, node long, bits array<long>, on array<long>")


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, node, tag): a row per kept part of every document; too many to write, so found from the texts."""

    def run(batches):
        for batch in batches:
            for found in tokens.words(batch.column("text")):
                row, value = tokens.word_sets(found, words)
                _, name = nodes_of(row, value, found.rows)
                pr, key, tag = parts(row, value, found.rows, percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(name.view(np.int64)[pr]), pa.array(tag)], ["sig", "node", "tag"])

    return docs.select("text").mapInArrow(run, "sig long, node long, tag int")


class Sets:
    """Token sets of picked nodes, found again from the texts."""

    def __init__(self, docs: DataFrame, signed: DataFrame, candidates: DataFrame, words: int):
        named = signed.filter("node is not null").select("node", "key", "n_shingles", "bits", "on").join(candidates, "node", "left_semi")
        first = F.min_by(F.struct(F.col("n_shingles").alias("n"), "bits", "on"), "key")
        kept = cut_lineage(named.groupBy("node").agg(F.min("key").alias("key"), first.alias("f")).select("node", "key", "f.n", "f.bits", "f.on"))
        self.kept, self.keys, self.sketch = kept, kept.select("node", "key"), kept.select("node", "n", "bits", "on")
        self.count = kept.count()
        self.docs, self.words = docs, words

    def of(self, picked: DataFrame) -> DataFrame:
        """Rows of ``picked`` (with a column node) with the tokens of the node."""
        words = self.words
        rows = picked.count()
        wanted = small(picked.join(small(self.keys, self.count), "node"), rows)
        texts = self.docs.join(wanted, "key").drop("key", "id")
        names = [c for c in texts.columns if c != "text"]

        def run(batches):
            for batch in batches:
                values, ends = [], [np.zeros(1, np.int64)]
                for found in tokens.words(batch.column("text")):
                    row, value = tokens.word_sets(found, words)
                    values.append(value)
                    ends.append(ends[-1][-1] + np.cumsum(np.bincount(row, minlength=found.rows)))
                flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), tokens.lists(flat, np.concatenate(ends), pa.int64())], [*names, "tokens"]
                )

        kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
        return texts.mapInArrow(run, f"{kinds}, tokens array<long>")


def _verified(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (node, other) that link.  Tokens of each side are shuffled once, by ``other``."""
    left = sets.of(pairs)
    right = sets.of(pairs.select(F.col("other").alias("node")).distinct())
    right = right.select(F.col("node").alias("other"), F.col("tokens").alias("theirs"))
    both = F.size(F.array_intersect("tokens", "theirs")).cast("long")
    total = F.size("tokens").cast("long") + F.size("theirs")
    sized = F.least(F.size("tokens"), F.size("theirs")).cast("long") * 100 >= F.greatest(F.size("tokens"), F.size("theirs")) * percent
    return left.join(right, "other").filter(sized).filter(both * 100 >= (total - both) * percent).select("node", "other")


def _shared(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, node, tag, rows) of signatures that several nodes have; ``rows`` counts documents.

    The rows are dealt out once: both uses read all columns, so Spark reuses the exchange.
    """
    dealt = _signatures(docs, words, percent).repartition("sig")
    heads = dealt.groupBy("sig").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("rows"), F.max("tag").alias("tags")
    )
    heads = heads.filter("low < high and tags >= 0").select("sig", "rows")
    return dealt.join(heads.hint("shuffle_hash"), "sig").distinct()


def _needed(shared: DataFrame) -> DataFrame:
    """``shared`` without the frequent signatures that a node may leave out."""
    frequent = F.col("rows") > FREQUENT
    spent = shared.groupBy("node", F.col("tag")).agg(F.sum(frequent.cast("int")).alias("spent"))
    may = (F.col("spent") > 0) & (F.col("spent") <= F.floor(F.col("tag") / 2))
    free = spent.filter(may).select("node", "tag", F.lit(True).alias("free"))
    return shared.join(free, ["node", "tag"], "left").filter(~(frequent & F.col("free").isNotNull())).drop("free")


def _first_pairs(shared: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(node, other): each node with the leads it shares most signatures with, at most ``LEADS``.

    A signature's lead is its most central node, the one whose own signatures have most documents: in
    a family of copies, the one nearest to all.  That takes all signatures: by a part of them, a far member whose
    changes miss the part passes for the centre.  A part of them, by hash, then finds the leads; which
    leads are found decides how much is left to the matrix, never what links.
    """
    central = shared.groupBy("node").agg(F.sum("rows").alias("weight"))
    shared = shared.filter(F.pmod("sig", F.lit(LEAD_PART)) == 0)
    leads = shared.join(central, "node").groupBy("sig").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
    met = shared.select("sig", "node").join(leads, "sig").filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "lead")), asc=False), 1, LEADS).alias("best"))
    pairs = best.select("node", F.explode("best.lead").alias("other"))
    other = sets.sketch.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("theirs"))
    rated = pairs.join(sets.sketch.drop("on"), "node").join(other, "other")
    return rated.filter(_may_link(percent)).select("node", "other")


def _may_link(percent: int) -> Column:
    """Whether sizes n, m and sketches bits, theirs leave room for a link."""
    both = F.col("n") + F.col("m")
    sized = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return sized & (apart("bits", "theirs") * (100 + percent) <= both * (100 - percent))


def _rarest(hard: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(token, node, grp, n, own, short): the tokens of each node that a link can't do without.

    ``short`` marks those that suffice if the other set is at least as large.
    """
    rows = sets.of(hard.select("node")).select("node", F.explode("tokens").alias("token"))
    dealt = rows.repartition("token")
    common = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = dealt.join(common.hint("shuffle_hash"), "token").groupBy("node")
    listed = held.agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    listed = listed.join(hard, "node").join(sets.sketch.select("node", "n"), "node")
    n, own = F.col("n"), F.col("n") - F.size("common")
    far = n - F.ceil(n * percent / 100) + 1 - own
    near = n - F.ceil(n * 2 * percent / (100 + percent)) + 1 - own
    picked = F.slice("common", 1, F.greatest(F.least(far, F.size("common")), F.lit(0)).cast("int"))
    each = listed.select("node", "grp", "n", own.alias("own"), near.alias("near"), F.posexplode(picked).alias("k", "c"))
    return each.select("node", "grp", "n", "own", F.col("c.token").alias("token"), (F.col("k") < F.col("near")).alias("short"))


def _open_groups(shared: DataFrame, groups: DataFrame, tested: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Pairs (node, other) inside the groups that a query's overlap with their token union lets in."""
    rows = _needed(shared).join(groups, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("grp"))
    mixed = rows.groupBy("sig").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low < high").select("sig")
    hard = cut_lineage(rows.join(mixed, "sig", "left_semi").select("node", "grp").distinct())
    rare = cut_lineage(_rarest(hard, sets, percent))
    matrix = rare.filter("short").groupBy("token", F.col("grp").alias("in_grp")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (F.col("grp") != F.col("in_grp")) & (F.col("least") <= F.col("n")) & (F.col("most") * 100 >= F.col("n") * percent)
    # Tokens of its own can't be in any union.
    smallest = F.greatest(F.col("least") * 100, F.col("n") * percent)
    reached = lambda over: over * (100 + percent) * 100 >= (F.col("n") * 100 + smallest) * percent
    hits = cut_lineage(rare.join(matrix, "token").filter(fits & reached(F.col("n") - F.col("own"))).select("node", "token", "in_grp", "n", "least"))
    asked = hits.groupBy("node", "in_grp").agg(F.max("n").alias("n"), F.min("least").alias("least"))
    # Bits of a query that the union of the group lacks are tokens that no member has.
    spread = hard.join(sets.sketch.select("node", "on"), "node").groupBy(F.col("grp").alias("in_grp"))
    masks = spread.agg(F.array(*[F.bit_or(F.col("on")[k]) for k in range(SKETCH)]).alias("mask"))
    outside = F.aggregate(F.zip_with("on", "mask", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda a, x: a + x)
    asked = asked.join(sets.sketch.select("node", "on"), "node").join(masks, "in_grp").filter(reached(F.col("n") - outside))
    opened = asked.select("node", "in_grp")
    member = rare.filter("short").select("token", "node", F.col("grp").alias("in_grp")).join(sets.sketch.drop("on"), "node")
    member = member.select("token", "in_grp", F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("theirs"))
    query = hits.select("token", "node", "in_grp").join(opened, ["node", "in_grp"], "left_semi").join(sets.sketch.drop("on"), "node")
    met = (query["token"] == member["token"]) & (query["in_grp"] == member["in_grp"]) & (F.col("m") <= F.col("n")) & _may_link(percent)
    pairs = query.join(member, met).select("node", "other").distinct()
    pairs = pairs.join(tested, ["node", "other"], "left_anti")
    pairs = cut_lineage(pairs.join(tested.select(F.col("other").alias("node"), F.col("node").alias("other")), ["node", "other"], "left_anti"))
    discard(hard, rare, hits)
    return pairs


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, key, n_shingles, component_id, cluster (null without shingles).

    Documents link when 100 * |A and B| >= percent * |A or B| over distinct ``words``-word shingles;
    component_id is the smallest id reachable.  ``key`` tells rows of other id or text apart.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text).alias("key"), F.col(text).alias("text"))
    signed = cut_lineage(_signed(base, words))
    shared = cut_lineage(_shared(base, words, percent))
    candidates = shared.select("node").distinct()
    sets = Sets(base, signed, candidates, words)
    tested = cut_lineage(_first_pairs(shared, sets, percent))
    links = cut_lineage(_verified(tested, sets, percent))
    groups = components(links, "node", "other")
    opened = _open_groups(shared, groups, tested, sets, percent)
    discard(shared, tested)
    more = cut_lineage(_verified(opened, sets, percent))
    # The groups' stars stand for all links found before.
    final = components(groups.select("node", F.col("component").alias("other")).unionByName(more), "node", "other")
    discard(opened, links, more, sets.kept)
    named = signed.select("id", "key", "n_shingles", "node").join(final, "node", "left").withColumn("top", F.coalesce("component", "node"))
    lowest = named.filter("top is not null").groupBy("top").agg(F.min("id").alias("component_id"))
    joined = named.join(lowest, "top", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select("id", "key", "n_shingles", own.alias("component_id"), F.col("top").alias("cluster"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id; texts without words all stay."""
    rows = cut_lineage(near_copies(docs, words, percent, id_col, text).filter("cluster is not null"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    best = rows.groupBy("cluster").agg(F.min(order).alias("best"))
    gone = rows.join(best, "cluster").filter(F.col("key") != F.col("best.key")).select("key")
    gone = cut_lineage(gone.distinct())
    again = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key"))
    marked = docs.withColumn("__key", F.xxhash64(id_col, text))
    kept = marked.join(small(gone.withColumnRenamed("key", "__key"), gone.count()), "__key", "left_anti")
    copies = again.count()
    if not copies:
        return kept.drop("__key")
    repeats = small(again.withColumnRenamed("key", "__key"), copies)
    single = kept.join(repeats, "__key", "left_anti")
    return single.unionByName(kept.join(repeats, "__key", "left_semi").dropDuplicates(["__key"])).drop("__key")


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies(spark.read.parquet(f"{folder}/documents.parquet"), words=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
