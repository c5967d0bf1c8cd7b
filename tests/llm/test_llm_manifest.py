"""The Merkle manifest against a plain tree, and rounds of the exchange on ragged keys."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from neraca.llm import catalog, manifest
from odd import documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(leaves, fanout):
    """Root and, for each leaf, its (before, after) pairs."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, place in enumerate(at):
            low = place - place % fanout
            ways[k].append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + fanout])))
        at = [place // fanout for place in at]
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain(rows, fanout):
    """rows: (id, key, leaf); sorted (id, key, leaf, subroot, root, proof)."""
    keys = sorted({r[1] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    groups = {k: sorted((r for r in rows if r[1] == k), key=order) for k in keys}
    low = {k: climb([r[2] for r in groups[k]], fanout) for k in keys}
    root, ways = climb([low[k][0] for k in keys], fanout)
    return sorted(((*r, low[k][0], root, tuple(w + way)) for k, way in zip(keys, ways) for r, w in zip(groups[k], low[k][1])), key=repr)


def collected(df):
    return sorted(((r.id, r.key, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.proof)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2), (2, 12)])
def test_against_a_plain_tree(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    sizes = {None: 1, "": 2, "a": 3, "b": 17, "é": 8, "z": 64, "\U0001f600": 33, "～": 70}
    rows = [(rng.randrange(10**12), k, sha(f"{k}{i}")) for k, n in sizes.items() for i in range(n)]
    rows += [(None, "a", sha("null")), (5, "b", sha("x")), (5, "b", sha("y")), (5, "b", sha("y"))]
    leaves = spark.createDataFrame(rows, "id long, key string, leaf string")
    assert collected(manifest.proofs(leaves, fanout=fanout, levels=levels)) == plain(rows, fanout)


def test_every_size(spark):
    rows = [(i, f"k{n:02}", sha(f"{n}/{i}")) for n in range(1, 18) for i in range(n)]
    leaves = spark.createDataFrame(rows, "id long, key string, leaf string")
    assert collected(manifest.proofs(leaves, fanout=2, levels=1)) == plain(rows, 2)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.lang, plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in docs.collect()]
    assert collected(manifest.manifest(docs)) == plain(rows, 2)
    assert manifest.manifest(documents(spark, [])).count() == 0
    one = spark.createDataFrame([(1, "text", "en", None, 4)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = manifest.manifest(one).first()
    assert got.leaf == got.subroot == got.root and got.proof == []


def test_clashing_names(spark):
    rows = [(i, "a", "l", sha(str(i)), i, "p") for i in range(9)]
    leaves = spark.createDataFrame(rows, "id long, key string, root string, leaf string, _pos long, _block string")
    got = manifest.proofs(leaves.drop("root"), fanout=2, levels=1)
    assert got.filter(manifest.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 9 and {"_pos", "_block"} <= set(got.columns)


def test_tampering_is_found(spark):
    folder = "/root/testdata/sf0.001"
    got = catalog.QUERIES["op13_merkle_manifest"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    both = got.join(docs, "doc_id")
    assert both.count() == docs.count()
    assert both.filter(F.col("verified") == hit).count() == 0 and both.filter(hit).count() > 5
