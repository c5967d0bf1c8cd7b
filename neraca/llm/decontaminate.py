"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words at fixed positions of a mask and ignores the others, so a substituted word
that falls on an ignored position doesn't hide a match.  Benchmark seeds go to every task; each
document position is hashed under each mask and looked up; around a hit the item is laid along the
document and compared word for word.  A document leaks an item if some window of ``WINDOW`` words
(or the whole item, if shorter) has at least ``SHARE`` of its words equal in place.

The two masks hit every window of 13 words with at most 2 substitutions (``tests/llm`` proves it by
trying all).  Shorter items use one unbroken mask, as long as the substitutions allow.

Words are runs of letters and digits, A-Z in lower case.  Defined results: null and empty texts leak
nothing; items of fewer than ``LEAST`` words are not looked for; a repeated row or item gives a row
each time; a null id stays null.  Items are held ``BLOCK_BYTES`` of text at a time, and each block
costs one scan of the documents, so what a task holds is bounded for any benchmark.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.llm import tokens
from neraca.llm.arrow import append, field

WINDOW, SHARE, LEAST = 13, 0.8, 8
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 6, 7))
BLOCK_BYTES = 8 << 20
_BITS = 20


def masks_for(length: int, window: int = WINDOW, share: float = SHARE) -> tuple[tuple[int, ...], ...]:
    if length >= window:
        return MASKS
    spoiled = length - math.ceil(share * length)
    return (tuple(range(-(-(length - spoiled) // (spoiled + 1)))),)


def seeds(values: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the masked positions after each position at which the mask fits."""
    end = len(values) - mask[-1]
    if end <= 0:
        return values[:0]
    out = np.full(end, np.uint64(len(mask)))
    for k in mask:
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[k : k + end]
    return tokens.mix(out)


class Index(NamedTuple):
    """Benchmark words and, for each mask, its sorted seeds with item and offset."""

    ids: list
    words: list[np.ndarray]
    by_mask: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build(items: list[tuple[object, str | None]]) -> Index:
    column = pa.array([t for _, t in items], pa.string())
    words: list[np.ndarray] = []
    for found in tokens.words(column, tokens.ALNUM):
        bounds = found.bounds
        words += [found.hash[bounds[k] : bounds[k + 1]] for k in range(found.rows)]
    entries: dict[tuple[int, ...], list] = {}
    for n, w in enumerate(words):
        if len(w) >= LEAST:
            for mask in masks_for(len(w)):
                h = seeds(w, mask)
                entries.setdefault(mask, []).append((h, np.full(len(h), n), np.arange(len(h))))
    by_mask = []
    for mask, found in sorted(entries.items()):
        h, item, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << _BITS, bool)
        bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        by_mask.append((mask, h[order], item[order], offset[order], bits))
    return Index([i for i, _ in items], words, by_mask)


def aligned(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, share: float = SHARE) -> int:
    """Equal words of ``item`` laid at ``shift`` of ``doc``; 0 unless a window qualifies."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(window, len(item))
    if high - low < window:
        return 0
    same = np.concatenate([[0], np.cumsum(doc[low + shift : high + shift] == item[low:high])])
    return int(same[-1]) if (same[window:] - same[:-window]).max() >= math.ceil(share * window) else 0


def leaks(column: pa.Array, index: Index):
    """(row, item number, equal words, first word) of every leak; one per row and item."""
    for found in tokens.words(column, tokens.ALNUM):
        hits = []
        for mask, known, item, offset, bits in index.by_mask:
            h = seeds(found.hash, mask)
            at = np.flatnonzero(bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[found.row[at] == found.row[at + mask[-1]]]
            low, high = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            if len(at):
                entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                hits.append(np.stack([np.repeat(found.row[at], n), item[entry], np.repeat(at, n) - offset[entry]], axis=1))
        if not hits:
            continue
        bounds, best = found.bounds, {}
        for r, i, shift in np.unique(np.concatenate(hits), axis=0).tolist():
            doc = found.hash[bounds[r] : bounds[r + 1]]
            equal = aligned(doc, index.words[i], shift - int(bounds[r]))
            if equal > best.get((r, i), (0, 0))[0]:
                best[r, i] = (equal, max(0, shift - int(bounds[r])))
        for (r, i), (equal, first) in best.items():
            yield found.first + r, i, equal, first


def blocks(benchmark: DataFrame, id_col: str, text: str):
    """The items, a bounded number of bytes at a time."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.length("text") * 4)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, count)))
    for k in range(count):
        yield sorted(((r["id"], r["text"]) for r in items.filter(block == k).collect()), key=lambda x: (x[0] is None, x[0], x[1] or ""))


def leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_equal, first_word) of every leaked item of every document."""
    out = None
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([field("doc_id", kind), field("item_id", item_kind), field("n_equal", T.LongType()), field("first_word", T.LongType())])
    for items in blocks(benchmark, item_col, item_text):
        index = docs.sparkSession.sparkContext.broadcast(build(items))

        def run(batches, index=index):
            known = index.value
            for batch in batches:
                found = list(leaks(batch.column("text"), known))
                row, item, equal, first = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                named = pa.array([known.ids[i] for i in item], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, named, pa.array(equal, pa.int64()), pa.array(first, pa.int64())], schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that leak an item, all columns kept."""
    for items in blocks(benchmark, item_col, item_text):
        index = docs.sparkSession.sparkContext.broadcast(build(items))

        def compute(batch, index=index):
            bad = np.zeros(batch.num_rows, bool)
            bad[[row for row, *_ in leaks(batch.column(text), index.value)]] = True
            return [pa.array(bad)]

        docs = append(docs, [field("__leaks", T.BooleanType())], compute).filter("not __leaks").drop("__leaks")
    return docs


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
