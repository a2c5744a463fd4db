"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

A test item's seeds are all of its word trigrams (an item shorter than three words is its own seed).
Seeds join training passages to items; around the seeds found, words of item and passage are aligned
by Smith-Waterman (match 2, mismatch and gap -1). A score is the alignment's points over those of a
perfect copy, so paraphrased and edited copies score high; pairs that reach `least` are returned.

The passage around a seed reaches as far as an alignment of `least` through it can. It is aligned
only if the item's words that it holds could reach `least`, which leaves out most meetings by a
common trigram and no pair. A pair that reaches `least` without three words in a row is not found.

Items are a query set: they are taken in blocks of BLOCK_ITEMS items and BLOCK_BYTES bytes at most (or
one item), each broadcast with its seeds for one pass over all documents, however many documents hold an
item. The driver and the executors hold one block at a time: with several, each one's result is written
before the next is read. Texts are neither shuffled nor cut.

Defined results: null and empty texts and items match nothing. A null doc_id keeps its pairs. Rows that
are repeated give repeated pairs; of several passages of a document the best alignment counts, the first
on a tie. `contaminated` ignores extra columns; `flag` passes them through, and one that bears the name of
the result, in any case, gets `_given` added to its name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenplane.llm.common import beside, mix, tidily, word_hashes, work_dir, written

N = 3
#: Items held at once by the driver and each task.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
GROUP_BYTES = 2 << 20
_FILTER_BITS = 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    size = max(0, len(hashes) - n + 1)
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * _ODD[k]
    return mix(total)


class Index:
    """Seeds of a block of items: sorted hashes, and for each its items and places."""

    def __init__(self, ids: list[int], texts: list[str]):
        hashes, bounds, _, _ = word_hashes(texts)
        self.ids, self.words = ids, [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        seeds = []
        for item, words in enumerate(self.words):
            n = min(N, len(words))
            if not n:
                continue
            seeds += [(int(g), n, item, k) for k, g in enumerate(grams(words, n))]
        self.sizes = sorted({n for _, n, _, _ in seeds})
        by = {n: sorted((h, i, k) for h, m, i, k in seeds if m == n) for n in self.sizes}
        self.hashes = {n: np.array([h for h, _, _ in rows], np.uint64) for n, rows in by.items()}
        self.items = {n: np.array([(i, k) for _, i, k in rows], np.int64) for n, rows in by.items()}
        self.present = {}
        for n, h in self.hashes.items():
            self.present[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.present[n][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, bounds: np.ndarray):
        """Where seeds occur: arrays of document, its word, item, the item's word."""
        found = []
        for n in self.sizes:
            g = grams(hashes, n)
            at = np.flatnonzero(self.present[n][(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes[n], g[at], "left"), np.searchsorted(self.hashes[n], g[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[doc + 1]
            at, lo, hi, doc = at[inside], lo[inside], hi[inside], doc[inside]
            each = hi - lo
            entry = np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum()) if len(each) else np.zeros(0, np.int64)
            pairs = self.items[n][entry.astype(np.int64)]
            found.append(np.stack((np.repeat(doc, each), np.repeat(at, each), pairs[:, 0], pairs[:, 1]), 1))
        return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of word hashes: its points, and its end (exclusive) in the passage."""
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    steps = np.arange(len(passage) + 1)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, 2, -1)
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], diagonal)
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def match(index: Index, texts: list, least: float) -> list[tuple[int, int, float, int]]:
    """(text, item, score, end word) of every pair that reaches `least`."""
    hashes, bounds, _, _ = word_hashes(texts)
    hits = index.find(hashes, bounds)
    hits = hits[np.lexsort((hits[:, 1] - hits[:, 3], hits[:, 2], hits[:, 0]))]
    out, i = [], 0
    while i < len(hits):
        j = i
        while j < len(hits) and hits[j, 0] == hits[i, 0] and hits[j, 2] == hits[i, 2]:
            j += 1
        doc, item = int(hits[i, 0]), int(hits[i, 2])
        words, begin, stop = index.words[item], bounds[doc], bounds[doc + 1]
        needed, diagonals = least * 2 * len(words), np.unique(hits[i:j, 1] - hits[i:j, 3])
        reach = max(0, int(2 * len(words) - needed)) + 1  # more gaps than that cost too many points
        best, end = 0, 0
        for part in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > 2 * reach) + 1):
            a, b = max(begin, part[0] - reach), min(stop, part[-1] + len(words) + reach)
            if 2 * np.isin(words, hashes[a:b]).sum() < needed:
                continue
            points, last = align(words, hashes[a:b])
            if points > best:
                best, end = points, int(a - begin) + last
        if best >= needed:
            out.append((doc, item, best / (2 * len(words)), end))
        i = j
    return out


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, item_id, score (0 to 1) and end_word of all pairs of a document and a test item that it holds."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind, item_kind = rows.schema["k"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"{key} {kind}, item_id {item_kind}, score double, end_word long"
    spark, parts, blocks = docs.sparkSession, [], _blocks(items)
    block = next(blocks, None)
    while block is not None:
        after, shared = next(blocks, None), spark.sparkContext.broadcast(Index(*block))
        found = rows.mapInArrow(tidily(_searcher(shared, least)), schema)
        if after is not None or parts:
            found = written(found, f"{work_dir(spark)}/found")
            shared.destroy()
        parts.append(found)
        block = after
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def flag(docs: DataFrame, items: DataFrame, least: float = 0.5, text: str = "text", out: str = "contaminated") -> DataFrame:
    """docs with a boolean column: whether a document holds any test item."""
    at = docs.columns.index(text)
    carried = beside(docs, out)
    names = [*carried.columns, out]
    rows = carried.withColumn(out, F.lit(False))
    schema = T.StructType([*carried.schema.fields, T.StructField(out, T.BooleanType())])

    def mark(df, index):
        def run(batches):
            for batch in batches:
                held = np.array(batch.column(len(names) - 1).to_numpy(zero_copy_only=False), bool)
                for i, pairs in _groups(batch.column(at).to_pylist(), index.value, least):
                    held[[i + p[0] for p in pairs]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held)], names=names)

        return df.mapInArrow(tidily(run), schema)

    spark, blocks = docs.sparkSession, _blocks(items)
    block = next(blocks, None)
    while block is not None:
        after, shared = next(blocks, None), spark.sparkContext.broadcast(Index(*block))
        rows = mark(rows, shared)
        if after is not None:  # rows so far, as they are known, before the next block is held
            rows = written(rows, f"{work_dir(spark)}/flagged")
            shared.destroy()
        block = after
    return rows


def _blocks(items: DataFrame):
    """Ids and texts of all items, a block at a time."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or size + len(r.text) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


def _groups(texts: list, index: Index, least: float):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= GROUP_BYTES):
            size += len(texts[j] or "")
            j += 1
        yield i, match(index, texts[i:j], least)
        i = j


def _searcher(shared, least: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            for i, pairs in _groups(batch.column(1).to_pylist(), index, least):
                if pairs:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + p[0] for p in pairs])), pa.array([index.ids[p[1]] for p in pairs]), pa.array([p[2] for p in pairs], pa.float64()), pa.array([p[3] for p in pairs], pa.int64())], names=["k", "item_id", "score", "end_word"])

    return run
