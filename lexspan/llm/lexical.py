"""Ranked lexical search by windowed bucket scoring.

The index holds, for each window of at most ``WIDTH`` documents, the postings
of the queries' terms inverted: terms, and for each its slots in the window and
counts. Documents are numbered in the order in which they are read, so windows
are fixed ranges of document numbers, and their doc_ids stand beside. The window
is the unit of scoring: the postings of a query's terms are added into an
array of scores that fits the cache, a bitset marks the slots touched, and
these are harvested into the query's heap of the best.

Nothing but the heaps leaves a task. They meet by item and a salt first, then
by item, so that the last task of an item sees at most ``SALTS`` heaps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import written

BEST = 50
WIDTH = 4096  # slots of a window: 32 KB of scores
WINDOW_TERMS = 4_000_000  # terms after which a window is closed before it is full
BLOCK_BYTES = 4 << 20  # of the queries' texts that are told to the tasks at once
SALTS = 64

#: A-Z are lowered; what is no part of a term becomes a space. Bytes of characters beyond ASCII are parts of terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BIT = (1 << np.arange(8)).astype(np.uint8)
_LAST = -(1 << 64)  # a null doc_id comes after all others


def terms(text: bytes) -> list[bytes]:
    """The terms of a text (UTF-8), in order, repeats included."""
    return text.translate(_FOLD).split()


def index(docs: DataFrame, vocabulary: dict[bytes, int], tag: str) -> DataFrame:
    """The written windows of a frame (doc_id, text) for the terms of a vocabulary.

    doc_ids and lengths are by slot; terms ascend, dfs are their postings;
    slots (16-bit) and counts (32-bit) of all postings follow one another.
    """
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def window(ids: list, lengths: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        slot = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        keys = np.concatenate(found) * WIDTH + slot
        keys, counts = np.unique(keys[keys >= 0], return_counts=True)
        own, dfs = np.unique(keys // WIDTH, return_counts=True)
        row = {
            "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())),
            "terms": pa.array([own.tolist()], pa.list_(pa.int32())),
            "dfs": pa.array([dfs.tolist()], pa.list_(pa.int32())),
            "slots": pa.array([(keys % WIDTH).astype("<u2").tobytes()], pa.binary()),
            "counts": pa.array([counts.astype("<u4").tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches):
        number = told.value
        ids, lengths, found, total = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = terms(text.as_py() or b"")
                ids.append(doc_id)
                lengths.append(len(words))
                found.append(np.fromiter((number.get(w, -1) for w in words), np.int64, len(words)))
                total += len(words)
                if len(ids) == WIDTH or total >= WINDOW_TERMS:
                    yield window(ids, lengths, found)
                    ids, lengths, found, total = [], [], [], 0
        if ids:
            yield window(ids, lengths, found)

    schema = "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, dfs array<int>, slots binary, counts binary"
    return written(docs.mapInArrow(run, schema), f"{tag}-index")


class Heap:
    """The best of (score, doc_id): higher scores first, then smaller ids, null after all."""

    def __init__(self, best: int):
        self.best, self.rows = best, []

    def harvest(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.rows) == self.best:
            good = scores >= self.rows[0][0]
            scores, ids = scores[good], ids[good]
        if len(scores) > self.best:
            good = scores >= np.partition(scores, -self.best)[-self.best]
            scores, ids = scores[good], ids[good]
        for row in zip(scores.tolist(), (_LAST if i is None else -i for i in ids.tolist())):
            if len(self.rows) < self.best:
                heapq.heappush(self.rows, row)
            elif row > self.rows[0]:
                heapq.heapreplace(self.rows, row)


class Windows:
    """Scores the windows of an index for a list of queries, each an array of term numbers."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, best: int):
        self.queries, self.weights, self.n_docs, self.n_terms = queries, weights, n_docs, n_terms
        self.heaps = [Heap(best) for _ in queries]

    def add(self, ids: list, lengths: np.ndarray, own: np.ndarray, dfs: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
        # divisions of 64-bit integers, rounding down
        m = 100 - 50 + (50 * lengths * self.n_docs) // self.n_terms
        impacts = (1_000_000_000 * counts) // (1000 * counts + 20 * m[slots]) * np.repeat(self.weights[own], dfs)
        ends = np.cumsum(dfs)
        place = np.full(len(self.weights), -1, np.int64)
        place[own] = np.arange(len(own))
        named = np.array(ids, object)
        scores, bits = np.zeros(WIDTH, np.int64), np.zeros(WIDTH // 8, np.uint8)
        marks: dict[int, np.ndarray] = {}
        for query, heap in zip(self.queries, self.heaps):
            lists = place[query]
            lists = lists[lists >= 0]
            if not len(lists):
                continue
            for p in lists.tolist():
                at = slots[ends[p] - dfs[p] : ends[p]]
                scores[at] += impacts[ends[p] - dfs[p] : ends[p]]  # a slot is once in a list
                if len(at) < WIDTH // 16:
                    np.bitwise_or.at(bits, at >> 3, _BIT[at & 7])
                    continue
                if p not in marks:  # a long list's bits are kept for the next query
                    flags = np.zeros(WIDTH, bool)
                    flags[at] = True
                    marks[p] = np.packbits(flags, bitorder="little")
                bits |= marks[p]
            touched = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            touched = touched[scores[touched] > 0]
            heap.harvest(scores[touched], named[touched])
            scores.fill(0)
            bits.fill(0)

    def found(self) -> Iterator[tuple[int, int | None, int]]:
        """(query, doc_id, score) of all heaps."""
        for q, heap in enumerate(self.heaps):
            for score, key in heap.rows:
                yield q, None if key == _LAST else -key, score


def _block(docs: DataFrame, items: list[tuple], best: int, tag: str) -> DataFrame:
    """(item, doc_id, score): of each task the best of each of these items (item_id, text in UTF-8)."""
    spark = docs.sparkSession
    own: dict[object, dict[bytes, None]] = {}
    for item_id, text in items:
        own.setdefault(item_id, {}).update(dict.fromkeys(terms(text)))
    names, vocabulary = list(own), {}
    queries = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own[i]], np.int64) for i in names]
    windows = index(docs, vocabulary, tag)
    total = windows.agg(
        F.sum(F.expr("size(filter(lengths, x -> x > 0))")).alias("n"),
        F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("l"),
    ).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    pairs = windows.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.dfs").alias("df"))
    for r in pairs.collect():  # at most the block's terms
        weights[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    queries = [q[weights[q] > 0] for q in queries]
    told = spark.sparkContext.broadcast((queries, weights, n_docs, max(1, n_terms)))

    def run(batches):
        scorer = Windows(*told.value, best)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms_, dfs, slots, counts = (batch.column(k)[row] for k in range(6))
                scorer.add(
                    ids.as_py(), *(c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lengths, terms_, dfs)),
                    np.frombuffer(slots.as_py(), "<u2").astype(np.int64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64),
                )
        found = list(zip(*scorer.found())) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["q", "doc_id", "score"])

    best_of = windows.mapInArrow(run, "q long, doc_id long, score long")
    told_names = spark.createDataFrame([(q, i) for q, i in enumerate(names)], "q2 long, item_id long")
    return best_of.join(F.broadcast(told_names), F.col("q") == F.col("q2")).select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", tag: str = "lexical", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above zero, equal scores by ascending doc_id.

    Scores are the contract's integers. Items come in blocks of about
    ``block_bytes`` of text, by hash of their id; all documents are read once
    for each block. Null texts have no terms. Rows that share an item_id are one
    item with the terms of all; a null item_id is an id like any other. Rows of
    documents that share a doc_id are scored each; a null doc_id comes after
    others of its score. Without documents or terms there are no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.encode(F.coalesce(F.col(query_col), F.lit("")), "utf-8").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for k in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        part = _block(rows, [(r["item_id"], bytes(r["text"])) for r in some.collect()], best, f"{tag}-{k}")
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= best)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= best)
    return last.select("item_id", "rank", "doc_id", "score")
