"""Exact similarity of the texts that a SimHash group or a MinHash band brings together.

A text is the set of its shingles. Texts of similarity 0.8 differ in about ten
of 64 SimHash bits, more than a covering can reach, so beside the groups of
fingerprints ``BANDS`` bands of ``ROWS`` minima each are keys too: texts of
similarity s share a band with chance 1 - (1 - s^ROWS)^BANDS, over 0.9999 at
``SIMILAR``. Texts under one key form a bucket; buckets with the same members
are compared once. In a bucket the sets themselves are compared,
and only a spanning star of each linked set leaves it, never all pairs. Equal
sets are one class and travel once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.components import components
from lexspan.llm.scratch import partitions, written

SIMILAR = 0.8  # shared shingles of a link, as a part of all of the two texts
ROWS, BANDS = 5, 24

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 1 << 64, ROWS * BANDS, np.uint64)[:, None]
_TIMES = _RNG.integers(0, 1 << 64, ROWS * BANDS, np.uint64)[:, None] | np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes, in order, of a text's shingles (UTF-8); a shorter text is one shingle, no words: none."""
    tokens = text.translate(_LOWER).split()
    h = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1) if tokens else 0
    return np.unique(np.fromiter((h(b" ".join(tokens[i : i + words]), 42) for i in range(n)), np.uint64, n))


def keys(hashes: np.ndarray) -> list[int]:
    """The bands of a set as signed 64-bit numbers; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512] ^ _FLIP) * _TIMES).min(1), out=least)
    data, width = least.tobytes(), 8 * ROWS
    named = [xxhash.xxh64_intdigest(data[k * width : (k + 1) * width], k) for k in range(BANDS)]
    return np.array(named, np.uint64).view(np.int64).tolist()


def links(sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """(root, other) places that span each set of texts linked by at least this similarity."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    mine = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    mark = np.zeros(flat.max() + 1, bool)
    out = []
    rest = np.arange(len(sets))
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            x = queue.pop()
            fit = rest[(sizes[rest] >= least * sizes[x]) & (sizes[x] >= least * sizes[rest])]
            if not len(fit):
                continue
            mark[mine[x]] = True
            both = np.add.reduceat(mark[np.concatenate([mine[k] for k in fit])].astype(np.int64), np.cumsum(sizes[fit]) - sizes[fit])
            mark[mine[x]] = False
            got = fit[both >= least * (sizes[fit] + sizes[x] - both) - 1e-9]
            if len(got):
                queue += got.tolist()
                out += [(root, k) for k in got.tolist()]
                rest = rest[~np.isin(rest, got)]
    return out


def classed(docs: DataFrame, text: str, words: int, cls: str, bands: str, fp: str, fingerprint) -> DataFrame:
    """docs with the class of each text's set (columns kept), its bands and its fingerprint."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(at).cast(pa.binary())]
            sets = [shingles(t, words) for t in texts]
            named = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            added = [pa.array(named), pa.array([keys(s) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(t, words) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, cls, bands, fp])

    schema = T.StructType([*docs.schema.fields, T.StructField(cls, T.LongType()), T.StructField(bands, T.ArrayType(T.LongType())), T.StructField(fp, T.LongType())])
    return docs.mapInArrow(run, schema)


def _sets(words: int):
    def run(batches):
        for batch in batches:
            data = [shingles(t.as_py() or b"", words).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["cls", "shingles"])

    return run


def _compare(batches):
    """Links in each bucket of rows (key, cls, shingles) sorted by key; a bucket may go on over batches."""
    key, names, sets = None, [], []

    def linked():
        pairs = links(sets) if len(sets) > 1 else []
        u, v = ([names[p[i]] for p in pairs] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for k, c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if k != key:
                if len(sets) > 1:
                    yield linked()
                key, names, sets = k, [], []
            names.append(c)
            sets.append(np.frombuffer(data.as_py(), np.uint64))
    yield linked()


def class_links(rows: DataFrame, words: int, tag: str, more: DataFrame) -> DataFrame:
    """(u, v) spanning links among the classes of written rows (cls, bands, text); more are further keys (cls, key)."""
    n = partitions(rows.sparkSession)
    member = rows.select("cls", F.explode("bands").alias("key")).unionByName(more).distinct()
    print_ = F.sum(F.xxhash64("cls").cast("decimal(38,0)"))
    buckets = member.groupBy("key").agg(F.count("*").alias("n"), print_.alias("members"), F.min("cls").alias("first")).where("n > 1")
    buckets = written(buckets.groupBy("n", "members", "first").agg(F.min("key").alias("bucket")).select("bucket"), f"{tag}-buckets")
    member = written(member.join(buckets, F.col("key") == F.col("bucket"), "left_semi"), f"{tag}-members")
    wanted = member.select(F.col("cls").alias("wanted")).distinct()
    texts = rows.select("cls", "text").join(wanted, F.col("cls") == F.col("wanted"), "left_semi").groupBy("cls").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_sets(words), "cls long, shingles binary"), f"{tag}-sets").withColumnRenamed("cls", "of")
    dealt = member.join(sets, F.col("cls") == F.col("of")).select("key", "cls", "shingles").repartition(n, "key").sortWithinPartitions("key", "cls")
    return written(dealt.mapInArrow(_compare, "u long, v long").distinct(), f"{tag}-links")


def class_groups(rows: DataFrame, words: int, tag: str, more: DataFrame) -> DataFrame:
    """(of, n, component_id) of each class of written rows (doc_id, cls, bands, text): its rows, and the smallest id reachable over links."""
    classes = written(rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{tag}-class")
    roots = components(class_links(rows, words, tag, more), tag)
    rooted = classes.join(roots, classes.cls == roots.node, "left").select("cls", "n", "least", F.coalesce("root", "cls").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    return rooted.join(ids, F.col("root") == F.col("r")).select(F.col("cls").alias("of"), "n", "component_id")
