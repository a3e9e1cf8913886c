"""SimHash near-duplicates found by anchor-point covering.

The 64 bits are cut into six parts and taken three parts at a time, six times
(``TRIPLES``), so that any four differing bits leave a triple in which at most
one bit differs. Inside a triple the anchors are the words of a covering code:
the [31,26] Hamming code, joined with all words of the one or two bits beyond
31. Every word is within covering radius 1 of an anchor, so each fingerprint is
replicated to every anchor within radius plus threshold, 1 + 1, and two that
differ in at most one bit of the triple meet at an anchor near either. At an
anchor full fingerprints are compared, and only a spanning star of each linked
set leaves it, never all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm import near
from lexspan.llm.components import components
from lexspan.llm.scratch import fresh, partitions, written
from lexspan.llm.skew import looked_up

BITS = 4  # differing bits of a link
PART_BITS = (11, 11, 11, 11, 10, 10)
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
REPLICAS = 100  # of a fingerprint, about

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of a text (UTF-8) as a signed 64-bit number; no words: zero."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(n, 8) + np.arange(8, dtype=np.int64) * 256
    ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of a frame (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> list[np.ndarray]:
    """By byte of a 31-bit word, the xor of the places (1 to 31) of its ones."""
    tables = []
    for byte in range(4):
        t = np.zeros(256, np.uint64)
        for bit in range(8):
            if 8 * byte + bit < 31:
                t[(np.arange(256) >> bit & 1) == 1] ^= np.uint64(8 * byte + bit + 1)
        tables.append(t)
    return tables


def _repairs() -> np.ndarray:
    """By syndrome, the masks of weight 1 and 2 that lead to a code word: 1 + 15 of 31 bits (0: none)."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        out[s, 0] = 1 << (s - 1)
        pairs = [(a, a ^ s) for a in range(1, 32) if a < a ^ s]
        out[s, 1:] = [(1 << (a - 1)) | (1 << (b - 1)) for a, b in pairs]
    return out


_SYNDROMES, _REPAIRS = _syndromes(), _repairs()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in fps) of every anchor within radius plus threshold of each fingerprint."""
    offsets = np.cumsum((0, *PART_BITS))
    keys, places = [], []
    at = np.arange(len(fps))
    u = lambda x: np.uint64(x)
    for k, triple in enumerate(TRIPLES):
        word, width = np.zeros(len(fps), np.uint64), 0
        for p in triple:
            word |= ((fps >> u(offsets[p])) & u((1 << PART_BITS[p]) - 1)) << u(width)
            width += PART_BITS[p]
        tag = u(k << 40)
        code, free = word & u(0x7FFFFFFF), [u(1 << b) for b in range(31, width)]
        s = np.zeros(len(fps), np.uint64)
        for byte in range(4):
            s ^= _SYNDROMES[byte][((code >> u(8 * byte)) & u(255)).astype(np.intp)]
        s = s.astype(np.intp)
        clean = s == 0
        near = word ^ _REPAIRS[s, 0]  # the code word at distance 0 or 1
        flips = [u(0), *free]
        for f in flips:
            keys.append(tag | near ^ f)
            places.append(at)
        for f, g in itertools.combinations(free, 2):  # two of the free bits: only where the code part costs nothing
            keys.append(tag | near[clean] ^ f ^ g)
            places.append(at[clean])
        off = ~clean
        for j in range(1, 16):
            keys.append(tag | word[off] ^ _REPAIRS[s[off], j])
            places.append(at[off])
    return np.concatenate(keys), np.concatenate(places)


def _replicate(batches):
    for whole in batches:
        for start in range(0, whole.num_rows, 20_000):
            fps = whole.column(0).slice(start, 20_000).to_numpy(zero_copy_only=False)
            keys, places = anchors(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[places])], names=["anchor", "fp"])


def star(fps: np.ndarray) -> list[tuple[int, int]]:
    """(least, other) links that span each linked set of distinct fingerprints.

    A member is compared with those not yet reached only, so a dense set costs
    little more than its size.
    """
    out = []
    rest = np.sort(fps)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue, members = [root], []
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= BITS
            if near.any():
                queue += (got := rest[near]).tolist()
                members += got.tolist()
                rest = rest[~near]
        out += [(int(root), m) for m in members]
    return out


def _compare(batches):
    """Links at each anchor of rows sorted by anchor; an anchor may go on over batches."""

    def links(keys, fps):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(first, len(keys)))
        two = first[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= BITS
        pairs = [(np.minimum(a, b)[near], np.maximum(a, b)[near])]
        many = [x for i, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()) for x in star(fps[i : i + n])]
        if many:
            pairs.append(tuple(np.array(many, np.int64).T))
        u, v = (np.concatenate(x) for x in zip(*pairs))
        both = np.unique(np.stack((u, v), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    keys, fps = [], []
    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        if keys and k[0] != keys[-1][-1] or (keys and k[0] != k[-1]):
            cut = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0
            yield links(np.concatenate([*keys, k[:cut]]), np.concatenate([*fps, f[:cut]]))
            keys, fps = [k[cut:]], [f[cut:]]
        else:
            keys.append(k)
            fps.append(f)
    if keys:
        yield links(np.concatenate(keys), np.concatenate(fps))


def fingerprint_links(distinct: DataFrame, count: int) -> DataFrame:
    """(u, v) spanning links among distinct fingerprints (column fp), of which there are count."""
    spark = distinct.sparkSession
    n = max(partitions(spark), -(-count * REPLICAS // 4_000_000))
    at = distinct.mapInArrow(_replicate, "anchor long, fp long")
    dealt = at.repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare, "u long, v long").distinct()


def _rooted(rows: DataFrame, tag: str) -> DataFrame:
    """(fp, n, least, root) of the fingerprints of written rows (doc_id, fp); linked ones share their root."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{tag}-class")
    links = written(fingerprint_links(classes.select("fp"), classes.count()), f"{tag}-links")
    roots = components(links, tag)
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, tag: str = "simhash") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable over links.

    Fingerprints link where at most four bits differ. Texts without words
    (null, empty, white space) have fingerprint zero and link like any other.
    Rows with one fingerprint share one record on the way, so copies cost
    nothing; a null id is never the smallest unless it is the only one;
    repeated rows stay repeated; an empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(fingerprints(rows, words), f"{tag}-fp")
    rooted = _rooted(rows, tag)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select(F.col("fp").alias("of"), "n", F.col("root").alias("r")).join(ids, F.col("r") == F.col("root")).select("of", "n", "component_id")
    return looked_up(rows, "fp", F.xxhash64("doc_id"), named, rows.count(), "component_id").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp="fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tag: str = "simhash") -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest id stays.

    Texts meet where the covering links their fingerprints or a band of minima
    is the same, and link where they share at least ``near.SIMILAR`` of their
    distinct shingles. Null, empty and blank texts have no shingles and are one
    class. Rows that share the id of the row that stays, and are in its
    component, are that same document and stay with it; a null id goes where
    its component has another, and a component of null ids alone stays whole.
    """
    cls, bands, fp, least = fresh(docs.columns, "cls", "bands", "fp", "component_id")
    rows = written(near.classed(docs, text_col, words, cls, bands, fp, fingerprint), f"{tag}-rows")
    key = F.col(id_col).cast("long")
    own = rows.select(key.alias("doc_id"), F.col(cls).alias("cls"), F.col(bands).alias("bands"), F.col(fp).alias("fp"), F.col(text_col).alias("text"))
    roots = _rooted(own.select("doc_id", "fp"), f"{tag}-fps").select(F.col("fp").alias("of"), F.col("root").alias("key"))
    more = own.select("cls", "fp").distinct().join(roots, F.col("fp") == F.col("of")).select("cls", "key")
    groups = near.class_groups(own, words, tag, more)
    # a row goes by its own id and text: ids may repeat over texts, and null is an id like any other
    rows = looked_up(rows, cls, F.xxhash64(key), groups.withColumnRenamed("component_id", least), rows.count(), least)
    return rows.where(key.eqNullSafe(F.col(least))).select(*docs.columns)
