"""An inverted-file index of vectors, searched by cells.

Centres of cells are fitted on a bounded sample, the ``SAMPLE`` vectors with
the smallest hashes of their keys; every vector goes to its nearest cell. Equal
vectors are one row with the smallest keys of each, as many as a search can ask
for. Cells are stored in blocks of at most ``BLOCK`` vectors, so that a cell
with a third of all vectors is many rows; queries travel in blocks as well.
Blocks meet by cell, and only the best of a pair of blocks leave it.

A search probes the cells nearest to each query and ranks their vectors by
exact distance. ``exact=True`` goes on with the cells that the first pass cannot
exclude: those whose centre is nearer than their radius and the k-th best
distance together. Scores are at most 1: 1 less the squared distance, at least 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.tables import best, pieces, saved, written

SAMPLE = 20_000
CELLS = 1024  # at most; fewer where the sample has few vectors
ROUNDS = 12
BLOCK = 1024
KEPT = 100  # smallest keys of a vector, and so the largest k of a search
SLACK = 1e-6  # of distances, so that rounding excludes no vector
SPREAD = 65_536  # vectors of a cell that go to one task


def fitted(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Centres of Lloyd's rounds from distinct vectors of the sample; at most so many cells."""
    sample = np.unique(sample, axis=0)
    cells = min(cells, len(sample))
    centres = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)] if cells else sample
    for _ in range(ROUNDS):
        own = nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=cells)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, but for rounding."""
    return np.maximum(0.0, (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1))


def nearest(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance) of each row, in steps of bounded memory."""
    own, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    norms = (centres**2).sum(1)
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        own[i : i + step] = k = (norms - 2 * part @ centres.T).argmin(1)
        far[i : i + step] = ((part - centres[k]) ** 2).sum(1)
    return own, far


@dataclass(frozen=True)
class VectorIndex:
    """Below path: blocks of vectors by cell, and the cells' radii; centres are on the driver, at most ``CELLS``."""

    path: str
    centres: np.ndarray

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")

    def radii(self, spark: SparkSession) -> np.ndarray:
        """Distance of the farthest vector of each cell; a cell without vectors: minus infinity."""
        out = np.full(len(self.centres), -np.inf)
        for r in self.blocks(spark).groupBy("cell").agg(F.max("radius").alias("r")).collect():
            out[r["cell"]] = r["r"]
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distinct(vectors: DataFrame, key: str, value: str, kept: int) -> DataFrame:
    """(vector, keys): each vector once with its smallest keys, ascending."""
    rows = vectors.select(F.col(key).alias("key"), F.col(value).cast("array<double>").alias("vector")).where("key is not null and vector is not null")
    few = best(rows, ["vector"], ["key"], kept, "key")
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def _packed(width: int, size: int):
    """Rows (cell, far, vector, keys) sorted by cell to rows of blocks."""

    def block(cell: int, far: list, rows: list, keys: list) -> pa.RecordBatch:
        flat = np.concatenate([np.asarray(k, np.int64) for k in keys])
        ends = np.cumsum([len(k) for k in keys])
        row = {
            "cell": pa.array([cell], pa.int32()),
            "radius": pa.array([float(np.sqrt(max(far)))]),
            "matrix": pa.array([np.array(rows, "<f8").tobytes()], pa.binary()),
            "keys": pa.array([flat.tolist()], pa.list_(pa.int64())),
            "ends": pa.array([ends.tolist()], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches):
        cell, far, rows, keys = None, [], [], []
        for batch in pieces(batches):
            cells, fars = (batch.column(i).to_pylist() for i in (0, 1))
            matrix, lists = _matrix(batch.column(2), width), batch.column(3).to_pylist()
            for c, f, v, k in zip(cells, fars, matrix, lists):
                if rows and (c != cell or len(rows) == size):
                    yield block(cell, far, rows, keys)
                    far, rows, keys = [], [], []
                cell = c
                far.append(f)
                rows.append(v)
                keys.append(k)
        if rows:
            yield block(cell, far, rows, keys)

    return run


PACKED = "cell int, radius double, matrix binary, keys array<bigint>, ends array<bigint>"


def build(vectors: DataFrame, path: str, key: str = "vec_id", value: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of vectors (one width; null keys or vectors are left out) below path.

    There are as many cells as the square root of the sample's distinct vectors
    times four, at most ``cells``.
    """
    spark = vectors.sparkSession
    rows = written(_distinct(vectors, key, value, KEPT), "distinct")
    some = rows.select("vector", F.xxhash64(F.col("keys")[0]).alias("h")).orderBy("h").limit(sample).select("vector").collect()
    points = np.array([r["vector"] for r in some], np.float64)
    centres = fitted(points, min(cells, max(1, round(4 * len(points) ** 0.5)))) if len(points) else np.zeros((0, 1))
    width = centres.shape[1]
    told = spark.sparkContext.broadcast(centres)  # at most cells rows

    def assign(batches):
        for batch in pieces(batches):
            own, far = nearest(_matrix(batch.column(0), width), told.value)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far), *batch.columns], names=["cell", "far", "vector", "keys"])

    at = written(rows.mapInArrow(assign, "cell int, far double, vector array<double>, keys array<bigint>"), "assigned")
    # large cells are dealt by a hash of their vectors' first keys as well, so that none is one task's
    shares = [1] * max(1, len(centres))
    for r in at.groupBy("cell").count().collect():  # at most cells rows
        shares[r["cell"]] = -(-r["count"] // SPREAD)
    spread = F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(shares)[F.col("cell")])
    dealt = at.repartition("cell", spread).sortWithinPartitions("cell")
    saved(dealt.mapInArrow(_packed(width, BLOCK), PACKED), f"{path}/blocks")
    return VectorIndex(path, centres)


def _asked(queries: DataFrame, width: int, cells_of, told):
    """Rows (cell, ids, matrix, floors) of blocks of queries; cells_of gives the cells of a matrix of queries and their floors."""

    def run(batches):
        for batch in pieces(batches):
            ids, matrix = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width)
            floors = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            rows, cells = cells_of(matrix, floors, told.value)
            order = np.argsort(cells, kind="stable")
            rows, cells = rows[order], cells[order]
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else []
            out = []
            for a, b in zip(first, [*first[1:], len(cells)]):
                for i in range(a, b, 256):
                    part = rows[i : min(b, i + 256)]
                    out.append((int(cells[a]), ids[part].tolist(), matrix[part].astype("<f8").tobytes()))
            c, i, m = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.list_(pa.int64())), pa.array(m, pa.binary())], names=["of", "ids", "asked"])

    return queries.mapInArrow(run, "of int, ids array<bigint>, asked binary")


def _pairs(width: int, k: int, least: float):
    """The k best of each query of a pair of blocks, ties by key."""

    def run(batches):
        for batch in pieces(batches):
            out = []
            for ids, asked, matrix, keys, ends in zip(*(batch.column(n).to_pylist() for n in ("ids", "asked", "matrix", "keys", "ends"))):
                q, v = (np.frombuffer(x, "<f8").reshape(-1, width) for x in (asked, matrix))
                keys, ends = np.array(keys), np.array(ends)
                counts = np.diff(ends, prepend=0)
                about, slack = squared(q, v), SLACK * (1 + (v**2).sum(1).max())
                for i, x, row in zip(ids, q, about):
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack) if len(row) > k else np.arange(len(row))
                    far = ((v[near] - x) ** 2).sum(1)
                    near, far = near[1 - far >= least], far[1 - far >= least]
                    named = np.concatenate([keys[ends[j] - counts[j] : ends[j]][:k] for j in near]) if len(near) else keys[:0]
                    dist = np.repeat(far, np.minimum(counts[near], k))
                    for j in np.lexsort((named, dist))[:k].tolist():
                        out.append((i, int(named[j]), float(dist[j])))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "key", "far"])

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, least: float = 0.0, exact: bool = False, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank) of queries (query_id, query): the k nearest with a score of at least ``least``, ties by key.

    Queries with equal vectors are searched once. k is at most ``KEPT``. Null
    queries and those of another width have no rows.
    """
    if k > KEPT:
        raise ValueError(f"an index keeps {KEPT} keys of a vector, so k is at most that")
    spark = queries.sparkSession
    width = index.centres.shape[1]
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).where(F.size("query") == width)
    first = written(asked.groupBy("query").agg(F.min("query_id").alias("first")), "queries").select("first", "query")
    blocks = index.blocks(spark)

    def look(frame: DataFrame, cells_of, told) -> DataFrame:
        pairs = _asked(frame, width, cells_of, told).join(blocks, F.col("of") == F.col("cell")).select("ids", "asked", "matrix", "keys", "ends")
        return pairs.mapInArrow(_pairs(width, k, least), "query_id long, key long, far double")

    def some(matrix, floors, told):
        far = squared(matrix, told[0])
        n = min(probes, far.shape[1])
        cells = np.argpartition(far, n - 1, 1)[:, :n] if n else np.zeros((len(matrix), 0), int)
        return np.repeat(np.arange(len(matrix)), n), cells.ravel()

    def rest(matrix, floors, told):
        """Cells that may hold a vector as near as the floor and were not probed."""
        rows, cells = some(matrix, floors, told)
        far = np.sqrt(squared(matrix, told[0]))
        slack = SLACK * (1 + np.abs(told[0]).max(initial=0.0) + np.abs(matrix).max(initial=0.0)) * width**0.5
        open_ = far - told[1] <= np.sqrt(floors)[:, None] + slack
        open_[rows, cells] = False
        return np.nonzero(open_)

    told = spark.sparkContext.broadcast((index.centres, index.radii(spark)))
    order = ["far", "key"]
    found = best(look(first.withColumn("floor", F.lit(0.0)), some, told), ["query_id"], order, k, "key")
    if exact:
        found = written(found, "probed")
        # without k found, nothing within least is excluded
        full = found.where(F.col("rank") == k).select(F.col("query_id").alias("first"), F.col("far").alias("at"))
        more = first.join(full, "first", "left").select("first", "query", F.coalesce("at", F.lit(1.0 - least)).alias("floor"))
        both = found.select("query_id", "key", "far").unionByName(look(more, rest, told))
        found = best(both, ["query_id"], order, k, "key")
    own = asked.join(first.select("first", F.col("query").alias("same")), F.col("query") == F.col("same")).select("query_id", "first")
    rows = found.withColumnRenamed("query_id", "first").join(own, "first")
    return rows.select("query_id", F.col("key").alias(key), F.greatest(F.lit(0.0), 1 - F.col("far")).alias("score"), "rank")
