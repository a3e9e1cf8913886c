"""Packing token sequences: patterns fitted by non-negative least squares.

The histogram of piece lengths has at most ``capacity`` entries whatever the
corpus. Patterns of up to four rounded lengths that fill a sequence are
enumerated; non-negative least squares fits their repeat counts to the rounded
histogram, and the counts are rounded down. Each pattern is then filled with
exact lengths, its last place and any room left over by best fit, and the
residual is packed by best fit as well. The plan holds each shape once with its
repeat count, so its size follows the number of distinct lengths. Pieces find
their place by their number among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.ranks import numbered
from lexspan.llm.scratch import fresh, partitions, written
from lexspan.tables import small_side

CAPACITY = 2048
END = 0  # id that ends a document
CELLS = 64  # rounded lengths: capacity / CELLS tokens each


class ChunkEncoder:
    """Ids of a text by a tokenizer, chunk by chunk between spaces, remembering chunks.

    The tokenizer lowers case, drops white space and no token spans it, so
    chunks can be encoded apart, and many at once with a mark between them. A
    full stop or comma between a letter and white space is a word of its own to
    the tokenizer and a chunk of its own here. Two generations of up to
    ``room`` chunks are remembered; a chunk that is met again moves to the
    younger one.
    """

    MARK = "\x01"
    STOPS = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n]|$)")

    def __init__(self, path: str, room: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room = room
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self._whole(self.MARK)

    def _whole(self, text: str) -> np.ndarray:
        # one text, without the offsets that encode() keeps
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """chunks have no mark in them, so its one id tells them apart."""
        if len(self.mark) != 1:
            return [self._whole(c.decode()).tobytes() for c in chunks]
        ids = self._whole(f" {self.MARK} ".encode().join(chunks).decode())
        cuts = np.flatnonzero(ids == self.mark[0])
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        data = text.encode().lower()  # ASCII only
        if self.MARK.encode() in data or b"<|startoftext|>" in data or b"<|endoftext|>" in data:
            return self._whole(text).tobytes()
        chunks = self.STOPS.sub(rb" \1", data).replace(b"\n", b" ").split(b" ")
        if len(self.known) > self.room:
            self.older, self.known = self.known, {}
        values = list(map(self.known.get, chunks))
        if None in values:
            missing = dict.fromkeys(c for c, v in zip(chunks, values) if v is None)
            found = {c: v for c in missing if (v := self.older.get(c)) is not None}
            new = [c for c in missing if c not in found]
            if new:
                found.update(zip(new, self._encode(new)))
            values = [found[c] if v is None else v for c, v in zip(chunks, values)]
            self.known.update((c, v) for c, v in found.items() if len(c) <= 64)
        return b"".join(values)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One a worker process, so that what it remembers serves its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, at) of a frame (doc_id, text, at); only longer documents are cut."""

    def run(batches):
        encode = encoder(tokenizer).ids
        end, width = np.array([END], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = [[], [], [], [], [], []]
            for doc_id, text, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), place)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "at"],
            )

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, at long")


def patterns(cells: int, most: int = 4) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``most`` positive cell counts that add up to ``cells``."""

    def parts(left: int, largest: int, places: int) -> Iterable[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif places:
            for x in range(min(left, largest), -(-left // places) - 1, -1):
                for rest in parts(left - x, x, places - 1):
                    yield (x, *rest)

    return list(parts(cells, cells, most))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, np.abs(b).max())
    for _ in range(6 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            x[at[low & (x[at] <= 1e-9 * scale)]] = 0
            dead = at[x[at] <= 1e-9 * scale]
            if not len(dead):
                dead = at[low]
            x[dead] = 0
            active[dead] = False
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, cells: int = CELLS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, times)] that use every length as often as the histogram has it."""
    left = {n: c for n, c in histogram.items() if c}
    out: list[tuple[tuple[int, ...], int]] = []
    order = sorted(left)

    def largest(most: int, least: int = 1) -> int:
        """The largest length left in least..most, or 0."""
        while (i := bisect_right(order, most)) and not left[order[i - 1]]:
            del order[i - 1]
        return order[i - 1] if i and order[i - 1] >= least else 0

    def place(bounds: list[tuple[int, int]], times: int) -> int:
        """Fill up to ``times`` sequences: a length in each of the bounds but the last, then best fits. The number filled."""
        taken: list[int] = []
        room = capacity
        for least, most in bounds:
            n = largest(min(most, room), least)
            if n and left[n] > taken.count(n):
                taken.append(n)
                room -= n
        while room > 0 and (n := largest(room)):
            while n and left[n] <= taken.count(n):  # all of this length are in this very sequence
                n = next((m for m in reversed(order[: bisect_right(order, n - 1)]) if left[m] > taken.count(m)), 0)
            if not n:
                break
            taken.append(n)
            room -= n
        if not taken:
            return 0
        times = min(times, *(left[n] // taken.count(n) for n in set(taken)))
        for n in taken:
            left[n] -= times
        out.append((tuple(taken), times))
        return times

    full = left.get(capacity, 0)
    if full:
        out.append(((capacity,), full))
        left[capacity] = 0
    width = capacity // cells
    shapes = [p for p in patterns(cells) if len(p) > 1]
    b = np.zeros(cells)
    for n, c in left.items():
        b[-(-n // width) - 1] += c
    if b.sum():
        a = np.zeros((cells, len(shapes)))
        for j, p in enumerate(shapes):
            for x in p:
                a[x - 1, j] += 1
        weight = np.sqrt(np.arange(1, cells + 1))[:, None]  # a long piece that finds no pattern costs more
        repeats = np.floor(nnls(a * weight, b * weight[:, 0]) + 1e-6).astype(int)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: shapes[j], reverse=True):
            bounds = [((x - 1) * width + 1, x * width) for x in shapes[j][:-1]]
            todo = int(repeats[j])
            while todo and largest(bounds[0][1], bounds[0][0]):
                if not (n := place(bounds, todo)):
                    break
                todo -= n
    while n := largest(capacity):
        place([(n, n)], left[n])
    return out


class Places:
    """Where the k-th piece of each length goes under a plan."""

    def __init__(self, shapes: list[tuple[tuple[int, ...], int]]):
        starts: dict[int, list[int]] = {}
        slots: dict[int, list[tuple[int, int, int]]] = {}
        spread: dict[int, list[tuple[float, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for shape, (lengths, times) in enumerate(shapes):
            offset = 0
            for place, n in enumerate(lengths):
                starts.setdefault(n, []).append(used.get(n, 0))
                slots.setdefault(n, []).append((base, offset, place))
                spread.setdefault(n, []).append((shape * 0.6180339887498949 % 1, times))
                used[n] = used.get(n, 0) + times
                offset += n
            base += times
        self.sequences = base
        self.starts = {n: np.array(x, np.int64) for n, x in starts.items()}
        self.slots = {n: np.array(x, np.int64) for n, x in slots.items()}
        self.phases = {n: np.array([p for p, _ in x]) for n, x in spread.items()}
        self.times = {n: np.array([t for _, t in x], np.int64) for n, x in spread.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """(sequence, offset, place) rows."""
        out = np.empty((len(length), 3), np.int64)
        for n in np.unique(length):
            at = length == n
            i = np.searchsorted(self.starts[n], rank[at], "right") - 1
            out[at] = self.slots[n][i]
            out[at, 0] += rank[at] - self.starts[n][i]
        return out

    def _stretch(self, n: int, ranks: np.ndarray) -> np.ndarray:
        """The places of pieces of a length with these ascending ranks, in the order of when their sequences come.

        A shape's sequences are spread evenly over the whole, the k-th of t at
        (k + phase) / t with a phase of its own, so that every stretch has its
        part of each shape. A rank's moment is known to as many sequences as there
        are shapes; only those about the stretch are laid out and sorted.
        """
        phases, times = self.phases[n], self.times[n]
        many, total = len(times), int(times.sum())
        low, high = (int(ranks[0]) - many) / total, (int(ranks[-1]) + 1 + many) / total
        first = np.clip(np.floor(low * times - phases).astype(np.int64) - 1, 0, times)
        size = np.clip(np.floor(high * times - phases).astype(np.int64) + 2, first, times) - first
        shape = np.repeat(np.arange(many), size)
        k = np.arange(len(shape)) + np.repeat(first - (np.cumsum(size) - size), size)
        # what comes before the stretch is not laid out, and comes before all of it
        chosen = np.lexsort((k, shape, (k + phases[shape]) / times[shape]))[ranks - first.sum()]
        found = self.slots[n][shape[chosen]]
        found[:, 0] += k[chosen]
        return found

    def along(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """(sequence, offset, place) rows, where rank follows an order that the sequences are to follow."""
        out = np.empty((len(length), 3), np.int64)
        order = np.lexsort((rank, length))
        n, r = length[order], rank[order]
        new = np.flatnonzero((n[1:] != n[:-1]) | (r[1:] - r[:-1] > 64)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(n)]):
            if b > a:
                out[order[a:b]] = self._stretch(int(n[a]), r[a:b])
        return out


def in_order(docs: DataFrame, tag: str) -> tuple[DataFrame, Column, int]:
    """(docs with their files' places, number of each row from 0, rows), in the order in which the rows were written.

    Spark's writers number their files by partition; a row's number is that of
    its file's first row and its place in the file. A frame that is not read
    from files is written first. There is a row for each file in a written
    table, which is told to all tasks where it is small and joined otherwise.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        docs = written(docs, f"{tag}-order")
    file, row, of, start, n = fresh(docs.columns, "file", "row", "of", "start", "n")
    docs = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    counts = docs.groupBy(F.col(file).alias(of)).agg(F.count("*").alias(n))
    # by the number in the name, as digits grow in number as files do
    order = Window.orderBy(F.coalesce(F.regexp_extract(of, r"^part-([0-9]+)", 1).try_cast("long"), F.lit(-1)), of).rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.withColumn(start, F.coalesce(F.sum(n).over(order), F.lit(0))), f"{tag}-files")
    total = firsts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    placed = docs.join(small_side(firsts.select(of, start)), F.col(file) == F.col(of))
    return placed, F.col(start) + F.col(row), total


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tag: str = "pack", ordered: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, place.

    offset is the piece's first token in its sequence, place its number there;
    both without gaps. A null or empty text is one piece of length 1, its end.
    Repeated rows are packed each. An empty table gives no rows. The plan that
    goes to the workers has at most a few shapes for each length up to
    capacity, whatever the number of documents.

    ordered: sequences follow the order of docs' rows as written. The pieces of
    a length go to sequences in that order, and sequences are numbered by the
    mean place of their pieces in it. A worker holds the places of the pieces
    of its batch.
    """
    spark = docs.sparkSession
    at, total = F.lit(0).cast("long"), 0
    if ordered:
        docs, at, total = in_order(docs, tag)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), at.alias("at"))
    cut = written(pieces(rows, tokenizer, capacity), f"{tag}-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    salts = max(8, partitions(spark))
    stretch = lambda x: F.floor(x * salts / max(1, total))
    salt = stretch(F.col("at")) if ordered else F.xxhash64("doc_id", "piece")
    ranked = numbered(cut, ["length"], salt, salts, ["at", "doc_id", "piece"], "rank")

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            found = places.value.along(length, rank) if ordered else places.value.of(length, rank)
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "at")]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(found[:, i]) for i in range(3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "at", "sequence_id", "offset", "place"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, at long, sequence_id long, offset long, place long"
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at", "rank").mapInArrow(run, schema)
    if not ordered:
        return out.drop("at")
    out = written(out, f"{tag}-placed")
    middles = out.groupBy(F.col("sequence_id").alias("was")).agg(F.avg("at").alias("middle")).withColumn("all", F.lit(0))
    named = numbered(middles, ["all"], stretch(F.col("middle")), salts, ["middle", "was"], "named").select("was", "named")
    return out.join(named, F.col("sequence_id") == F.col("was")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("named").alias("sequence_id"), "offset", "place")
