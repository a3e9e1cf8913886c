"""Exact deduplication by Grace hashing.

1. Collapse: every task puts its own rows through an open-addressing table that
   compares complete content, so a group of copies leaves a task as one partial
   record however many rows it has there.
2. Partition: partial records go by content hash to spill files (the shuffle's),
   as many as make a bucket fit its table.
3. Probe: a task reads one bucket into an open-addressing table. Content that
   no longer fits in the table's bytes goes on, with all its copies, to the
   next level, which deals it by another hash over fresh spill files; levels
   go on until nothing is left over.

Partial records are written once to the shared folder before they are read
twice, so a lost executor never changes their numbers.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.scratch import fresh, partitions, written


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self, capacity: int = 1 << 10):
        self.slots = array("q", [-1]) * capacity
        self.hashes: list[int] = []
        self.items: list[bytes] = []
        self.bytes = 0

    def find(self, content: bytes) -> tuple[int, int, int]:
        """(number or -1, free slot, hash)."""
        h = xxhash.xxh3_64_intdigest(content)
        mask = len(self.slots) - 1
        i = h & mask
        while (s := self.slots[i]) >= 0:
            if self.hashes[s] == h and self.items[s] == content:
                return s, i, h
            i = (i + 1) & mask
        return -1, i, h

    def add(self, content: bytes, slot: int, h: int) -> int:
        n = len(self.items)
        self.slots[slot] = n
        self.hashes.append(h)
        self.items.append(content)
        self.bytes += len(content) + 100
        if 3 * (n + 1) > 2 * len(self.slots):
            self._grow()
        return n

    def put(self, content: bytes) -> int:
        s, slot, h = self.find(content)
        return s if s >= 0 else self.add(content, slot, h)

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for n, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = n


def _collapse(text_at: int, id_at: int, schema: pa.Schema, flush_bytes: int):
    """Adds (partial, top, rows) to each row; only a partial's top row keeps its text."""

    def run(batches):
        number = TaskContext.get().partitionId() << 36

        def flush(held, table, tops, counts):
            nonlocal number
            for batch, slots, first in held:
                top = [tops[s][1] == first + i for i, s in enumerate(slots)]
                kept = batch.column(text_at).take(pa.array([i if t else None for i, t in enumerate(top)], pa.int32()))
                columns = [kept if i == text_at else batch.column(i) for i in range(batch.num_columns)]
                columns += [
                    pa.array([number + s for s in slots], pa.int64()),
                    pa.array(top, pa.bool_()),
                    pa.array([counts[s] if t else None for s, t in zip(slots, top)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            number += len(table.items)

        held, table, tops, counts, seen, held_bytes = [], ContentTable(), [], [], 0, 0
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                ids = batch.column(id_at).to_pylist()
                texts = batch.column(text_at).cast(pa.binary()).to_pylist()
                slots = array("q")
                for i, text in enumerate(texts):
                    s = table.put(text or b"")
                    rank = (ids[i] is not None, ids[i])
                    if s == len(tops):
                        tops.append((rank, seen + i))
                        counts.append(0)
                    elif rank[0] and (not tops[s][0][0] or rank[1] > tops[s][0][1]):
                        tops[s] = (rank, seen + i)
                    counts[s] += 1
                    slots.append(s)
                held.append((batch, slots, seen))
                seen += len(texts)
                held_bytes += batch.nbytes
                if held_bytes + table.bytes > flush_bytes:
                    yield from flush(held, table, tops, counts)
                    held, table, tops, counts, held_bytes = [], ContentTable(), [], [], 0
        if held:
            yield from flush(held, table, tops, counts)

    return run


_PROBED = T.StructType(
    [
        T.StructField("partial", T.LongType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("winner", T.BooleanType()),
        T.StructField("left_over", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("top_id", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)


def _probe(table_bytes: int):
    """One bucket's partial records to groups; what does not fit is left over whole."""

    def run(batches):
        table, members, sums = ContentTable(), [], []
        over = {n: [] for n in ("partial", "text", "top_id", "rows")}
        over_bytes = 0

        def left():
            n = len(over["partial"])
            none = {k: [None] * n for k in ("keep_id", "group_size", "text_sha256", "winner")}
            row = none | over | {"left_over": [True] * n, "text": [t.decode() for t in over["text"]]}
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in _ARROW], schema=_ARROW)

        for batch in batches:
            partial, text, top_id, rows = (c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3)))
            for p, t, i, n in zip(partial, text, top_id, rows):
                s, slot, h = table.find(t)
                if s < 0 and table.items and table.bytes + len(t) > table_bytes:
                    for k, v in (("partial", p), ("text", t), ("top_id", i), ("rows", n)):
                        over[k].append(v)
                    over_bytes += len(t)
                    if over_bytes > table_bytes // 4:
                        yield left()
                        over = {k: [] for k in over}
                        over_bytes = 0
                    continue
                if s < 0:
                    table.add(t, slot, h)
                    members.append((array("q"), []))
                    sums.append([None, None, 0])
                    s = len(sums) - 1
                members[s][0].append(p)
                best = sums[s]
                # the largest id stays; among partials with the same id, the first number
                if best[1] is None or (i is not None and (best[0] is None or i > best[0])) or (i == best[0] and p < best[1]):
                    best[0], best[1] = i, p
                best[2] += n
        if over["partial"]:
            yield left()
        out = {f.name: [] for f in _ARROW}

        def done():
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ARROW], schema=_ARROW)

        for s, content in enumerate(table.items):
            digest = hashlib.sha256(content).hexdigest()
            keep, winner, size = sums[s]
            for p in members[s][0]:
                for k, v in zip(out, (p, keep, size, digest, p == winner, False, None, None, None)):
                    out[k].append(v)
                if len(out["partial"]) >= 20_000:
                    yield done()
                    out = {k: [] for k in out}
        if out["partial"]:
            yield done()

    return run


_ARROW = pa.schema(
    [
        ("partial", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()),
        ("winner", pa.bool_()), ("left_over", pa.bool_()), ("text", pa.string()), ("top_id", pa.int64()), ("rows", pa.int64()),
    ]
)


class ExactGroups:
    """Groups of equal texts of a table.

    A null text equals an empty one. The row with the largest id of a group
    stays; a null id is smaller than any other. Of repeated rows (same id, same
    text) one stays. Extra columns go along whatever their names are.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, table_bytes: int = 64 << 20, flush_bytes: int = 48 << 20, tag: str = "exact"):
        from pyspark.sql.pandas.types import to_arrow_schema

        spark = docs.sparkSession
        self.columns = docs.columns
        self.id_col = id_col
        self.partial, self.top, rows = fresh(docs.columns, "partial", "top", "rows")
        schema = T.StructType(
            docs.schema.fields + [T.StructField(self.partial, T.LongType()), T.StructField(self.top, T.BooleanType()), T.StructField(rows, T.LongType())]
        )
        run = _collapse(docs.columns.index(text_col), docs.columns.index(id_col), to_arrow_schema(schema), flush_bytes)
        self.rows = written(docs.mapInArrow(run, schema), f"{tag}-rows")
        pending = self.rows.where(F.col(self.top)).select(
            F.col(self.partial).alias("partial"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            F.col(id_col).cast("long").alias("top_id"),
            F.col(rows).alias("rows"),
        )
        self.levels = 0
        found = None
        while True:
            total = pending.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
            buckets = max(partitions(spark), -(-2 * total // table_bytes))
            # another seed at each level: texts that met in one bucket part here
            dealt = pending.repartition(buckets, F.xxhash64(F.lit(self.levels), F.col("text")))
            probed = written(dealt.mapInArrow(_probe(table_bytes), _PROBED), f"{tag}-level{self.levels}")
            done = probed.where(~F.col("left_over")).select("partial", "keep_id", "group_size", "text_sha256", "winner")
            found = done if found is None else found.unionByName(done)
            self.levels += 1
            pending = probed.where("left_over").select("partial", "text", "top_id", "rows")
            if pending.isEmpty():
                break
        self.groups = found

    def decisions(self) -> DataFrame:
        """(id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
        rows = self.rows.select(F.col(self.id_col).alias("doc_id"), F.col(self.partial).alias("p"), F.col(self.top).alias("t"))
        g = self.groups
        return rows.join(g, rows.p == g.partial, "inner").select(
            "doc_id", "keep_id", "group_size", (F.col("t") & F.col("winner")).alias("kept"), "text_sha256"
        )

    def kept(self) -> DataFrame:
        """The rows that stay, whole, with the input's columns."""
        winners = self.groups.where("winner").select(F.col("partial").alias(self.partial))
        return self.rows.where(F.col(self.top)).join(winners, self.partial, "left_semi").select(*[F.col(f"`{c}`") for c in self.columns])
