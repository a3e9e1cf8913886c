"""Interpolated modified Kneser-Ney bigram model over word hashes.

Counting: tasks hash words in numpy, collapse their own (context, word) pairs
and send them, as sorted arrays in one binary value per shard, to the shard of
the context. Contexts with more than two in ``HOT`` of all tokens are found
first; their pairs go to shards of their own hash, so that no shard gets all
pairs of a common word, and their totals, at most ``HOT`` of them, are summed
and kept in the model itself. A shard merges its arrays, which gives all counts
of its pairs and contexts, and stores them in the shared folder as sorted hash
arrays; what it knows about words (kinds of contexts, occurrences) goes on to
the shard of the word. Every shard writes its files, empty ones too, so a file
that is missing is an error and never a word not seen. Scoring: workers
memory-map the arrays and look up the sorted distinct pairs of a batch by
binary search, shard by shard.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(k(w) - E(k(w)), 0) / k + g p0,   p0 = 1 / (V + 1)

with k(w) the number of distinct contexts of w, k their sum, D and E three
discounts each, from counts of counts, and g the mass that discounting frees.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import mounted_folder, partitions, written

START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
HOT = 1000  # contexts at most whose pairs are dealt over all shards
MAPS = 4096  # files that a worker keeps mapped


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[_LOWER]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_ODD, -1, 1 << 64)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (_ODD, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words of texts that lie one after another in bytes.

    A word's hash is its bytes, A-Z lowered, as digits to an odd base, mixed.
    Bytes are taken in pieces that end at a text's end or at white space.
    """
    hashes, owners = [], []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + CHUNK, end)
        if hi < end:
            cut = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if cut > lo:
                hi = cut
            else:  # within one text: back to its last white space, or on to its next
                text_end = int(offsets[np.searchsorted(offsets, lo, "right")])
                space = np.flatnonzero(_SPACE[data[lo:hi]])
                if len(space):
                    hi = lo + int(space[-1]) + 1
                else:
                    space = np.flatnonzero(_SPACE[data[hi:text_end]])
                    hi = hi + int(space[0]) + 1 if len(space) else text_end
        part = data[lo:hi]
        solid = ~_SPACE[part]
        first = np.zeros(len(part), bool)  # of a text
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)]
        first[inside - lo] = True
        before = np.concatenate(([False], solid[:-1]))
        starts = np.flatnonzero(solid & (~before | first))
        stops = np.flatnonzero(before & (~solid | first))
        if len(part) and solid[-1]:
            stops = np.append(stops, len(part))
        powers, inverses = _powers(len(part) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[part] * powers[: len(part)])))
        hashes.append(_mix((sums[stops] - sums[starts]) * inverses[starts]))
        owners.append(np.searchsorted(offsets, starts + lo, "right") - 1)
        lo = hi
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([np.zeros(0, np.int64), *owners])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, texts' ends) of all tokens of an Arrow string column; null is empty, each text ends in END."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    hashes, owners = word_hashes(data, offsets)
    ends = np.cumsum(np.bincount(owners, minlength=len(column)) + 1)
    words = np.empty(len(hashes) + len(column), np.uint64)
    words[np.arange(len(hashes)) + owners] = hashes
    words[ends - 1] = END
    contexts = np.concatenate(([START], words[:-1]))
    contexts[ends[:-1]] = START
    return contexts, words, ends


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted distinct rows of keys with the sums of values; all inputs of one length."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys] + [np.add.reduceat(v[order], at, dtype=v.dtype) if len(at) else v for v in values]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _pair_key(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mix(contexts * np.uint64(_ODD) + words)


def _among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array hot."""
    if not len(hot):
        return np.zeros(len(h), bool)
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h


def _pair_shard(contexts: np.ndarray, keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The context's shard, or that of the pair itself where the context is hot."""
    return _shard(np.where(_among(contexts, hot), keys, contexts), shards)


def _blobs(shards: np.ndarray, columns: list[np.ndarray]):
    """(shard, its part of each column); rows are in order of shards."""
    at = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else []
    for a, b in zip(at, [*at[1:], len(shards)]):
        yield int(shards[a]), [c[a:b].tobytes() for c in columns]


def _often(room: int):
    """(context, n) of the contexts that make up 1/HOT of ``room`` tokens at hand, and a row (null, tokens)."""

    def out(held):
        c = np.concatenate(held)
        h, n = np.unique(c, return_counts=True)
        many = n * HOT >= len(c)
        return pa.RecordBatch.from_arrays([pa.array([None, *h[many].view(np.int64).tolist()], pa.int64()), pa.array([len(c), *n[many].tolist()], pa.int64())], names=["c", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(tokens(batch.column(0))[0])
            size += len(held[-1])
            if size >= room:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _hot_contexts(texts: DataFrame, room: int) -> np.ndarray:
    """Sorted contexts with at least 1/HOT of all tokens where they are common, so at most HOT; all with twice that are among them."""
    counts = written(texts.select("text").mapInArrow(_often(room), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")), "lm-often")
    total = counts.where("c is null").agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("c").isNotNull() & (F.col("n") * HOT >= total)).select("c").collect()
    return np.sort(np.array([r.c for r in found], np.int64).view(np.uint64))


def _count_pairs(shards: int, room: int, hot: np.ndarray):
    def collapse(held):
        contexts, words = (np.concatenate(x) for x in zip(*held))
        c, w, n = _summed([contexts, words], [np.ones(len(words), np.uint32)])
        s = _pair_shard(c, _pair_key(c, w), hot, shards)
        order = np.argsort(s, kind="stable")
        rows = list(_blobs(s[order], [c[order], w[order], n[order]]))
        out = []
        for shard, (cb, wb, nb) in rows:
            # contexts repeat: each once with its run
            own = np.frombuffer(cb, np.uint64)
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            runs = np.diff(np.append(at, len(own))).astype(np.uint32)
            out.append((shard, own[at].tobytes(), runs.tobytes(), wb, nb))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names=["shard", "c", "runs", "w", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            contexts, words, _ = tokens(batch.column(0))
            if len(words):
                held.append((contexts, words))
                size += len(words)
            if size >= room:
                yield collapse(held)
                held, size = [], 0
        if held:
            yield collapse(held)

    return run


def _store(path: str, array: np.ndarray) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    array.tofile(own)
    os.replace(own, path)


_MERGED = "shard int, w binary, k binary, n binary, n1 long, n2 long, n3 long, n4 long, hot array<struct<c:bigint,n:bigint,k1:bigint,k2:bigint,k3:bigint>>"


def _merge_pairs(folder: str, shards: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        os.makedirs(folder, exist_ok=True)
        shard = table.column("shard")[0].as_py()
        col = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
        c = np.concatenate([np.repeat(a, r) for a, r in zip(col("c", np.uint64), col("runs", np.uint32))])
        w, n = np.concatenate(col("w", np.uint64)), np.concatenate(col("n", np.uint32)).astype(np.uint64)
        c, w, n = _summed([c, w], [n])
        key = _pair_key(c, w)
        order = np.argsort(key)
        _store(f"{folder}/pairs-{shard}.key", key[order])
        _store(f"{folder}/pairs-{shard}.n", n[order].astype(np.uint64 if len(n) and n.max() > 0xFFFFFFFF else np.uint32))
        at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x.astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
        total, kinds = add(n), np.stack([add(n == 1), add(n == 2), add(n > 2)], 1)
        part = _among(c[at], hot)  # of a hot context only a part is here
        _store(f"{folder}/contexts-{shard}.key", c[at][~part])
        _store(f"{folder}/contexts-{shard}.n", total[~part])
        _store(f"{folder}/contexts-{shard}.kinds", kinds[~part])
        parts = [dict(zip(("c", "n", "k1", "k2", "k3"), (int(h.view(np.int64)), int(t), *map(int, k)))) for h, t, k in zip(c[at][part], total[part], kinds[part])]
        words, k, raw = _summed([w], [np.ones(len(w), np.uint32), n])
        # a shard without pairs still has a row, for the words' shards of the same numbers
        rows = list(_blobs(_shard(words, shards), [words, k, raw])) or [(shard, [b"", b"", b""])]
        some = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        first = [True] + [False] * (len(rows) - 1)
        hots = pa.array([parts if f else [] for f in first], pa.list_(pa.struct([(x, pa.int64()) for x in ("c", "n", "k1", "k2", "k3")])))
        return pa.table(
            {"shard": pa.array([r[0] for r in rows], pa.int32()), **{x: pa.array([r[1][i] for r in rows], pa.binary()) for i, x in enumerate("wkn")}}
            | {f"n{i + 1}": pa.array([v if f else 0 for f in first], pa.int64()) for i, v in enumerate(some)}
            | {"hot": hots}
        )

    return run


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        col = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
        w, k, n = _summed([col("w", np.uint64)], [col("k", np.uint32).astype(np.uint64), col("n", np.uint64)])
        _store(f"{folder}/words-{shard}.key", w)
        _store(f"{folder}/words-{shard}.kinds", k)
        _store(f"{folder}/words-{shard}.n", n)
        row = {"words": len(w), "tokens": int(n.sum()), "kinds": int(k.sum())} | {f"k{i}": int((k == i).sum()) for i in (1, 2, 3, 4)} | {"k3more": int((k > 2).sum())}
        return pa.table({name: pa.array([v], pa.int64()) for name, v in row.items()})

    return run


def discounts(counts: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and above from the counts of counts 1 to 4; where those are too few, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where(found > 0, np.minimum(found, [0, 1, 2, 3]), [0.0, 0.5, 1.0, 1.5])


class Model:
    """The stored arrays, memory-mapped as they are needed."""

    def __init__(self, folder: str, shards: int, totals: dict, hot: np.ndarray, hot_counts: np.ndarray):
        """hot: sorted hot contexts; hot_counts: total, and kinds of count 1, 2 and above, of each."""
        self.folder, self.shards, self.totals = folder, shards, totals
        self.hot, self.hot_counts = hot, hot_counts
        self.d = discounts([totals[f"n{i}"] for i in (1, 2, 3, 4)])
        self.e = discounts([totals[f"k{i}"] for i in (1, 2, 3, 4)])
        self.maps: dict[str, np.ndarray | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def _map(self, name: str, kind, shape=(-1,)) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.folder}/{name}"
            # every shard has its files: one that cannot be seen from here raises
            if len(self.maps) >= MAPS:
                self.maps.pop(next(iter(self.maps)))
            self.maps[name] = np.memmap(path, kind, "r").reshape(shape) if os.stat(path).st_size else np.zeros(0, kind).reshape(shape)
        return self.maps[name]

    def _look(self, sort: str, keys: np.ndarray, values: dict, shards: np.ndarray | None = None) -> list[np.ndarray]:
        """Values of distinct keys, 0 where there is none; values: {suffix: (kind, width)}; shards: of the keys, else by their hash."""
        out = [np.zeros((len(keys), w) if w > 1 else len(keys), np.float64) for _, w in values.values()]
        shards = _shard(keys, self.shards) if shards is None else shards
        order = np.lexsort((keys, shards))
        at = np.flatnonzero(np.concatenate(([True], shards[order][1:] != shards[order][:-1]))) if len(keys) else []
        for a, b in zip(at, [*at[1:], len(keys)]):
            mine = order[a:b]
            s = int(shards[mine[0]])
            stored = self._map(f"{sort}-{s}.key", np.uint64)
            if not len(stored):
                continue
            place = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
            hit = np.flatnonzero(stored[place] == keys[mine])
            for o, (suffix, (kind, w)) in zip(out, values.items()):
                name = f"{sort}-{s}.{suffix}"
                if kind is None:  # four bytes, or eight where a shard has larger counts
                    kind = np.uint64 if os.stat(f"{self.folder}/{name}").st_size == 8 * len(stored) else np.uint32
                o[mine[hit]] = self._map(name, kind, (-1, w) if w > 1 else (-1,))[place[hit]]
        return out

    def score(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p(word | context), log10 of the add-one base, known) of each token."""
        t = self.totals
        key = _pair_key(contexts, words)
        pairs, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        w, w_of = np.unique(words[first], return_inverse=True)
        c, c_of = np.unique(contexts[first], return_inverse=True)
        kinds, raw = self._look("words", w, {"kinds": (np.uint64, 1), "n": (np.uint64, 1)})
        free = (self.e[1] * t["k1"] + self.e[2] * t["k2"] + self.e[3] * t["k3more"]) / max(t["kinds"], 1)
        low = np.maximum(kinds - self.e[np.minimum(kinds, 3).astype(int)], 0) / max(t["kinds"], 1) + (free if t["kinds"] else 1) / (t["words"] + 1)
        total, of = self._look("contexts", c, {"n": (np.uint64, 1), "kinds": (np.uint64, 3)})
        often = _among(c, self.hot)
        told = self.hot_counts[np.searchsorted(self.hot, c[often])]
        total[often], of[often] = told[:, 0], told[:, 1:]
        seen = total > 0
        share = np.where(seen, (of @ self.d[1:]) / np.maximum(total, 1), 1.0)
        (n,) = self._look("pairs", pairs, {"n": (None, 1)}, _pair_shard(contexts[first], pairs, self.hot, self.shards))
        high = np.maximum(n - self.d[np.minimum(n, 3).astype(int)], 0) / np.maximum(total[c_of], 1)
        p = np.log10(high + share[c_of] * low[w_of])
        base = np.log10((raw + 1) / (t["tokens"] + t["words"] + 1))
        return p[inverse], base[w_of][inverse], (raw > 0)[w_of][inverse]


def train(texts: DataFrame, tag: str = "lm", room: int = 4_000_000, shard_bytes: int = 24 << 20) -> Model:
    """Count a frame (text). The folder holds the model; the driver gets sums, and the counts of at most HOT contexts.

    Null and empty texts are their end alone; an empty table gives a model in
    which every token has the same probability. Texts are taken a few million
    tokens at a time, long ones in pieces, so only the tokens of one text are
    held at once.
    """
    spark = texts.sparkSession
    folder = mounted_folder(spark, f"{tag}-model")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // shard_bytes))
    hot = _hot_contexts(texts, room)
    partial = texts.select("text").mapInArrow(_count_pairs(shards, room, hot), "shard int, c binary, runs binary, w binary, n binary")
    nothing = F.lit(b"").cast("binary")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), *[nothing.alias(x) for x in ("c", "runs", "w", "n")])
    merged = partial.unionByName(every).groupBy("shard").applyInArrow(_merge_pairs(folder, shards, hot), _MERGED)
    merged = written(merged, f"{tag}-words")
    blobs = merged.select("shard", "w", "k", "n").unionByName(every.select("shard", "w", F.col("c").alias("k"), "n"))
    words = blobs.groupBy("shard").applyInArrow(_merge_words(folder), "words long, tokens long, kinds long, k1 long, k2 long, k3 long, k4 long, k3more long")
    sums = lambda df, names: {k: v or 0 for k, v in df.agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items()}
    totals = sums(words, ["words", "tokens", "kinds", "k1", "k2", "k3", "k4", "k3more"]) | sums(merged, ["n1", "n2", "n3", "n4"])
    names = ("n", "k1", "k2", "k3")
    rows = merged.select(F.explode("hot").alias("h")).groupBy("h.c").agg(*[F.sum(f"h.{x}").alias(x) for x in names]).collect()
    counts = {r.c: [r[x] for x in names] for r in rows}
    told = np.array([counts.get(int(h), [0] * 4) for h in hot.view(np.int64)], np.float64).reshape(-1, 4)
    return Model(folder, shards, totals, hot, told)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of a frame (doc_id, held_out, text).

    A null or empty text is its end alone, one token. Repeated rows get equal
    scores; an empty table gives no rows. A model of no text gives every token
    the same probability.
    """

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                batch = whole.slice(start, 4000)
                contexts, words, ends = tokens(batch.column(2))
                starts = np.concatenate(([0], ends[:-1]))
                p, base, known = model.score(contexts, words)
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, p)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(ends - starts), *map(pa.array, sums)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
