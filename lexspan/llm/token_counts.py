"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text begins as its single-byte symbols in a doubly linked list. The
adjacent pairs that can merge wait in a heap by rank and place; the lowest is
popped again and again, its right symbol leaves the list and the pairs on
either side are pushed. An entry whose pair is gone is recognised by its rank.
The count is the number of initial symbols minus the merges; no identifiers
are kept. The cost of a piece of n symbols is n log n, so that a text without
white space costs little more than any other.

Normalisation and the cut into pieces are the tokenizer file's own rules.
Where these drop white space, which is probed, texts are cut at white space
first and the counts of chunks are remembered, in two generations of at most
``room`` chunks each.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2048
LONGEST_KEPT = 64  # bytes of a chunk that is remembered


def merges_of(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges a list of symbols allows; pairs give (rank, merged symbol). The list is used up."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(found[0], i) for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    merged = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = pairs.get((symbols[i], symbols[j]))
        if not found or found[0] != rank:
            continue
        merged += 1
        symbols[i], symbols[j] = found[1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if right := pairs.get((symbols[i], symbols[k])):
                heapq.heappush(heap, (right[0], i))
        if (h := before[i]) >= 0 and (left := pairs.get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (left[0], h))
    return merged


class TokenCounter:
    """Counts the tokens of texts as the tokenizers library does for a byte-level BPE file.

    Special strings in a text are one token each, as is the library's default.
    Files with other models, unknown tokens, dropout or special strings that
    take white space with them are refused with a ValueError.
    """

    def __init__(self, path: str, room: int = 450_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens") or []
        odd += [k for a in added for k in ("single_word", "lstrip", "rstrip", "normalized") if a.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path} {odd}")
        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self._symbol = {c: i for c, i in vocab.items() if len(c) == 1}
        self._last = {c: vocab[c + end] for c in self._symbol if c + end in vocab}
        self._pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = sorted((a["content"].encode() for a in added), key=len, reverse=True)
        self._special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self._room = room
        self._known: dict[bytes, int] = {}
        self._older: dict[bytes, int] = {}
        self._by_chunk = all(self._pieces(f"a{s}b{s}") == self._pieces("a") + self._pieces("b") for s in (" ", "\n", "\t", "\r", "\x0b", "\x0c", " \n "))

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text, a character for each byte."""
        if self._normalizer:
            text = self._normalizer.normalize_str(text)
        return [piece for piece, _ in self._cutter.pre_tokenize_str(text)]

    def _count_piece(self, piece: str) -> int:
        symbols = [self._symbol[c] for c in piece[:-1] if c in self._symbol]
        if piece[-1] in self._last:
            symbols.append(self._last[piece[-1]])
        n = len(symbols)
        return n - merges_of(symbols, self._pairs)

    def _fresh(self, chunk: bytes) -> int:
        return sum(map(self._count_piece, self._pieces(chunk.decode())))

    def _remembered(self, chunks: list[bytes], fresh) -> int:
        if len(self._known) > self._room:
            self._older, self._known = self._known, {}
        counts = list(map(self._known.get, chunks))
        if None in counts:
            for i, c in enumerate(counts):
                if c is None:
                    chunk = chunks[i]
                    c = self._known.get(chunk)
                    if c is None:
                        c = self._older.get(chunk)
                    if c is None:
                        c = fresh(chunk)
                    counts[i] = c
                    if len(chunk) <= LONGEST_KEPT:
                        self._known[chunk] = c
        return sum(counts)

    def _plain(self, text: bytes) -> int:
        """Tokens of a text without special strings."""
        if self._by_chunk:
            return self._remembered(text.split(), self._fresh)
        return self._remembered([p.encode() for p in self._pieces(text.decode())], lambda p: self._count_piece(p.decode()))

    def count(self, text: bytes) -> int:
        """Tokens of a text in UTF-8."""
        if not self._special or not self._special.search(text):
            return self._plain(text)
        parts = self._special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One a worker process, so that what it remembers serves its next tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs, in its order: the id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    One pass without a shuffle. A null text counts as empty, which has no
    tokens; whole texts are counted, however long; repeated rows and null ids
    stay as they are; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        count = counter(tokenizer).count
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(count, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
