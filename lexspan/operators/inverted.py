"""An inverted index of entries' words, and the best entries of many queries at once.

An entry's impact for a word is the sum of the weights of its fields that have
it; its score for a query is the sum of its impacts for the query's words. The
index has two tables:

* ``postings`` by word and shard of entries, in blocks of ``BLOCK`` postings in
  order of impact, each with its highest. A shard has about ``SHARD`` entries,
  and its postings are sorted in one task, so no word gathers more in one group.
* ``terms`` words with the number of their entries and their highest impact

A search joins the queries' words with the postings by word; what meets goes to
a task by shard of entries, which adds the impacts up in arrays and lets only
the k best of its shard leave. Queries with many words are dealt over parts of
about ``PAIRS`` words, so a task holds the postings of a shard and the words of
a part, however many entries and queries there are. ``told`` and ``candidates``
state the bounds of a search: words whose highest impacts together stay below
a score that the k-th best entry reaches at least cannot bring an entry among
the best alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.tables import best, saved, written

BLOCK = 256
SHARD = 8_192
PAIRS = 1 << 18  # words of the queries of a part


def words(text: Column) -> Column:
    """The distinct words of a text: runs of letters and digits in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


@dataclass(frozen=True)
class Index:
    """The tables of an index below a path."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the elements of a column of lists."""
    lists = table[name].combine_chunks()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def _blocks(weights: list[int], block: int):
    """Entries (shard, ord, w0, w1...) of a shard to blocks of its postings."""

    def run(table: pa.Table) -> pa.Table:
        # rows in order of ord, so that postings tie by their row
        table = table.sort_by("ord")
        fields = [_flat(table, f"w{i}") for i in range(len(weights))]
        rows = np.concatenate([r for r, _ in fields])
        named = pa.chunked_array([w for _, w in fields], pa.string()).combine_chunks().dictionary_encode()
        codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, of = np.unique(codes * len(table) + rows, return_inverse=True)
        impacts = np.bincount(of, np.repeat(weights, [len(r) for r, _ in fields]), len(pairs)).astype(np.int32)
        codes, rows = np.divmod(pairs, max(1, len(table)))
        order = np.lexsort((rows, -impacts, codes))
        codes, rows, impacts = codes[order], rows[order], impacts[order]
        place = np.arange(len(codes)) - np.searchsorted(codes, codes)
        first = np.flatnonzero(place % block == 0)
        ends = pa.array(np.append(first, len(codes)), pa.int32())
        columns = {
            "word": named.dictionary.take(pa.array(codes[first])),
            "shard": pa.array(np.full(len(first), table["shard"][0].as_py()), pa.int32()),
            "block": pa.array(place[first] // block, pa.int32()),
            "top": pa.array(impacts[first]),
            "ords": pa.ListArray.from_arrays(ends, table["ord"].combine_chunks().take(pa.array(rows))),
            "impacts": pa.ListArray.from_arrays(ends, pa.array(impacts)),
        }
        return pa.table(columns)

    return run


def build(entries: DataFrame, path: str, fields: dict[str, int], key: str = "ord") -> Index:
    """Write the index of entries below path. fields: weight by column; arrays are lists of words.

    Entries need different keys. Null fields have no words; entries without
    words are in no result.
    """
    own = [F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))) if isinstance(entries.schema[c].dataType, T.ArrayType) else words(F.col(c)) for c in fields]
    shards = max(1, -(-entries.count() // SHARD))
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")
    rows = entries.select(shard, F.col(key).alias("ord"), *[F.array_compact(w).alias(f"w{i}") for i, w in enumerate(own)])
    kind = entries.schema[key].dataType.simpleString()
    blocks = rows.groupBy("shard").applyInArrow(_blocks(list(fields.values()), BLOCK), f"word string, shard int, block int, top int, ords array<{kind}>, impacts array<int>")
    postings = saved(blocks, f"{path}/postings")
    saved(postings.groupBy("word").agg(F.sum(F.size("ords")).alias("n"), F.max("top").alias("top")), f"{path}/terms")
    return Index(path)


def _spread(postings: DataFrame) -> DataFrame:
    return postings.select("query_id", F.explode(F.arrays_zip("ords", "impacts")).alias("x")).select("query_id", F.col("x.ords").alias("ord"), F.col("x.impacts").alias("impact"))


def told(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Written (query_id, word, n, top, others, floor, essential, rest) of the queries' words.

    floor is a score that the k-th best entry reaches at least (0: not known),
    others the highest impacts of the query's other words, rest those of the
    words that are not essential.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    named = written(asked.join(index.table(spark, "terms"), "word"), "asked")
    first = named.join(index.table(spark, "postings").where("block = 0"), "word")
    least = best(_spread(first).groupBy("query_id", "ord").agg(F.sum("impact").alias("least")), ["query_id"], [F.desc("least"), "ord"], k, "ord")
    floors = least.where(F.col("rank") == k).select("query_id", F.col("least").alias("floor"))
    by = Window.partitionBy("query_id")
    rows = named.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    rows = rows.withColumn("others", F.sum("top").over(by) - F.col("top"))
    rows = rows.withColumn("essential", F.sum("top").over(by.orderBy(F.desc("n"), "word")) >= F.col("floor"))
    return written(rows.withColumn("rest", F.sum(F.when(F.col("essential"), 0).otherwise(F.col("top"))).over(by)), "told")


def candidates(index: Index, named: DataFrame) -> DataFrame:
    """(query_id, ord) of the entries that may be among the best."""
    postings = index.table(named.sparkSession, "postings").withColumnRenamed("top", "block_top")
    read = named.where("essential").join(postings, "word").where("block_top + others >= floor")
    floors = named.select("query_id", "floor", "rest").distinct()
    found = _spread(read).groupBy("query_id", "ord").agg(F.sum("impact").alias("found"))
    return found.join(floors, "query_id").where("found + rest >= floor").select("query_id", "ord")


def _summed(k: int):
    """Postings (ords, impacts, asked) of a shard's words, asked the queries of a word in its first block, to the shard's k best of each query."""

    def run(table: pa.Table) -> pa.Table:
        row, ords = _flat(table, "ords")
        named = ords.dictionary_encode()
        rank = np.empty(len(named.dictionary), np.int64)
        rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(rank))
        kept = named.dictionary.take(pc.sort_indices(named.dictionary))
        word = table["word"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(word[row], kind="stable")
        place = rank[named.indices.to_numpy(zero_copy_only=False)][order]
        impact = _flat(table, "impacts")[1].to_numpy(zero_copy_only=False).astype(np.int64)[order]
        ends = np.cumsum(np.bincount(word[row]))
        row, queries = _flat(table, "asked")
        queries = queries.to_numpy(zero_copy_only=False)
        by_query = np.argsort(queries, kind="stable")
        queries, asked = queries[by_query], word[row][by_query]
        ids, first = np.unique(queries, return_index=True)
        out = []
        for q, its in zip(ids.tolist(), np.split(asked, first[1:])):
            score = np.zeros(len(kept), np.int64)
            for w in its.tolist():
                some = slice(ends[w - 1] if w else 0, ends[w])
                # a word has an entry once
                score[place[some]] += impact[some]
            least = max(1, np.partition(score, -k)[-k]) if len(score) > k else 1
            top = np.flatnonzero(score >= least)
            top = top[np.argsort(-score[top], kind="stable")[:k]]
            out.append((np.full(len(top), q), top, score[top]))
        q, top, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 3))
        return pa.table({"query_id": pa.array(q, pa.int64()), "ord": kept.take(pa.array(top)), "score": pa.array(score, pa.int64())})

    return run


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, ord, score, rank) of queries (query_id, words): the k entries with the highest scores above 0, ties by ord.

    Repeated words count once; query_ids are different numbers. A query without
    words that the index knows has no rows.
    """
    asked = written(queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct("words")).alias("word")), "asked")
    parts = max(1, -(-asked.count() // PAIRS))
    by_word = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"), "word").agg(F.collect_list("query_id").alias("asked"))
    postings = index.table(queries.sparkSession, "postings")
    # the queries of a word travel with its first block alone
    first = F.when(F.col("block") == 0, F.col("asked")).otherwise(F.array().cast("array<bigint>"))
    met = by_word.join(postings, "word").select("part", "shard", "word", first.alias("asked"), "ords", "impacts")
    kind = postings.schema["ords"].dataType.elementType.simpleString()
    scored = met.groupBy("part", "shard").applyInArrow(_summed(k), f"query_id long, ord {kind}, score long")
    return best(scored, ["query_id"], [F.desc("score"), "ord"], k, "ord")


def holding(index: Index, terms: DataFrame) -> DataFrame:
    """(term_id, ord, impact) of the entries that hold each of terms (term_id, word)."""
    found = terms.join(index.table(terms.sparkSession, "postings"), "word").select("term_id", F.explode(F.arrays_zip("ords", "impacts")).alias("x"))
    return found.select("term_id", F.col("x.ords").alias("ord"), F.col("x.impacts").alias("impact"))
