"""Vector, keyword and forced recall, fused by reciprocal ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import containment, grams, jaccard, similarity
from lexspan.tables import small_side, written

RRF = 60
VECTORS, ASKED = 4096, 1024  # vectors and queries of a block
NEAR = 1e-9  # of squared norms, more than rounding


def _nearest(k: int, least: float):
    """A block of queries (ids, asked) and a block of vectors (keys, matrix) to each query's k best of the block, ties by key."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                ids, asked, keys, matrix = (part.column(n)[0].values for n in ("ids", "asked", "keys", "matrix"))
                ids, keys = (x.to_numpy(zero_copy_only=False) for x in (ids, keys))
                q, v = (x.to_numpy(zero_copy_only=False).reshape(n, -1) for x, n in ((asked, len(ids)), (matrix, len(keys))))
                # about right, to leave out what is certainly no hit; what stays is measured as the SQL does, one difference after another
                slack = NEAR * (1 + (v**2).sum(1).max() + (q**2).sum(1).max())
                about = (q**2).sum(1)[:, None] - 2 * (q @ v.T) + (v**2).sum(1)
                near = about <= 1 - least + slack
                crowded = np.flatnonzero(near.sum(1) > k)
                if len(crowded):
                    near[crowded] &= about[crowded] <= np.partition(about[crowded], k - 1, axis=1)[:, k - 1 : k] + 2 * slack
                rows, columns = np.nonzero(near)
                far = np.zeros(len(rows))
                for c in range(q.shape[1]):
                    far += (v[columns, c] - q[rows, c]) ** 2
                score = np.maximum(0.0, 1 - far)
                order = np.lexsort((keys[columns], -score, rows))
                order = order[score[order] >= least]
                place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
                order = order[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[order]]), pa.array(keys[columns[order]]), pa.array(score[order])], names=["query_id", "vec_id", "score"])

    return run


def _in_blocks(vectors: DataFrame, key: str, value: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows of up to about size vectors of one width: their width, keys and values behind one another."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(value).cast("array<double>").alias("vector")).where("key is not null and vector is not null")
    rows = rows.where(~F.exists("vector", lambda x: x.isNull()))
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.groupBy(F.size("vector").alias("width"), F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_list("key").alias(names[0]), F.flatten(F.collect_list("vector")).alias(names[1]))
    return dealt.drop("block")


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, least: float = 0.3, keep: Column | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): max(0, 1 - squared distance), at least ``least``, the k best by comparing all.

    keep is a condition on corpus rows, such as a category, told to the scan.
    Queries and vectors are dealt over blocks; each pair of blocks is compared
    by itself, and only its k best of each query leave it.
    """
    if keep is not None:
        corpus = corpus.where(keep)
    vectors = written(_in_blocks(corpus, "vec_id", "embedding", VECTORS, ("keys", "matrix")), "vectors")
    asked = written(_in_blocks(queries, "query_id", "query", ASKED, ("ids", "asked")), "asked")
    # every block of vectors meets each block of queries, so a task is a pair of them
    pairs = vectors.repartition(F.xxhash64("keys")).join(small_side(asked), "width")
    found = pairs.select("ids", "asked", "keys", "matrix").mapInArrow(_nearest(k, least), "query_id long, vec_id long, score double")
    return ranked(found, ["query_id"], [F.desc("score"), "vec_id"], k)


def ranked(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, query, expansions): the query with the variants of each term that it names; terms (term, kind, variant, expandable).

    A query names a term by the term itself or by one of its exact variants.
    """
    usable = terms.where("kind <> 'force'")
    names = usable.select("term", F.col("term").alias("name")).unionByName(usable.where("kind = 'exact'").select("term", F.col("variant").alias("name"))).distinct()
    named = queries.join(F.broadcast(names), F.contains(F.col("query"), F.col("name"))).select("query_id", "term").distinct()
    more = usable.where("kind = 'exact' or expandable").select("term", "variant")
    found = named.join(F.broadcast(more), "term").groupBy("query_id").agg(F.collect_set("variant").alias("v"))
    rows = queries.join(found, "query_id", "left")
    return rows.select("query_id", "query", F.array_sort(F.array_union(F.array("query"), F.coalesce("v", F.array().cast("array<string>")))).alias("expansions"))


def keyword_search(queries: DataFrame, corpus: DataFrame, k: int, legal: list[str] = (), least: float = 0.1, strict: bool = False, category: str | None = None) -> DataFrame:
    """queries (query_id, query, expansions) against corpus (ord, law, article, title, content, keywords).

    0.5 for the query in an entry's text (all of those columns), 0.2 for each
    expansion in it, the query being one; 0.4 or 0.15 for each entry keyword (a
    legal term or not); 0.3 for the query in the title and 0.15 for each
    expansion in it; at most 2. strict: entries without any expansion score 0.
    With a category only its entries are searched.
    """
    if category:
        corpus = corpus.where(F.col("category") == category)
    q, e = F.lower("query"), F.transform("expansions", lambda x: F.lower(x))
    parts = [c for c in ("law", "article", "title", "content") if c in corpus.columns]
    text, title = F.lower(F.concat_ws(" ", *parts, F.array_join("keywords", " "))), F.lower("title")
    inside = lambda where: F.size(F.filter(e, lambda x: F.contains(where, x)))
    special = F.size(F.filter("keywords", lambda x: x.isin(*legal))) if legal else F.lit(0)
    score = F.when(F.contains(text, q), 0.5).otherwise(0.0) + 0.2 * inside(text) + 0.4 * special + 0.15 * (F.size("keywords") - special)
    score = F.least(F.lit(2.0), score + F.when(F.contains(title, q), 0.3).otherwise(0.0) + 0.15 * inside(title))
    if strict:
        score = F.when(inside(text) > 0, score).otherwise(0.0)
    scored = corpus.crossJoin(F.broadcast(queries)).select("query_id", "ord", score.alias("score"))
    return ranked(scored.where(F.col("score") > least), ["query_id"], [F.desc("score"), "ord"], k)


def forced(queries: DataFrame, terms: DataFrame, corpus: DataFrame, score: float = 0.7) -> DataFrame:
    """(query_id, ord, score): entries with a keyword among the forced terms that a query contains; an equi join on the term."""
    f = terms.where("kind = 'force'")
    detected = queries.join(F.broadcast(f), F.contains(F.col("query"), F.col("variant"))).select("query_id", "term").distinct()
    index = corpus.select("ord", F.explode("keywords").alias("term"))
    return detected.join(index, "term").select("query_id", "ord").distinct().withColumn("score", F.lit(score))


def fused(vector: DataFrame, keyword: DataFrame, force: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, ord, score) tables: both ranks over the union, zeros ranked too, forced scores count as keyword scores."""
    paths = [vector.select("query_id", "ord", F.col("score").alias("v"), F.lit(0.0).alias("k")), *[t.select("query_id", "ord", F.lit(0.0).alias("v"), F.col("score").alias("k")) for t in (keyword, force)]]
    union = paths[0].unionByName(paths[1]).unionByName(paths[2]).groupBy("query_id", "ord").agg(F.max("v").alias("v"), F.max("k").alias("k"))
    by = Window.partitionBy("query_id")
    rv, rk = (F.row_number().over(by.orderBy(F.desc(c), "ord")) for c in ("v", "k"))
    return ranked(union.withColumn("score", 1 / (rv + RRF) + 1 / (rk + RRF)), ["query_id"], [F.desc("score"), "ord"], k)


def case_search(queries: DataFrame, cases: DataFrame, k: int = 5, court: str | None = None, case_type: str | None = None) -> DataFrame:
    """queries (query_id, query) against cases (ord, title, issue, holding, keywords).

    Only cases whose court contains ``court`` and whose type is ``case_type``, where those are told.

    2 for each query word in the case, 3 for each in its keywords, 5 times the
    Jaccard of bigrams; normalised by 5 n + 5, at most 1.
    """
    if court:
        cases = cases.where(F.contains(F.coalesce("court", F.lit("")), F.lit(court)))
    if case_type:
        cases = cases.where(F.col("case_type") == case_type)
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) >= 2)
    text = F.lower(F.concat_ws(" ", "title", "issue", "holding", F.array_join("keywords", " ")))
    keys = F.lower(F.array_join("keywords", " "))
    hits = lambda where: F.size(F.filter(words, lambda w: F.contains(where, w)))
    raw = 2 * hits(text) + 3 * hits(keys) + 5 * jaccard(grams(F.lower("query"), 2), grams(text, 2))
    scale = F.when(F.size(words) > 0, 5 * F.size(words) + 5).otherwise(1)
    scored = cases.crossJoin(F.broadcast(queries)).select("query_id", "ord", raw.alias("raw"), F.least(F.lit(1.0), raw / scale).alias("score"))
    return ranked(scored.where("raw > 0").drop("raw"), ["query_id"], [F.desc("score"), "ord"], k)


def provisions_with(provisions: DataFrame, word: str) -> DataFrame:
    """Plain search: the word, case ignored, in content, title or a keyword."""
    w = F.lit(word.lower())
    return provisions.where(F.contains(F.lower("content"), w) | F.contains(F.lower("title"), w) | F.exists("keywords", lambda x: F.contains(F.lower(x), w)))


def citation(provisions: DataFrame, law: str, article: str) -> DataFrame:
    return provisions.where(F.contains("law", F.lit(law)) & F.contains("article", F.lit(article))).orderBy("ord").limit(1)


def absent(new: DataFrame, known: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows to load: those whose key the index does not have."""
    return new.join(known.select(key), key, "left_anti")


def local_search(queries: DataFrame, provisions: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ord, score, rank): 0.9 for the whole query in an entry's text, else by the share of its bigrams there.

    queries (query_id, query) are a stated, small set. No bigram in common is no hit.
    """
    q = F.lower("query")
    text = F.lower(F.concat_ws(" ", "law", "title", "content"))
    share = containment(grams(q, 2), grams(text, 2))
    score = F.when(F.contains(text, q), 0.9).when(share >= 0.5, 0.4 + 0.4 * share).when(share > 0, 0.5 * share)
    scored = provisions.crossJoin(F.broadcast(queries)).select("query_id", "ord", F.round(score, 3).alias("score"))
    return ranked(scored.where("score is not null"), ["query_id"], [F.desc("score"), "ord"], k)


def corrections(queries: DataFrame, records: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """(query_id, ord, why, score, rank): corrections for clauses (query_id, clause, risk_name), a stated, small set.

    Those of similar clause texts, best first; where there is none, the latest
    of the same risk. Both are scored in one pass over records (ord,
    clause_text, risk_name).
    """
    alike = similarity(F.coalesce("clause", F.lit("")), F.coalesce("clause_text", F.lit("")))
    q = F.broadcast(queries.withColumnRenamed("risk_name", "asked"))
    pairs = records.crossJoin(q).select("query_id", "ord", F.round(alike, 6).alias("score"), ((F.length("asked") > 0) & F.contains("risk_name", F.col("asked"))).alias("same"))
    near = ranked(pairs.where(F.col("score") >= least), ["query_id"], [F.desc("score"), "ord"], k).withColumn("why", F.lit("text"))
    late = ranked(pairs.where("same").join(near.select("query_id").distinct(), "query_id", "left_anti"), ["query_id"], [F.desc("ord")], k).withColumn("why", F.lit("risk"))
    columns = ["query_id", "ord", "why", "score", "rank"]
    return near.select(*columns).unionByName(late.select(*columns))


def cited_freshness(cited: DataFrame, provisions: DataFrame, cases: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """(cited_id, item_type, name, status, days, severity) of cited items that are out of date or long unverified.

    cited (cited_id, item) is text; a provision is meant where its law or its
    article occurs in it, a case where its number does. The reference tables are
    a fixed, small knowledge base and are broadcast.
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.try_to_date("last_verified", "yyyy-MM-dd"))
    item = F.col("item")
    in_item = lambda c: (F.length(c) > 0) & F.contains(item, F.col(c))
    p = provisions.select("law", "article", "name", "status", age.alias("days"))
    p = cited.join(F.broadcast(p), in_item("law") | in_item("article"))
    stale = F.when(F.col("status") != "active", "critical").when(F.col("days") > days, "warning")
    c = cited.join(F.broadcast(cases.select("case_number", "name", "status", age.alias("days"))), in_item("case_number"))
    columns = ["cited_id", "item_type", "name", "status", "days", "severity"]
    p = p.withColumns({"item_type": F.lit("provision"), "severity": stale})
    c = c.withColumns({"item_type": F.lit("case"), "severity": F.when(F.col("days") > days, "warning")})
    return p.select(*columns).unionByName(c.select(*columns)).where("severity is not null")


def _relevance(text: Column, keywords: Column, title: Column, same: Column) -> Column:
    """0.3 for each provision keyword and for the title in the text, 0.2 for the same category; at most 1."""
    words = F.size(F.filter(keywords, lambda w: F.contains(text, F.lower(w))))
    named = (F.length(title) > 0) & F.contains(text, F.lower(title))
    return F.least(F.lit(1.0), 0.3 * words + F.when(named, 0.3).otherwise(0.0) + F.when(same, 0.2).otherwise(0.0))


def statutes(risks: DataFrame, hybrid: DataFrame, provisions: DataFrame, k: int = 5, enough: int = 3) -> DataFrame:
    """(risk_id, ord, law, article, reason, score, rank): the k provisions that fit a risk best.

    risks are (risk_id, description, category, expansions), hybrid the fused
    search (query_id, ord, score) of their descriptions. Where it has fewer than
    ``enough`` provisions, those of other articles that score over 0.3 by
    keywords, title and category join them, by the description or, below 0.3,
    by its best expansion. provisions are a reference table, told to all tasks.
    """
    law = provisions.select("ord", "law", "article", "title", "keywords", F.col("category").alias("p_category"))
    found = hybrid.select(F.col("query_id").alias("risk_id"), "ord", "score").join(F.broadcast(law), "ord")
    few = risks.join(found.groupBy("risk_id").agg(F.count("*").alias("n")), "risk_id", "left").where(F.coalesce("n", F.lit(0)) < enough).drop("n")
    same = F.coalesce((F.col("category") != "") & (F.col("category") == F.col("p_category")), F.lit(False))
    by = lambda text: _relevance(text, F.col("keywords"), F.col("title"), same)
    own = by(F.lower("description"))
    best = F.array_max(F.transform(F.filter("expansions", lambda x: x != F.col("description")), lambda x: by(F.lower(x))))
    score = F.when(own < 0.3, F.greatest(own, F.coalesce(best, F.lit(0.0)))).otherwise(own)
    # a provision can only pass 0.3 if some text of the risk names it
    texts = F.lower(F.concat_ws("\n", "description", "expansions"))
    names = F.exists("keywords", lambda w: F.contains(texts, F.lower(w))) | F.contains(texts, F.lower("title"))
    others = few.join(F.broadcast(law), names).select("risk_id", *law.columns, score.alias("score")).where("score > 0.3")
    others = others.join(found.select("risk_id", "article").distinct(), ["risk_id", "article"], "left_anti")
    both = found.withColumn("place", F.lit(0)).unionByName(others.withColumn("place", F.lit(1)), allowMissingColumns=True).join(risks.select("risk_id", "description"), "risk_id")
    named = F.filter("keywords", lambda w: F.contains(F.lower("description"), F.lower(w)))
    both = both.withColumn("reason", F.when(F.size(named) > 0, F.concat(F.lit("匹配关键词："), F.array_join(named, ", "))).otherwise(F.lit("与风险描述相关")))
    return ranked(both, ["risk_id"], [F.desc("score"), "place", "ord"], k).select("risk_id", "ord", "law", "article", "reason", "score", "rank")
