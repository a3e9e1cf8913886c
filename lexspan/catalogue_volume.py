"""Queries of the operators that keep an index or an algorithm of their own, over the given tables at their full size.

Queries of a search are all items of ``benchmark``, or rows whose id is
divisible by 100, against all rows.
"""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexspan import catalogue  # noqa: F401, its SQL is used again
from lexspan.operators import dialog, inverted, metrics, retrieval, rule_table, set_join, trees, vectors
from lexspan.plans.packs import Rule
from lexspan.registry import ORACLE_SQL, lit, query, table
from lexspan.sources.feedback_log import FeedbackLog
from lexspan.streaming import capacity
from lexspan.tables import shared_folder

#: weights of an entry's fields in hundredths: its text, its title, its keywords
FIELDS = {"text": 20, "title": 15, "keywords": 40}


def entries(docs):
    """documents as entries of a keyword index: the first line is the title, language and source are keywords."""
    return docs.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"), F.array_compact(F.array("lang", "source")).alias("keywords"))


def item_words(benchmark):
    return benchmark.select(F.col("item_id").alias("query_id"), inverted.words(F.col("text")).alias("words"))


_WORDS = "unnest(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')))"
_IMPACTS = f"""
    select doc_id, word, sum(w)::bigint as impact from (
        select doc_id, {_WORDS.format('text')} as word, 20 as w from documents
        union all select doc_id, {_WORDS.format("split_part(text, chr(10), 1)")}, 15 from documents
        union all select doc_id, unnest(list_distinct([x for x in [lower(lang), lower(source)] if x is not null])), 40 from documents
    ) group by all"""


@query(f"""
    with impacts as ({_IMPACTS}), asked as (select item_id, {_WORDS.format('text')} as word from benchmark),
    scores as (select item_id, doc_id, sum(impact)::bigint as score from asked join impacts using (word) group by all),
    ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores)
    select item_id, doc_id, score, rank from ranked where rank <= 10""")
def q_keyword_index(spark, sf_dir):
    """The ten best documents of every item by an inverted index."""
    index = inverted.build(entries(table(spark, sf_dir, "documents")), shared_folder(spark, "keyword-index"), FIELDS, "doc_id")
    found = inverted.search(index, item_words(table(spark, sf_dir, "benchmark")), 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


@query(f"""
    with impacts as ({_IMPACTS}), asked as (select item_id, {_WORDS.format('text')} as word from benchmark)
    select item_id, count(*) as n, sum(impact)::bigint as impact from (
        select item_id, doc_id, impact from asked join impacts using (word)
        where word in (select word from impacts group by word having count(*) <= 3)
    ) group by item_id""")
def q_term_lookup(spark, sf_dir):
    """Documents forced by an item's words that at most three documents have, looked up in the inverted index."""
    index = inverted.build(entries(table(spark, sf_dir, "documents")), shared_folder(spark, "term-index"), FIELDS, "doc_id")
    rare = index.table(spark, "terms").where("n <= 3").select("word")
    terms = item_words(table(spark, sf_dir, "benchmark")).select(F.col("query_id").alias("term_id"), F.explode("words").alias("word")).join(rare, "word")
    return inverted.holding(index, terms).groupBy(F.col("term_id").alias("item_id")).agg(F.count("*").alias("n"), F.sum("impact").alias("impact"))


@query(ORACLE_SQL["q_vector_topk"])
def q_vector_index(spark, sf_dir):
    """The ten nearest of every hundredth vector by an inverted-file index, probed until no other cell can hold one."""
    e = table(spark, sf_dir, "embeddings")
    index = vectors.build(e, shared_folder(spark, "vector-index"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vectors.search(index, queries, 10, least=0.3, exact=True)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _runs_sql(text: str, n: int) -> str:
    """The distinct runs of n words, as set_join.shingles has them."""
    run = f"lambda w: list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    return f"list_distinct(list_filter(flatten(list_transform([regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')], {run})), lambda x: x <> ''))"


def _pairs_sql(left: str, right: str, score: str, least: float) -> str:
    """Pairs of classes from SQL of (id, grams) of both sides, by counting all grams in common."""
    return f"""
        with l as (select min(id) as l, count(*) as n_left, grams, len(grams) as l_size from (select id, list_sort(grams) as grams from ({left})) where len(grams) > 0 group by grams),
        lg as (select l, n_left, l_size, unnest(grams) as gram from l), vocabulary as (select distinct gram from lg),
        rg as (select id, len(grams) as r_size, unnest(grams) as gram from ({right})),
        r as (select id, r_size, list(gram order by gram) as grams from rg where gram in (select gram from vocabulary) group by all),
        rc as (select min(id) as r, count(*) as n_right, r_size, grams from r group by grams, r_size),
        met as (
            select l, r, n_left, n_right, l_size, r_size, count(*) as common from lg join (select r, n_right, r_size, unnest(grams) as gram from rc) using (gram) group by all
        )
        select l, r, n_left, n_right, common, round({score}, 6) as score from met where {score} >= {least}"""


def _pairs(found):
    return found.pairs.select(F.col("left").alias("l"), F.col("right").alias("r"), "n_left", "n_right", "common", F.round("score", 6).alias("score"))


@query(_pairs_sql(f"select item_id as id, {_runs_sql('text', 3)} as grams from benchmark", f"select doc_id as id, {_runs_sql('text', 3)} as grams from documents", "common / l_size", 0.5))
def q_containment(spark, sf_dir):
    """Documents that hold at least half of an item's runs of three words."""
    runs = lambda t, key: t.select(F.col(key).alias("id"), set_join.shingles(F.col("text"), 3).alias("grams"))
    return _pairs(set_join.similar(runs(table(spark, sf_dir, "benchmark"), "item_id"), runs(table(spark, sf_dir, "documents"), "doc_id"), 0.5))


_TURN = "conv_id * 1000 + turn"


@query(
    _pairs_sql(
        f"select {_TURN} as id, {_runs_sql('text', 2)} as grams from conversations where conv_id % 100 = 0",
        f"select {_TURN} as id, {_runs_sql('text', 2)} as grams from conversations", "common / (l_size + r_size - common)", 0.3,
    )
)
def q_similar_turns(spark, sf_dir):
    """Turns that share three tenths of their pairs of words with a turn of every hundredth conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.expr(_TURN).alias("id"), set_join.shingles(F.col("text"), 2).alias("grams"))
    return _pairs(set_join.similar(turns.where("id div 1000 % 100 = 0"), turns, 0.3, "jaccard"))


def large_pack(n: int) -> list[Rule]:
    """A pack of n rules whose keywords are made of parts of the documents' words; every hundredth asks for a clause."""
    rng = random.Random(n)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "es", "or", "ti", "ch", "qu", "ge", "sch", "que", "eau", "ción", "mente", " d", ". A"]
    word = lambda most: "".join(rng.choice(parts) for _ in range(rng.randrange(2, most)))
    out = []
    for i in range(n):
        words = lambda k, most=5: tuple(word(most) for _ in range(k))
        if i % 100 == 7:
            out.append(Rule(f"MISSING_{i}", f"clause {i}", "completeness", "high", ("contract",), "missing", presence=words(3, 4), substance=("[0-9]{2}", word(3).strip())))
        else:
            strict = i % 3 == 0
            out.append(Rule(f"COND_{i}", f"condition {i}", "style", "low", ("contract",), "condition", risk=words(1 + i % 3), safe=words(i % 2, 4), require_safe_absence=strict))
    return out


def _large_pack_sql(pack: list[Rule]) -> str:
    rows = ",".join(
        f"({i},{lit(r.rule_id)},{lit(r.level)},{str(r.missing).lower()},{str(r.require_safe_absence).lower()},{_list(r.presence)},{_list(r.risk)},{_list(r.safe)},{_list(r.substance)})" for i, r in enumerate(pack)
    )
    hits = lambda c: f"len(list_filter({c}, lambda w: contains(body, w)))"
    return f"""
        with rules as (select * from (values {rows}) as t(ord, rule_id, risk_level, missing, strict, presence, risk, safe, substance)),
        counts as (
            select doc_id, ord, rule_id, risk_level, missing, strict, {hits('presence')} as p, {hits('risk')} as r, {hits('safe')} as s,
                len(presence) as np, len(risk) as nr, len(safe) as ns, missing and len(list_filter(substance, lambda x: regexp_matches(body, x))) > 0 as there
            from (select doc_id, lower(text) as body from documents), rules
        ), found as (
            select doc_id, ord, rule_id, risk_level, case when missing then case when p = 0 then 0.9 when not there then greatest(0.3, 0.7 - 0.3 * (p / np)) end
                when r > 0 and not (s >= r and s > 0) and not (strict and s > 0) then greatest(0.3, least(0.95, 0.5 + 0.4 * (r / nr) - 0.4 * (s / greatest(ns, 1)))) end as confidence
            from counts
        )
        select doc_id, ord, rule_id, risk_level, round(confidence::double, 6) as confidence from found where confidence is not null"""


def _list(words) -> str:
    return f"[{','.join(map(lit, words))}]::varchar[]"


LARGE = large_pack(1000)


@query(_large_pack_sql(LARGE))
def q_rule_table(spark, sf_dir):
    """A pack of a thousand rules as a table."""
    found = rule_table.findings(table(spark, sf_dir, "documents"), LARGE)
    return found.select("doc_id", "ord", "rule_id", "risk_level", F.round("confidence", 6).alias("confidence"))


def outline(docs):
    """The lines of documents as nodes: the fewer words, the higher the heading."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    n = F.size(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return lines.select("doc_id", "ord", n.alias("words")).where("words > 0").withColumn("level", F.expr("case when words <= 3 then 0 when words <= 10 then 1 when words <= 25 then 2 else 3 end"))


@query("""
    with recursive lines as (
        select doc_id, ord, words, case when words <= 3 then 0 when words <= 10 then 1 when words <= 25 then 2 else 3 end as level from (
            select doc_id, ord, len(regexp_extract_all(line, '[\\p{L}\\p{N}]+')) as words
            from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents)
        ) where words > 0
    ), parents as (
        select a.*, (select max(b.ord) from lines b where b.doc_id = a.doc_id and b.ord < a.ord and b.level < a.level) as parent from lines a
    ), up as (
        select doc_id, ord, ord as above, 0 as steps, words from parents
        union all select u.doc_id, u.ord, p.parent, u.steps + 1, u.words from up u join parents p on p.doc_id = u.doc_id and p.ord = u.above where p.parent is not null
    ), depths as (select doc_id, ord, max(steps) as depth from up group by all)
    select doc_id, above - 1 as ord, depth, count(*) - 1 as n_descendants, sum(words)::bigint as subtotal
    from up join depths on up.doc_id = depths.doc_id and up.above = depths.ord group by up.doc_id, above, depth""".replace("select doc_id, above - 1", "select up.doc_id, above - 1"))
def q_subtrees(spark, sf_dir):
    """For each line of a document the depth, nodes and words of the outline below it."""
    rows = trees.numbered(outline(table(spark, sf_dir, "documents")), "level", value="words", levels=4)
    return rows.select("doc_id", "ord", "depth", "n_descendants", "subtotal")


def _stream(spark, sf_dir, name: str, files: int = 1):
    """A given table, a folder or one file, as a stream of its files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    one = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    read = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files)
    # a stream's path is a folder
    return read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    select user_id as record_id, event_type as user_action, value, event_id
    from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where user_id is not null) where n = 1""")
def q_feedback_log(spark, sf_dir):
    """Events as a stream of records by user, merged batch by batch, compacted; the last record of each."""
    folder = shared_folder(spark, "feedback-log")
    log = FeedbackLog(f"{folder}/log", order=("ts", "event_id"))
    records = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), "ts", "event_id", F.col("event_type").alias("user_action"), "value")
    log.follow(records, f"{folder}/checkpoint").awaitTermination()
    log.compact(spark)
    return log.current(spark).select("record_id", "user_action", "value", "event_id")


@query("""
    select ts::date as day, event_type as stage, count(*) as n, round(sum(value), 2) as total, true as quantiles_hold, true as users_hold from events where ts is not null group by all""")
def q_metrics_daily(spark, sf_dir):
    """A day's metrics from its hours' sketches, held to exact ranks and counts."""
    events = table(spark, sf_dir, "events")
    days = metrics.merged(metrics.hourly(events), ["day", "stage"])
    exact = events.where("ts is not null").join(
        metrics.told(days).select(F.col("day").alias("d"), F.col("stage").alias("s"), "p50", "p95", "users"), (F.to_date("ts") == F.col("d")) & F.col("event_type").eqNullSafe(F.col("s"))
    )
    below = lambda p, strict: F.avg((F.col("value") < F.col(p) if strict else F.col("value") <= F.col(p)).cast("double"))
    held = lambda p, rank: (below(p, True) <= rank + metrics.RANK_ERROR) & (below(p, False) >= rank - metrics.RANK_ERROR)
    users = F.abs(F.first("users") - F.count_distinct("user_id")) <= F.greatest(F.lit(1.0), metrics.DISTINCT_ERROR * F.count_distinct("user_id"))
    checks = exact.groupBy("d", "s").agg((held("p50", 0.5) & held("p95", 0.95)).alias("quantiles_hold"), users.alias("users_hold"))
    found = days.join(checks, (F.col("day") == F.col("d")) & F.col("stage").eqNullSafe(F.col("s")))
    return found.select("day", "stage", "n", F.round("total", 2).alias("total"), "quantiles_hold", "users_hold")


@query()
def q_session_capacity(spark, sf_dir):
    """Sessions of events by user that end by idleness or because their shard is full; tests hold it to a sequential model."""
    folder = shared_folder(spark, "sessions")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, capacity.ROCKS)
    try:
        ended = capacity.ended_sessions(_stream(spark, sf_dir, "events"), most=20, ttl_ms=6 * 3_600_000, shards=8)
        ended.writeStream.format("parquet").option("path", f"{folder}/ended").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(capacity.ENDED).parquet(f"{folder}/ended")


@query(f"""
    with impacts as ({_IMPACTS}), asked as (select doc_id as q, {_WORDS.format('split_part(text, chr(10), 1)')} as word from documents where doc_id % 100 = 0),
    scores as (select q, doc_id, sum(impact) / 100.0 as k from asked join impacts using (word) group by all),
    keyword as (select q, doc_id as ord, k from (select *, row_number() over (partition by q order by k desc, doc_id) as n from scores) where n <= 20),
    force as (select distinct q, doc_id as ord, 0.7 as k from asked join impacts using (word) where word in (select word from impacts group by word having count(*) <= 3)),
    far as (
        select q.vec_id as q, c.vec_id as ord, greatest(0.0, 1 - list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) as v
        from embeddings c, embeddings q where q.vec_id % 100 = 0
    ), vector as (select q, ord, v from (select *, row_number() over (partition by q order by v desc, ord) as n from far where v >= 0.3) where n <= 20),
    united as (select q, ord, max(v) as v, max(k) as k from (select q, ord, v, 0.0 as k from vector union all select q, ord, 0.0, k from keyword union all select q, ord, 0.0, k from force) group by all),
    fused as (select q, ord, 1 / (row_number() over (partition by q order by v desc, ord) + 60) + 1 / (row_number() over (partition by q order by k desc, ord) + 60) as score from united)
    select q as query_id, ord, rank::bigint as rank, round(score, 9) as score from (select *, row_number() over (partition by q order by round(score, 12) desc, ord) as rank from fused) where rank <= 5""")
def q_hybrid_index(spark, sf_dir):
    """Every hundredth document by its first line and its vector; ranks of both indexes and of forced documents are fused."""
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    folder = shared_folder(spark, "hybrid")
    index = inverted.build(entries(docs), f"{folder}/words", FIELDS, "doc_id")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), inverted.words(F.substring_index("text", "\n", 1)).alias("words"))
    keyword = inverted.search(index, asked, 20).select("query_id", "ord", (F.col("score") / 100).alias("score"))
    rare = index.table(spark, "terms").where("n <= 3").select("word")
    force = inverted.holding(index, asked.select(F.col("query_id").alias("term_id"), F.explode("words").alias("word")).join(rare, "word"))
    force = force.select(F.col("term_id").alias("query_id"), "ord").distinct().withColumn("score", F.lit(0.7))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectors.search(vectors.build(e, f"{folder}/vectors"), queries, 20, least=0.3, exact=True).select("query_id", F.col("vec_id").alias("ord"), "score")
    found = retrieval.fused(near, keyword, force, 5)
    return found.select("query_id", "ord", "rank", F.round("score", 9).alias("score"))


@query("""
    select event_id, event_type from (select *, row_number() over (partition by done order by ts, event_id) as n, count(*) over (partition by done) as total
        from (select *, event_type in ('purchase', 'error') as done from events)) where not done or n > total // 2""")
def q_task_half(spark, sf_dir):
    """Of the tasks that are done, purchases and errors, the older half goes."""
    kept = dialog.without_oldest_half(table(spark, sf_dir, "events"), 100, F.col("event_type").isin("purchase", "error"), "ts", "event_id")
    return kept.select("event_id", "event_type")
