"""The registered queries op1 to op13 over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import scratch


#: target weights of the sources of documents: the first, which may hold a third of all rows, weighs 1.5 of the others
TARGETS = {"src0": "1.5"}
DEFAULT_TARGET = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(column: str, modulus: int):
    """True where crc32 of the id as text, modulo modulus, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~_split("doc_id", 4))
    lexicon = toxicity.learn(docs, labels, tag="op1")
    rows = toxicity.score(docs, lexicon)
    return rows.select("doc_id", _split("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.pii import find

    return find(_table(spark, sf_dir, "documents"), tag="op2")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm import lm

    docs = _table(spark, sf_dir, "documents").select("doc_id", _split("doc_id", 7).alias("held_out"), "text")
    model = lm.train(docs.where("not held_out"), tag="op3")
    rows = lm.score(docs, model)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.quality import judge

    rows = judge(_table(spark, sf_dir, "documents"), tag="op4")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.simhash import hex_fingerprint, near_groups

    groups = near_groups(_table(spark, sf_dir, "documents"), words=4, tag="op5")
    return groups.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), targets=TARGETS, default=DEFAULT_TARGET, tag="op6")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.sharding import shard_rows

    rows = shard_rows(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.warc import archive

    pages = archive(_table(spark, sf_dir, "pages"), scratch.mounted_folder(spark, "op8-warc"), least=0, tag="op8", texts=False)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tag="op9")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.exact_dedup import ExactGroups

    return ExactGroups(_table(spark, sf_dir, "documents").select("doc_id", "text"), tag="op10").decisions()


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), tag="op12")


def op13_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.sequences import click_events, closed, mine

    found = closed(mine(click_events(_table(spark, sf_dir, "clicks")), tag="op13"))
    return found.select(F.array_join("pattern", ">").alias("pattern"), F.size("pattern").alias("length"), "support", "clients_crc", "n_wider", "closed")


_ALL = (
    op1_toxicity, op2_pii, op3_lm_scoring, op4_quality, op5_simhash, op6_mixing, op7_sharding, op8_warc, op9_packing, op10_exact_dedup,
    op11_token_counts, op12_lexical_search, op13_sequences,
)
QUERIES = {f.__name__: f for f in _ALL}


def _crc_sql(x: str) -> str:
    """CRC-32 of an integer's decimal digits, bit by bit."""
    bit = "lambda u, z: xor(u >> 1, 3988292384 * (u & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), {byte}), 4294967295::BIGINT)"


def _longer_sql(shorter: str) -> str:
    """The occurrences of patterns one event longer, each with its latest first event."""
    return f"""
        select o.client, o.session, o.p || '>' || e.type as p, e.us, max(o.begun) as begun
        from {shorter} o join e on e.client = o.client and e.session = o.session
            and e.us > o.us and e.us - o.us <= 900000000 and e.us - o.begun <= 2250000000
        group by all"""


ORACLE_SQL = {
    "op10_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as body from documents)
        select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
               doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from t
    """,
    "op12_lexical_search": """
        with words as (
            select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from documents
        ), tf as (select doc_id, term, count(*) as tf from words group by all),
        lengths as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
        total as (select count(*) as nd, sum(n)::bigint as nt from lengths),
        dfs as (select term, count(*) as df from tf group by term),
        asked as (
            select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from benchmark
        ), scores as (
            select item_id, doc_id, sum(floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint
                * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt))))::bigint as score
            from asked join tf using (term) join dfs using (term) join lengths using (doc_id) cross join total
            group by item_id, doc_id
        ), ranked as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= 50
    """,
    # an occurrence never leaves a session, a run of a client's events of which neighbours are at most the gap apart
    "op13_sequences": f"""
        with c as (
            select client_id as client, epoch_us(ts) as us, kind as type, click_id from clicks
            where client_id is not null and ts is not null and kind is not null
        ), marked as (select client, us from c where {_crc_sql('click_id')} % 5 = 0),
        all_events as (
            select client, us, type from c
            union select client, us - 1000000, 'open' from marked
            union select client, us + 1000000, 'shut' from marked
        ), gaps as (
            select *, case when us - lag(us) over (partition by client order by us) > 900000000 then 1 else 0 end as new from all_events
        ), e as (
            select client, us, type, sum(new) over (partition by client order by us range between unbounded preceding and current row) as session from gaps
        ), o1 as (select client, session, type as p, us, us as begun from e),
        o2 as ({_longer_sql('o1')}), o3 as ({_longer_sql('o2')}), o4 as ({_longer_sql('o3')}),
        who as (
            select distinct p, client from (select p, client from o1 union all select p, client from o2 union all select p, client from o3 union all select p, client from o4)
        ), crcs as (select client, {_crc_sql('client')} as crc from (select distinct client from e)),
        kept as (
            select p, len(string_split(p, '>'))::int as length, count(*) as support, sum(crc)::bigint as crc, '<' || replace(p, '>', '><') || '>' as parts
            from who join crcs using (client) group by p
            having count(*) >= 2 and 100 * count(*) >= 30 * (select count(*) from crcs)
        ), wider as (
            select a.p, count(*) as n from kept a join kept b
            on a.support = b.support and b.length > a.length and b.parts like '%' || replace(a.parts, '><', '>%<') || '%' group by a.p
        )
        select p as pattern, length, support, crc as clients_crc, coalesce(n, 0)::bigint as n_wider, coalesce(n, 0) = 0 as closed
        from kept left join wider using (p)
    """,
}
