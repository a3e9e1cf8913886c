"""Conversations, sessions, tasks, agent steps, feedback, freshness and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.edit import any_alike
from lexspan.functions.text import first_match, keyword_hits
from lexspan.tables import in_order

#: price per million tokens in and out (fixed values); an unknown model has the second's
PRICES = {
    "qwen-turbo": (0.8, 2.0), "qwen-plus": (4.0, 12.0), "qwen-max": (20.0, 60.0), "qwen-long": (0.5, 2.0),
    "gpt-4o": (18.0, 54.0), "gpt-4o-mini": (1.1, 3.3), "gpt-3.5-turbo": (1.1, 3.3), "mimo-v2.5-pro": (2.0, 6.0), "mimo-v2-pro": (2.0, 6.0),
}
DEFAULT_PRICE = PRICES["qwen-plus"]


def last_n(messages: DataFrame, n: int, roles: tuple[str, ...] = ()) -> DataFrame:
    """The last n messages of each conversation, then only those of the roles."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    out = messages.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    return out.where(F.col("role").isin(*roles)) if roles else out


def quick_reply(messages: DataFrame, replies: list[tuple[str, list[str]]], most: int = 2000) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    reply = F.when(F.length(text) > most, F.lit("too long")).otherwise(first_match(F.lower(text), replies))
    return messages.select("conv_id", "turn", reply.alias("reply"))


def sessions(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a key that end after a gap: (key, session, n_events, started, ended)."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    at = F.col(ts).cast("timestamp")
    far = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > gap_seconds * 1_000_000
    df = events.withColumn("session", F.sum(F.coalesce(far, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def live_sessions(events: DataFrame, as_of: str, ttl_seconds: int, most: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, updated, rank): keys last updated within the time to live, the newest ``most`` of them."""
    last = events.groupBy(key).agg(F.max(ts).alias("updated"))
    fresh = last.where(F.col("updated") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    top = fresh.orderBy(F.desc("updated"), key).limit(most)
    # at most ``most`` rows are left, so one window over them is small
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("updated"), key)).cast("long"))


def newest(rows: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def retained(rows: DataFrame, key: str, by: str, tie: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.desc(tie))
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")


def without_oldest_half(tasks: DataFrame, most: int, done, at: str, tie: str) -> DataFrame:
    """tasks without the older half of the done ones, where more than half of ``most`` are done.

    done is a condition; at is the time of completion (null: the oldest) and
    tie settles equal ones. An odd number keeps the larger half.
    """
    rows = tasks.where(done)
    n = rows.count()
    if n <= most // 2:
        return tasks
    keys = in_order(rows.select(at, tie), [F.asc_nulls_first(at), F.asc(tie)], "__n").where(F.col("__n") <= n // 2).select(F.col(tie).alias("__gone"))
    return tasks.join(keys, F.col(tie) == F.col("__gone"), "left_anti")


def stagnation(steps: DataFrame, run: str = "run_id", order: str = "step") -> DataFrame:
    """steps (run, step, tool, args, content) with repeated and empty flags.

    repeated: a step's tool and normalised arguments equal the last step's, or
    its tool that of the two before it. empty: it and the last step have none.
    """
    w = Window.partitionBy(run).orderBy(order)
    args = F.lower(F.regexp_replace(F.trim("args"), r"\s+", " "))
    df = steps.withColumn("__a", args)
    same = (F.lag("tool", 1).over(w) == F.col("tool")) & (F.lag("__a", 1).over(w) == F.col("__a"))
    three = (F.lag("tool", 1).over(w) == F.col("tool")) & (F.lag("tool", 2).over(w) == F.col("tool"))
    blank = F.length(F.trim(F.coalesce("content", F.lit("")))) == 0
    empty = blank & F.coalesce(F.lag(blank, 1).over(w), F.lit(False))
    return df.withColumns({"repeated": F.coalesce(same | three, F.lit(False)), "empty": empty}).drop("__a")


#: fixed values: words of a result that found nothing
NOTHING_FOUND = ["未找到", "没有找到", "不存在", "无相关", "not found", "no results", "无匹配"]


def information_gain(steps: DataFrame, run: str = "run_id", order: str = "step", gain: float = 0.2, most_empty: int = 2, back: int = 4) -> DataFrame:
    """The tool results of steps (run, step, action, content) with low_gain and no_results.

    low_gain: more like a result of the last ``back`` steps than 1 - gain allows,
    by the first 2,000 characters. no_results: it and at least ``most_empty``
    results right before it found nothing, by their words.
    """
    by = Window.partitionBy(run).orderBy(order)
    body = F.coalesce("content", F.lit(""))
    result = F.col("action") == "tool_result"
    df = steps.withColumn("__last", F.collect_list(F.when(result, body)).over(by.rowsBetween(-back, -1)))
    df = df.where(result).withColumn("__none", keyword_hits(body, NOTHING_FOUND) > 0)
    df = df.withColumn("__group", F.sum((~F.col("__none")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("__none").cast("int")).over(Window.partitionBy(run, "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    alike = any_alike(body, F.col("__last"), 1 - gain)
    return df.withColumns({"low_gain": alike, "no_results": F.col("__none") & (streak >= most_empty)}).drop("__last", "__none", "__group")


def paired_calls(messages: DataFrame, call: str = "user", result: str = "assistant") -> DataFrame:
    """Calls that a result follows in the next turn."""
    r = messages.where(F.col("role") == result).select(F.col("conv_id").alias("rc"), (F.col("turn") - 1).alias("rt"))
    return messages.where(F.col("role") == call).join(r, (F.col("conv_id") == F.col("rc")) & (F.col("turn") == F.col("rt")), "left_semi")


def unanswered(messages: DataFrame, question: str = "user", answer: str = "assistant") -> DataFrame:
    """Questions that no later turn answers."""
    last = messages.where(F.col("role") == answer).groupBy("conv_id").agg(F.max("turn").alias("last"))
    return messages.where(F.col("role") == question).join(last, "conv_id", "left").where("last is null or turn > last").drop("last")


def feedback_stats(records: DataFrame) -> DataFrame:
    """Counts by action and by risk name, two groupings of one pass; (dimension, value, n)."""
    df = records.select(F.coalesce("user_action", F.lit("unknown")).alias("a"), F.coalesce("risk_name", F.lit("unknown")).alias("r"))
    df = df.groupingSets([["a"], ["r"]], "a", "r").agg(F.count("*").alias("n"), F.grouping("a").alias("g"))
    return df.select(F.when(F.col("g") == 0, "action").otherwise("risk").alias("dimension"), F.coalesce("a", "r").alias("value"), "n")


def false_positive_rate(records: DataFrame, action: str = "false_positive") -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.coalesce(F.avg((F.col("user_action") == action).cast("double")), F.lit(0.0)).alias("fp_rate"))


def recent_by_risk(records: DataFrame, name: str, n: int) -> DataFrame:
    """The last n records whose risk name equals or contains the name."""
    return records.where(F.contains(F.coalesce("risk_name", F.lit("")), F.lit(name))).orderBy(F.desc("ord")).limit(n)


def freshness(items: DataFrame, as_of: str, warn_days: int = 180, critical_days: int = 365) -> DataFrame:
    """items (item_type, name, status, last_verified) with days and severity; a date that cannot be read gives no days."""
    days = F.datediff(F.lit(as_of).cast("date"), F.try_to_date("last_verified", "yyyy-MM-dd"))
    severity = F.when((F.col("status") == "repealed") | (days > critical_days), "critical").when(days > warn_days, "warning")
    return items.withColumns({"days": days.cast("long"), "severity": severity})


def freshness_report(checked: DataFrame, critical_days: int = 365) -> DataFrame:
    n, outdated, bad = F.count("*"), F.count_if(F.col("days") > critical_days), F.count_if(F.col("severity") == "critical")
    status = F.when(bad > 0, "critical").when(outdated > 0.3 * n, "needs_review").otherwise("healthy")
    return checked.agg(
        n.alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "amended", "repealed")], outdated.alias("outdated"), status.alias("overall")
    )


def freshness_status(critical, outdated, total):
    return F.when(critical > 0, "critical").when(outdated > 0.3 * total, "needs_review").otherwise("healthy")


def freshness_warnings(items: DataFrame, as_of: str, warn_days: int = 180, critical_days: int = 365) -> DataFrame:
    """(ord, place, item_type, name, status, message, severity, old): every warning on items (ord, item_type, name, status, last_verified, repealed_by).

    Provisions warn by age in two steps, and where they are repealed or amended;
    cases by age past the second step. old marks a warning past that step. An
    item without a date that can be read has no age.
    """
    days = F.datediff(F.lit(as_of).cast("date"), F.try_to_date("last_verified", "yyyy-MM-dd"))
    law = F.col("item_type") == "provision"
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    row = lambda place, message, severity, old=False: F.struct(F.lit(place).alias("place"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(old).alias("old"))
    by = F.when(F.length("repealed_by") > 0, say("（被", F.col("repealed_by"), "取代）")).otherwise(F.lit(""))
    found = F.array(
        F.when(law & (days > critical_days), row(0, say("该法条已 ", days, f" 天未验证（超过 {critical_days} 天），建议核实是否仍然有效"), "critical", True)),
        F.when(law & (days > warn_days) & (days <= critical_days), row(0, say("该法条已 ", days, " 天未验证，建议核实最新状态"), "warning")),
        F.when(law & (F.col("status") == "repealed"), row(1, say("该法条已废止", by), "critical")),
        F.when(law & (F.col("status") == "amended"), row(2, say("该法条已修订，请使用最新版本"), "warning")),
        F.when(~law & (days > critical_days), row(3, say("该案例已 ", days, " 天未验证，裁判规则可能已变化"), "critical", True)),
    )
    rows = items.select("ord", "item_type", "name", "status", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return rows.select("ord", "x.place", "item_type", "name", "status", "x.message", "x.severity", "x.old")


def call_costs(calls: DataFrame) -> DataFrame:
    """Totals and cost by model of calls (model, prompt_tokens, completion_tokens)."""
    price = lambda i: _price(i)
    cost = F.col("prompt_tokens") / 1e6 * price(0) + F.col("completion_tokens") / 1e6 * price(1)
    return calls.groupBy("model").agg(F.count("*").alias("n_calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.sum(cost).alias("cost"))


def _price(i: int):
    out = F.lit(DEFAULT_PRICE[i])
    for model, p in PRICES.items():
        out = F.when(F.lower("model") == model, F.lit(p[i])).otherwise(out)
    return out


def stage_shares(stages: DataFrame) -> DataFrame:
    """Time by stage and its share of all, in percent."""
    sums = stages.groupBy("stage").agg(F.sum("duration_ms").alias("ms"))
    total = sums.agg(F.sum("ms").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("stage", "ms", F.when(F.col("total") > 0, 100 * F.col("ms") / F.col("total")).otherwise(0.0).alias("pct"))
