"""Quality rules: multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. For every language and
source a robust centre and scatter are estimated: the ``SHARE`` of the rows
whose covariance, with the floors of ``VECTOR`` on its diagonal, has the least
determinant. Concentration steps (take the rows with the least Mahalanobis
distances, recompute mean and covariance, repeat) go from three fixed starts;
after ``TRIALS`` steps the start with the least determinant goes on until its
determinant no longer falls. Rows far from the centre are rejected. Everything
is DataFrame expressions: the Cholesky factor, whose diagonal gives the
determinant, and the forward substitution are columns, the subset is a quantile
per group.

Floors and cutoff follow from the distances that are no reason to reject, not
from labels: a floor is the deviation of a statistic that texts of one source
may show without being bad (a factor of e**0.8 = 2.2 in words, say), so that a
source whose texts are all alike does not reject the first that differs, and
the cutoff is met by chance by one in a million of normal vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

SHARE = 0.75  # of a group's rows that a concentration step keeps
TRIALS = 2  # concentration steps of every start
MOST_STEPS = 20  # of the best start; determinants never rise, so a stop leaves the least found
FALL = 1e-6  # of the logarithm of a determinant that counts as a fall
STARTS = 3
SMALL = 10_000  # groups whose estimates are broadcast; more are joined by shuffle
LEAST_ROWS = 60  # a smaller group is pooled with its language, then with all
#: statistic, and the standard deviation that is added to its own (squared): differences below it are no reason to reject.
#: A share reaches log1p(100) = 4.6; from its usual value that is beyond CUTOFF for symbols, lines and upper case alone.
#: Repeated words reject alone by the base rules.
VECTOR = {"v_words": 0.8, "v_length": 0.15, "v_symbols": 0.4, "v_lines": 0.7, "v_repeats": 0.8, "v_upper": 0.5}
MEDIAN_CHI2 = 5.348  # of six degrees of freedom
CUTOFF = 38.3  # chi-squared of six degrees of freedom at 0.999999


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (columns kept) with a struct column ``stats``.

    A null text counts as empty: no words, all counts zero.
    """
    keep = [F.struct("*").alias("row")]
    body = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        *keep,
        body.alias("body"),
        F.filter(F.split(body, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    # words are hashed once; a window's hash is that of its words' hashes
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("hashes"), i + k)
    windows = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    )
    df = df.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("body") - F.length(F.translate("body", UPPER, ""))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # only texts with a repeated window sort their windows to find where it is
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("placed", placed).drop("windows")
    s = F.col("placed")
    twice = F.transform(
        s, lambda e, k: F.when((F.get(s, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(e["h"])), e["i"])
    )
    df = df.withColumn("places", F.sort_array(F.filter(twice, lambda x: x.isNotNull()))).drop("placed")
    p = F.col("places")
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda x, g: x + g), F.lit(0))
    df = df.withColumn("n_repeat_words", F.when(p.isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("places")
    return df.select("row", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper").alias("stats"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def vector(s: Column) -> dict[str, Column]:
    """The transformed statistics of a text with words."""
    words = F.greatest(s["n_words"], F.lit(1))
    return {
        "v_words": F.log1p(s["n_words"].cast("double")),
        "v_length": F.log(F.greatest(s["word_chars"], F.lit(1)) / words),
        "v_symbols": F.log1p(100.0 * s["n_symbols"] / words),
        "v_lines": F.log1p(100.0 * s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))),
        "v_repeats": F.log1p(100.0 * s["n_repeat_words"] / words),
        "v_upper": F.log1p(100.0 * s["n_upper"] / F.greatest(s["word_chars"], F.lit(1))),
    }


NAMES = list(VECTOR)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _factored(df: DataFrame, cov: dict[tuple[int, int], Column], keep: list[str]) -> DataFrame:
    """keep, log_det, centre m_i and Cholesky factor l_i_j, worked out column by column."""
    for j in range(len(NAMES)):
        rest = {i: cov[i, j] for i in range(j, len(NAMES))}
        for i in rest:
            for k in range(j):
                rest[i] = rest[i] - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest[j], F.lit(1e-12))))
        if j + 1 < len(NAMES):
            df = df.withColumns({f"l_{i}_{j}": rest[i] / F.col(f"l_{j}_{j}") for i in rest if i > j})
    log_det = sum((2 * F.log(f"l_{i}_{i}") for i in range(1, len(NAMES))), 2 * F.log("l_0_0"))
    return df.select(*keep, log_det.alias("log_det"), *[f"m_{i}" for i in range(len(NAMES))], *[f"l_{i}_{j}" for i, j in PAIRS])


def _distanced(df: DataFrame) -> DataFrame:
    """df, with vector and a group's centre and factor, and the squared distance d2."""
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        df = df.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(NAMES))), F.col("z_0") * F.col("z_0"))
    return df.withColumn("d2", d2).drop(*[f"z_{i}" for i in range(len(NAMES))])


def _pools(rows: DataFrame) -> DataFrame:
    """(lang, source, pool): the rows whose estimate serves those of a language and source."""
    from pyspark.sql import Window

    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = F.sum("n").over(Window.partitionBy("lang"))
    # null languages and sources have names of their own
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return n.select(
        F.col("lang").alias("p_lang"),
        F.col("source").alias("p_source"),
        F.when(F.col("n") >= LEAST_ROWS, F.concat(name("lang"), F.lit("\t"), name("source")))
        .when(by_lang >= LEAST_ROWS, name("lang"))
        .otherwise(F.lit("*"))
        .alias("pool"),
    )


class _Pools:
    """The pools with their checked number, which decides how their rows are joined."""

    def __init__(self, rows: DataFrame, tag: str):
        self.table = written(_pools(rows), f"{tag}-pools")
        self.count = self.table.count()

    def near(self, small: DataFrame) -> DataFrame:
        """A table with a row for each pool or group, sent to all workers if it is small."""
        return F.broadcast(small) if self.count <= SMALL else small

    def kept(self, state: DataFrame, name: str) -> DataFrame:
        """Written in files of up to SMALL rows."""
        return written(state.repartition(-(-max(1, self.count) // SMALL), "pool"), name)


def _pooled(rows: DataFrame, pools: _Pools) -> DataFrame:
    same = F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source"))
    return rows.join(pools.near(pools.table), same, "left").drop("p_lang", "p_source")


def _starts(rows: DataFrame, pools: _Pools, floors: list[float], tag: str) -> DataFrame:
    """Three starts (pool, start, log_det, centre, factor) for each pool.

    0: medians, and quartile ranges without correlations. 1: medians, with the
    correlations of tanh of the standardised values, which outliers hardly
    move. 2: mean and covariance of all rows.
    """
    size = range(len(NAMES))
    quartiles = rows.groupBy("pool").agg(*[F.percentile_approx(n, [0.25, 0.5, 0.75], 2000).alias(f"q_{i}") for i, n in enumerate(NAMES)])
    spread = lambda i: F.sqrt(((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349) ** 2 + floors[i])
    middle = quartiles.select("pool", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in size], *[spread(i).alias(f"s_{i}") for i in size])
    middle = pools.kept(middle, f"{tag}-middle")
    near = rows.join(pools.near(middle), "pool")
    off = [F.col(n) - F.col(f"m_{i}") for i, n in enumerate(NAMES)]
    bent = [F.tanh(off[i] / F.col(f"s_{i}")) for i in size]
    sums = near.groupBy("pool").agg(
        *[F.avg(off[i]).alias(f"a_{i}") for i in size], *[F.avg(off[i] * off[j]).alias(f"b_{i}_{j}") for i, j in PAIRS],
        *[F.avg(bent[i]).alias(f"c_{i}") for i in size], *[F.avg(bent[i] * bent[j]).alias(f"d_{i}_{j}") for i, j in PAIRS],
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in size], *[F.first(f"s_{i}").alias(f"s_{i}") for i in size],
    )
    sums = pools.kept(sums, f"{tag}-sums")
    var = lambda i, j: F.col(f"d_{i}_{j}") - F.col(f"c_{i}") * F.col(f"c_{j}")
    # 0.99: a correlation matrix of values that hardly vary stays positive
    likeness = lambda i, j: 0.99 * var(i, j) / F.sqrt(F.greatest(var(i, i) * var(j, j), F.lit(1e-12)))
    covs = [
        {(i, j): F.col(f"s_{i}") ** 2 if i == j else F.lit(0.0) for i, j in PAIRS},
        {(i, j): F.col(f"s_{i}") * F.col(f"s_{j}") * (F.lit(1.0) if i == j else likeness(i, j)) for i, j in PAIRS},
        {(i, j): F.col(f"b_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}") + (floors[i] if i == j else 0.0) for i, j in PAIRS},
    ]
    out = None
    for k, cov in enumerate(covs):
        one = _factored(sums.withColumn("start", F.lit(k)), cov, ["pool", "start"])
        if k == 2:
            one = one.join(sums.select(F.col("pool").alias("s_pool"), *[(F.col(f"m_{i}") + F.col(f"a_{i}")).alias(f"n_{i}") for i in size]), F.col("pool") == F.col("s_pool"))
            one = one.select("pool", "start", "log_det", *[F.col(f"n_{i}").alias(f"m_{i}") for i in size], *[f"l_{i}_{j}" for i, j in PAIRS])
        out = one if out is None else out.unionByName(one)
    return pools.kept(out, f"{tag}-starts")


def _concentrated(rows: DataFrame, state: DataFrame, pools: _Pools, floors: list[float], name: str) -> DataFrame:
    """The state after a concentration step of each (pool, start) in it."""
    size = range(len(NAMES))
    near = _distanced(rows.join(pools.near(state), "pool"))
    cut = near.groupBy("pool", "start").agg(F.percentile_approx("d2", SHARE, 2000).alias("cut")).toDF("c_pool", "c_start", "cut")
    subset = near.join(pools.near(cut), (F.col("pool") == F.col("c_pool")) & (F.col("start") == F.col("c_start"))).where("d2 <= cut")
    moved = [F.col(n) - F.col(f"m_{i}") for i, n in enumerate(NAMES)]  # sums about the last centre lose no digits
    sums = subset.groupBy("pool", "start").agg(
        *[F.avg(moved[i]).alias(f"a_{i}") for i in size], *[F.avg(moved[i] * moved[j]).alias(f"b_{i}_{j}") for i, j in PAIRS],
        *[F.first(f"m_{i}").alias(f"o_{i}") for i in size],
    )
    centred = sums.select(
        "pool", "start",
        *[(F.col(f"o_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in size],
        *[(F.col(f"b_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")).alias(f"b_{i}_{j}") for i, j in PAIRS],
    )
    cov = {(i, j): F.col(f"b_{i}_{j}") + (floors[i] if i == j else 0.0) for i, j in PAIRS}
    return pools.kept(_factored(centred, cov, ["pool", "start"]), name)


def estimate(rows: DataFrame, tag: str) -> tuple[_Pools, DataFrame]:
    """(pools, (pool, centre, factor, scale)) from rows (lang, source, vector).

    rows are a written table: each concentration step reads it twice. Pools whose
    determinant has stopped falling take no part in further steps. The
    tables that come back have a row for each language and source.
    """
    pools = _Pools(rows, tag)
    rows = _pooled(rows, pools)
    floors = [VECTOR[n] ** 2 for n in NAMES]
    state = _starts(rows, pools, floors, tag)
    for step in range(TRIALS):
        state = _concentrated(rows, state, pools, floors, f"{tag}-trial{step}")
    order = F.struct("log_det", "start")
    state = state.groupBy("pool").agg(F.min_by(F.struct(*[c for c in state.columns if c != "pool"]), order).alias("best")).select("pool", "best.*")
    state = pools.kept(state, f"{tag}-best")
    moving = state
    for step in range(MOST_STEPS):
        new = _concentrated(rows, moving, pools, floors, f"{tag}-step{step}")
        old = state.select(F.col("pool").alias("o_pool"), F.col("log_det").alias("o_det"))
        moving = pools.kept(new.join(old, F.col("pool") == F.col("o_pool")).where(F.col("log_det") < F.col("o_det") - FALL).drop("o_pool", "o_det"), f"{tag}-moving{step}")
        if moving.isEmpty():
            break
        still = state.join(moving.select(F.col("pool").alias("n_pool")), F.col("pool") == F.col("n_pool"), "left_anti")
        state = pools.kept(still.unionByName(moving), f"{tag}-state{step}")
    state = state.drop("start", "log_det")
    middle = _distanced(rows.join(pools.near(state), "pool")).groupBy("pool").agg(F.percentile_approx("d2", 0.5, 2000).alias("middle"))
    # distances shrink where a group is wider than its subset says, and never grow
    scaled = state.join(middle, "pool").withColumn("scale", F.least(F.lit(1.0), MEDIAN_CHI2 / F.greatest("middle", F.lit(1e-9)))).drop("middle")
    return pools, pools.kept(scaled, f"{tag}-final")


def _judged(rows: DataFrame, pools: _Pools, state: DataFrame) -> DataFrame:
    """rows with d2 (null where base_failed) and kept."""
    near = _distanced(_pooled(rows, pools).join(pools.near(state), "pool", "left"))
    near = near.withColumn("d2", F.when(~F.col("base_failed"), F.col("d2") * F.col("scale")))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return near.withColumn("kept", kept).drop("pool", "scale", *[f"m_{i}" for i in range(len(NAMES))], *[f"l_{i}_{j}" for i, j in PAIRS])


def _vectors(docs: DataFrame, text_col: str) -> DataFrame:
    df = statistics(docs, text_col)
    s = F.col("stats")
    return df.select(
        "row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), "stats", base_failed(s["n_words"], s["n_repeat_words"]).alias("base_failed"), *[c.alias(n) for n, c in vector(s).items()]
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "quality") -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, d2, kept) of every row.

    Estimates use the rows that pass the base rules. Null languages and sources
    are groups of their own; groups of fewer than ``LEAST_ROWS`` rows are
    pooled. Texts that fail the base rules get no distance. Repeated rows get
    equal verdicts, ties at the cutoff stay, an empty table gives no rows.
    """
    rows = _vectors(docs, text_col).select(F.col(f"row.{id_col}").alias("doc_id"), "lang", "source", "stats.*", "base_failed", *NAMES)
    rows = written(rows, f"{tag}-stats")
    pools, state = estimate(rows.where("not base_failed").select("lang", "source", *NAMES), tag)
    return _judged(rows, pools, state)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "quality") -> DataFrame:
    """The rows of docs that are kept, with docs' columns; no row is moved.

    The rows are written once beside their statistics: no text crosses a
    shuffle, and the verdict is the row's own even where ids repeat. Null and
    empty texts fail the base rules and go; null languages and sources are
    groups of their own; ties at the cutoff stay; an empty table gives no rows.
    """
    rows = _vectors(docs, text_col).drop("stats")
    rows = written(rows, f"{tag}-stats")
    pools, state = estimate(rows.where("not base_failed").select("lang", "source", *NAMES), tag)
    return _judged(rows, pools, state).where("kept").select("row.*")
