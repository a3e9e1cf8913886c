"""Personal data: base patterns and bootstrapped contextual extraction, in SQL functions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers. Those are the seeds. Every identifier-like token, seed or not, is an
instance; the words beside it are lexical patterns. Pattern and instance form a
graph whose two sides score each other in turn: a pattern's confidence in a
kind is the share of its instances that are of the kind, an instance's score
the chance that any of its confident patterns is right. Tokens with a high
score in a confident context are added as identifiers of that kind.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import written

#: Possessive forms of the base expressions: their loops have nothing after them to give back for. \\G and the look-behind
#: start a match only where a run starts or the last match ended, so long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: what may be an identifier: a token with an @ or at least five digits, without punctuation at its end. It starts where a run
#: of these characters starts, so each run is read once whether it matches or not; punctuation before it is taken off later.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+/@:-])[._%+/@:-]*+(?=(?:[A-Za-z._%+/@:-]*+[0-9]){5}|[A-Za-z0-9._%+/:-]*+@)"
    r"[A-Za-z0-9]++(?:[._%+/@:-]++[A-Za-z0-9]++)*+"
)
LEAD = r"^[._%+/@:-]++"

ROUNDS = 3
BLOCK = 32  # matches of a text whose places are worked out together
CONFIDENT = 0.6  # of a pattern in a kind
SEEDS = 3  # distinct seed instances that a pattern needs
ACCEPT = 0.8  # score of an instance
SALTS = 16  # over which the rows of one value or pattern are dealt in joins


def _matches(body: Column, pattern: str, hint: Column) -> Column:
    """All matches where the hint holds, else null."""
    return F.when(hint, F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, also where lambdas read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """items cut into arrays of BLOCK."""
    return _let(items, lambda xs: F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK))))


def _running(items: Column, value, merge, levels: int = 2) -> Column:
    """For each item the merged values (ints, from 0) of those before it.

    An aggregate copies what it carries at every step, so it carries a number
    only: blocks are folded first, their totals in blocks again, then items
    inside their block.
    """
    fold = lambda xs, of: F.aggregate(xs, F.lit(0), lambda a, x: merge(a, of(x)))
    same = lambda x: x
    before = lambda xs: F.transform(xs, lambda x, i: fold(F.slice(xs, 1, i), value))
    if not levels:
        return _let(items, before)

    def whole(blocks):
        bases = _running(F.transform(blocks, lambda xs: fold(xs, value)), same, merge, levels - 1)
        return F.flatten(F.zip_with(blocks, bases, lambda xs, base: F.transform(before(xs), lambda x: merge(base, x))))

    return _let(_blocks(items), whole)


def _spans(body: Column, pattern: str, found: Column) -> Column:
    """array<struct<s, e, v, left, right>> of the matches found, in code points, end exclusive, with the text on either side; null without one.

    The pieces between matches alternate with them, so lengths give places and
    neighbours give contexts. found is a column of its own, so that no text is
    searched twice.
    """

    def items(p):
        piece, match = (lambda i, k=k: F.coalesce(F.get(p[k], i), F.lit("")) for k in "gv")
        before = lambda i: F.right(piece(i), F.lit(80))
        after = lambda i: F.left(piece(i), F.lit(40))
        return F.transform(F.sequence(F.lit(0), F.size(p["v"]) - 1), lambda i: F.struct(
            F.length(piece(i)).alias("gap"), match(i).alias("v"),
            F.right(F.concat(before(i - 2), match(i - 2), before(i - 1), match(i - 1), before(i)), F.lit(80)).alias("left"),
            F.left(F.concat(after(i + 1), match(i + 1), after(i + 2)), F.lit(40)).alias("right"),
        ))

    def placed(xs):
        begin = _running(xs, lambda x: x["gap"] + F.length(x["v"]), lambda a, b: a + b)
        whole = lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + F.length(x["v"])).alias("e"), *[x[k].alias(k) for k in ("v", "left", "right")])
        return F.zip_with(xs, begin, whole)

    pieces = F.struct(F.split(body, pattern, -1).alias("g"), found.alias("v"))
    return F.when(F.size(found) > 0, _let(_let(pieces, items), placed))


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_NONE = "array<struct<s:int,e:int,v:string,left:string,right:string>>"


def _hint(body: Column, kind: str) -> Column:
    """A cheap test that every text with a valid match passes."""
    return {
        "email": F.contains(body, F.lit("@")),
        "phone": F.contains(body, F.lit("+")),
        "ip": body.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": body.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    }[kind]


def _labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def _text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined, of array<struct<s, k, e>>."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def _context(spans: Column, kind: str | None) -> Column:
    """Occurrences: value, kind, place and the text on either side."""
    fields = lambda x: [x[k].alias(k) for k in ("s", "e", "left", "right")]
    return F.transform(spans, lambda x: F.struct(F.lower(x["v"]).alias("v"), F.lit(kind).cast("string").alias("kind"), *fields(x)))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; spans are in order and apart from each other.

    Both are put in order of their starts. A span goes if an other that began
    before it reaches into it, or if the next event is an other inside it.
    """
    fields = lambda x: [x[k].alias(k) for k in ("v", "left", "right")]
    blank = [F.lit("").alias(k) for k in ("v", "left", "right")]
    event = lambda xs, mine: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(mine).alias("mine"), x["e"].alias("e"), *(fields(x) if mine else blank)))

    def free(events):
        reach = _running(events, lambda x: F.when(x["mine"] == 0, x["e"]).otherwise(0), F.greatest)

        def stays(x, i, reach):
            after = F.get(events, i + 1)
            return (x["mine"] == 1) & (F.get(reach, i) <= x["s"]) & F.coalesce((after["mine"] == 1) | (after["s"] >= x["e"]), F.lit(True))

        return _let(reach, lambda r: F.filter(events, lambda x, i: stays(x, i, r)))

    left = F.transform(_let(F.sort_array(F.concat(event(spans, 1), event(others, 0))), free), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), *fields(x)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), left).otherwise(spans)


def _trimmed(spans: Column) -> Column:
    """Spans without the punctuation at their start, which goes to the text on their left."""

    def one(x, v):
        lead = F.length(x["v"]) - F.length(v)
        left = F.right(F.concat(x["left"], F.left(x["v"], lead)), F.lit(80))
        return F.struct((x["s"] + lead).alias("s"), x["e"].alias("e"), v.alias("v"), left.alias("left"), x["right"].alias("right"))

    return F.transform(spans, lambda x: F.when(x["v"].rlike(LEAD), one(x, F.regexp_replace(x["v"], LEAD, ""))).otherwise(x))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "pii") -> DataFrame:
    """Written: row, doc_id, base spans by kind and occurrences (seeds and candidates with contexts)."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("some", F.col("body").rlike("[0-9@]"))
    b, some = F.col("body"), F.col("some")
    df = df.select(
        "doc_id", "body", *[_matches(b, PATTERNS[k], some & _hint(b, k)).alias(f"f_{k}") for k in KINDS], _matches(b, CANDIDATE, some).alias("f_other")
    )
    df = df.select("doc_id", "body", *[_spans(b, p, F.col(f"f_{k}")).alias(f"s_{k}") for k, p in (PATTERNS | {"other": CANDIDATE}).items()])
    none = F.array().cast(_NONE)
    valid = lambda k: F.filter(F.col(f"s_{k}"), lambda x: _valid(k, x["v"]))
    df = df.select("doc_id", *[F.coalesce(valid(k), none).alias(k) for k in KINDS], F.coalesce(_trimmed(F.col("s_other")), none).alias("s_other"))
    base = F.concat(*[F.col(k) for k in KINDS])
    df = df.withColumn("other", _apart(F.col("s_other"), base)).drop("s_other")
    seen = F.concat(*[_context(F.col(k), k) for k in KINDS], _context(F.col("other"), None))
    spans = F.concat(*[_labelled(F.col(k), k) for k in KINDS])
    df = df.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], spans.alias("spans"), seen.alias("seen")
    )
    return written(df, f"{tag}-scan")


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of a context: one and two words before, and one on either side; words in lower case, digits as 0.

    A context is the 80 characters before a span and the 40 after it; of a
    longer word the part inside them counts.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]+", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    before = F.slice(F.concat(F.array(F.lit("<"), F.lit("<")), words(left)), -2, 2)
    # a side that touches the span without a blank is part of the pattern too
    after = F.coalesce(F.get(words(right), F.lit(0)), F.lit(">"))
    one, two = F.get(before, F.lit(1)), F.concat_ws(" ", F.get(before, F.lit(0)), F.get(before, F.lit(1)))
    return F.array(F.concat(F.lit("L1 "), one), F.concat(F.lit("L2 "), two), F.concat(F.lit("B "), one, F.lit(" _ "), after))


def _dealt(rows: DataFrame, table: DataFrame, on: Column, spread: Column) -> DataFrame:
    """rows joined with a small table, whose rows go to SALTS places each, so that no task gets all rows of a key."""
    table = table.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return rows.join(table, on & (F.col("__salt") == F.col("__place"))).drop("__salt", "__place")


def discover(scanned: DataFrame, tag: str = "pii") -> DataFrame | None:
    """(row, s, e, k) of the added identifiers, or None if no pattern ever is confident."""
    seen = scanned.select("row", F.explode("seen").alias("o")).select("row", "o.*")
    seen = written(seen.select("row", "v", "kind", "s", "e", F.explode(F.array_distinct(_patterns(F.col("left"), F.col("right")))).alias("p")), f"{tag}-seen")
    # an instance is a seed if it is one anywhere; equal strings are one instance of a pattern
    graph = seen.groupBy("p", "v").agg(F.max("kind").alias("seed"))
    graph = written(graph, f"{tag}-graph")
    degree = graph.groupBy("p").agg(F.count("*").alias("n"))
    seeds = graph.where("seed is not null").select("v", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, sure = seeds, None
    for r in range(ROUNDS):
        links = graph.join(scores.withColumnRenamed("v", "sv"), F.col("v") == F.col("sv")).groupBy("p", "kind").agg(
            F.sum("score").alias("mass"), F.count(F.when(F.col("score") >= ACCEPT, 1)).alias("support")
        )
        sure = links.where(F.col("support") >= SEEDS).join(degree.withColumnRenamed("p", "dp"), F.col("p") == F.col("dp"))
        sure = sure.select("p", "kind", (F.col("mass") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
        sure = written(sure, f"{tag}-sure{r}")
        if sure.isEmpty():
            return None
        new = _dealt(graph.where("seed is null"), sure.withColumnRenamed("p", "cp"), F.col("p") == F.col("cp"), F.xxhash64("v")).groupBy("v", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score")
        )
        scores = written(seeds.unionByName(new), f"{tag}-scores{r}")
    high = scores.where(F.col("score") >= ACCEPT).select(F.col("v").alias("hv"), F.col("kind").alias("hk"), "score")
    # most scores are the seeds' own; only values that occur outside base spans are told to the copies of the join
    loose = seen.where("kind is null").select(F.col("v").alias("loose")).distinct()
    high = written(high.join(loose, F.col("hv") == F.col("loose"), "left_semi"), f"{tag}-high")
    found = _dealt(seen.where("kind is null"), high, F.col("v") == F.col("hv"), F.xxhash64("row", "s"))
    sure = sure.select(F.col("p").alias("cp"), F.col("kind").alias("ck"), "confidence")
    added = _dealt(found, sure, (F.col("p") == F.col("cp")) & (F.col("hk") == F.col("ck")), F.xxhash64("row", "s"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return added.groupBy("row", "s", "e").agg(F.max_by("hk", F.struct("score", "confidence", "hk")).alias("kind")).select(
        "row", "s", "e", (F.array_position(names, F.col("kind")) - 1).cast("int").alias("k")
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "pii") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    Counts and the hash are of the base spans; spans has the added ones too,
    which overlap no base span. A null text is empty; long texts cost in
    proportion to their length and identifiers. Repeated rows get the same result each, an empty table
    no rows; other columns are not read.
    """
    scanned = scan(docs, id_col, text_col, tag)
    added = discover(scanned, tag)
    base = scanned.drop("seen").withColumn("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    if added is not None:
        more = added.groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("found")).withColumnRenamed("row", "r")
        base = base.join(more, F.col("row") == F.col("r"), "left").withColumn("more", F.coalesce("found", "more"))
    return base.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_text(F.col("spans")), 256).alias("base_sha256"),
        _text(F.concat("spans", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"),
    )
