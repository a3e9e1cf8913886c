import random

from pyspark.sql import functions as F

from lexspan.functions.text import running
from lexspan.operators import segment


def brute(text, header):
    """Line by line, as one would by hand."""
    out, title, body, at, begun = [], None, [], 0, False
    lines = (text or "").split("\n")
    heads = any(header(x.strip()) for x in lines)

    def close():
        full = [(a, x) for a, x in body if x.strip()]
        if full:
            s, e = full[0][0] + len(full[0][1]) - len(full[0][1].lstrip()), full[-1][0] + len(full[-1][1].rstrip())
            out.append((len(out) + 1, title, "\n".join(x.strip() for _, x in body).strip(), s, e))

    for x in lines:
        if header(x.strip()):
            if begun:
                close()
            title, body, begun = x.strip(), [], True
        elif begun or not heads:
            body.append((at, x))
        at += len(x) + 1
    close()
    return out


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 17, 100, 1001)]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "x array<int>")
    assert [r[0] for r in df.select(running(F.col("x"))).collect()] == [*[[sum(x[:i]) for i in range(len(x))] for x in rows], None]


def test_clauses_and_their_places(spark):
    rng = random.Random(9)
    pool = ["第一条 总则", "第二条", "  2. 付款方式", "Article IV Terms", "争议解决", "body text", "  indented é😀 ", "", "   ", "x", "\tend\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", " \n ", "第一条\nbody\n" * 3000]
    header = lambda x: x in ("第一条 总则", "第二条", "2. 付款方式", "Article IV Terms", "争议解决", "第一条")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lines": F.lit("clash"), "at": F.lit(1)})
    found = segment.clauses(df)
    got = {}
    for r in found.orderBy("doc_id", "clause_id").collect():
        got.setdefault(r["doc_id"], []).append((r["clause_id"], r["title"], r["content"], r["start_pos"], r["end_pos"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute(t, header), i
        for _, _, content, s, e in got.get(i, []):
            assert "\n".join(x.strip() for x in t[s:e].split("\n")) == content
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_given_documents_hold_their_clauses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = segment.clauses(docs, [r"^Licensed under", r"^[A-Z][a-z]+\.$"], []).join(docs.select("doc_id", "text"), "doc_id")
    own = F.expr("substring(text, cast(start_pos as int) + 1, cast(end_pos - start_pos as int))")
    assert found.where(own != F.col("content")).where(~F.col("text").rlike(r"[ \t]\n|\n[ \t]")).isEmpty() and not found.isEmpty()
