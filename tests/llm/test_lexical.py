import math
import random
import re

import duckdb
import pytest

from lexspan.llm import lexical, queries
from tests.llm.conftest import ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best):
    docs = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in docs) + 1))) for t in own}
        found = []
        for i, d in docs:
            score = 0
            for t in own:
                if tf := d.count(t):
                    score += weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(d) * n_docs) // n_terms)))
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:best])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    for text in ["", "A-b_c 1x2 É日本 x y Z{}~\x7f\x80", "ẞ İ"]:
        assert [t.decode() for t in lexical.terms(text.encode())] == terms(text)


def test_rows_as_given(spark, docs, none):
    items = [(1, "alpha Beta x long"), (2, None), (None, "É😀"), (3, "ünï zz"), (3, "alpha"), (4, "theta theta x"), (5, "nowhere")]
    asked = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    want = brute(ROWS, items, 3)
    assert want and rows(lexical.search(docs, asked, best=3)) == want
    assert rows(lexical.search(docs, asked, best=3, block_bytes=8)) == want
    assert rows(lexical.search(none, asked)) == []
    assert rows(lexical.search(docs, asked.limit(0))) == []


@pytest.mark.parametrize("width,terms_", [(8, 10**9), (4096, 40)])
def test_windows_and_ties(spark, monkeypatch, width, terms_):
    """Small windows, closed by either bound; few different texts, so that scores tie over windows and tasks."""
    monkeypatch.setattr(lexical, "WIDTH", width)
    monkeypatch.setattr(lexical, "WINDOW_TERMS", terms_)
    rng = random.Random(5)
    docs = [(rng.randrange(400), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(6)))) for _ in range(600)]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(4))) for i in range(12)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), best=20)
    assert rows(got) == brute(docs, items, 20)


def test_registered_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = duck.execute(queries.ORACLE_SQL["op12_lexical_search"])
    assert [d[0] for d in cur.description] == ["item_id", "rank", "doc_id", "score"]
    want = sorted(cur.fetchall(), key=str)
    assert len(want) > 100 and rows(queries.QUERIES["op12_lexical_search"](spark, sf)) == want
