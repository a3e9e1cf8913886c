import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


@pytest.fixture
def tagged(docs):
    return docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_words": F.lit("clash")})


def test_counts_against_brute_force(spark, tagged, real):
    extra = ["a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x x", "l\nl\n\n \nl\r\nl", "#*$%&|<> a\x0bb\x0cc\x85d e", "a b c d e " * 3 + "q r s a b c d e"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for df in (tagged, real, more):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect())
        assert got == sorted((str(r.doc_id), *brute_counts(r.text)) for r in df.select("doc_id", "text").collect())


def brute_mcd(x):
    """The same estimate in numpy, with a quantile in place of Spark's percentile_approx: (distances, log determinant by start)."""
    x = np.asarray(x)
    floor = np.diag([v**2 for v in quality.VECTOR.values()])
    at = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    d2 = lambda m, cov: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    log_det = lambda cov: np.linalg.slogdet(cov)[1]

    def step(m, cov):
        d = d2(m, cov)
        sub = x[d <= at(d, quality.SHARE)]
        return sub.mean(0), np.cov(sub.T, bias=True) + floor

    middle = np.array([at(c, 0.5) for c in x.T])
    s = np.sqrt([((at(c, 0.75) - at(c, 0.25)) / 1.349) ** 2 + f for c, f in zip(x.T, np.diag(floor))])
    bent = np.cov(np.tanh((x - middle) / s).T, bias=True)
    alike = 0.99 * bent / np.sqrt(np.maximum(np.outer(np.diag(bent), np.diag(bent)), 1e-12))
    np.fill_diagonal(alike, 1)
    starts = [(middle, np.diag(s**2)), (middle, np.outer(s, s) * alike), (x.mean(0), np.cov(x.T, bias=True) + floor)]
    for _ in range(quality.TRIALS):
        starts = [step(*c) for c in starts]
    found = [log_det(c[1]) for c in starts]
    best = starts[int(np.argmin(np.round(found, 9)))]
    while log_det((new := step(*best))[1]) < log_det(best[1]) - quality.FALL:
        best = new
    d = d2(*best)
    return d * min(1, quality.MEDIAN_CHI2 / at(d, 0.5)), found, log_det(best[1])


def test_the_least_determinant_is_kept():
    """On a group of two clouds the starts end apart, and the kept one is no worse than any of them."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 6)), rng.normal(4, 0.3, (140, 6))])
    _, found, least = brute_mcd(x)
    assert max(found) > min(found) + 0.1 and least <= min(found)


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        n = int(rng.lognormal(4, 0.6)) + 10
        w = list(rng.choice(words, n))
        if i % 20 == 0:
            w = [x.upper() + "###$$$" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "a"))
    rows += [(1000 + i, "only few rows here in this small group of ours really", "fr", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality.judge(df).collect()
    vectors = {r.doc_id: r for r in quality._vectors(df, "text").select("row.doc_id", "base_failed", *quality.NAMES).collect()}
    for lang in ("en", "de"):
        ids = [r.doc_id for r in out if r.lang == lang and not r.base_failed]
        want, _, _ = brute_mcd([[vectors[i][n] for n in quality.NAMES] for i in ids])
        got = {r.doc_id: r.d2 for r in out}
        assert np.allclose([got[i] for i in ids], want, rtol=1e-6)
    dirty = {r.doc_id for r in out if not r.kept and not r.base_failed}
    assert {i for i in range(0, 400, 20) if not vectors[i].base_failed} <= dirty and len(dirty) <= 22
    assert {r.doc_id for r in quality.clean(df).collect()} == {r.doc_id for r in out if r.kept}


def test_clean_keeps_columns_and_rows(tagged, spark):
    out = quality.clean(tagged)
    assert out.columns == tagged.columns
    none = tagged.limit(0)
    assert quality.judge(none).count() == 0 and quality.clean(none).count() == 0


def test_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.judge(df).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    gone = Counter(r.quality for r in rows if not r.kept)
    assert gone[1] <= 0.003 * len(rows) and gone[0] >= 100


def test_labels_bad_caught_and_clean_kept(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.judge(df).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    n, gone = Counter(r.quality for r in rows), Counter(r.quality for r in rows if not r.kept)
    assert gone[0] >= 0.95 * n[0] and gone[1] <= 0.002 * n[1]


def test_one_signal_rejects_alone(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda: [str(w) for w in rng.choice(words, 80)]
    rows = [(i, " ".join(w.capitalize() if k % 40 == 0 else w for k, w in enumerate(text()))) for i in range(400)]
    rows += [(1000, " ".join(f"{w} |" for w in text())), (1001, " ".join(text()).replace("w", "W").translate(str.maketrans("0123456789", "ABCDEFGHIJ")))]
    rows += [(1002, "\n".join(str(w) for w in rng.choice(words[10:16], 200)))]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    out = quality.judge(df).collect()
    assert not any(r.base_failed for r in out)
    gone = {r.doc_id for r in out if not r.kept}
    assert {1000, 1001, 1002} <= gone and len(gone) <= 5


def test_main_path_is_native(real):
    plan = quality.clean(real)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
