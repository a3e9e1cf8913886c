import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import toxicity


def brute_hits(lexicon, text):
    """Folded words compared one by one."""
    words = toxicity.fold(text).split()
    covered = set()
    for phrase in lexicon.exceptions:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                covered |= set(range(i, i + len(p)))
    out = []
    for term, w in lexicon.weights.items():
        p = term.split()
        out += [w for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p and not set(range(i, i + len(p))) <= covered]
    return sorted(out)


def test_folding():
    f = lambda x: toxicity.fold(x).strip()
    assert f("IDIOT!!") == f("1d10t") == f("іdіоt") == f("ｉｄｉｏｔ") == f("id​iot") == f("𝐢𝐝𝐢𝐨𝐭") == "idiot"
    assert f("(loser)") == f("l0$er###") == f("|oser,") == "ioser"
    assert f("@ss") == "ass" and f("") == f(" \n!!! $$$") == ""
    assert toxicity.fold("x") == " x "


def test_hits_against_brute_force(real):
    rng = random.Random(0)
    texts = [r.text for r in real.limit(200).collect()]
    words = [w for t in texts for w in toxicity.fold(t).split()]
    terms = rng.sample(words, 80)
    pairs = [f"{words[i]} {words[i + 1]}" for i in rng.sample(range(len(words) - 1), 60)]
    lexicon = toxicity.Lexicon({t: 1 + i / 7 for i, t in enumerate(dict.fromkeys(terms + pairs[:20]))}, [p for p in pairs[20:] if p not in pairs[:20]])
    automaton = lexicon.automaton()
    for t in texts:
        assert sorted(w for *_, w in toxicity.hits(automaton, toxicity.fold(t))) == pytest.approx(brute_hits(lexicon, t))


def test_exceptions_and_overlaps():
    lexicon = toxicity.Lexicon({"scum": 2.0, "trash": 1.0}, ["trash can"])
    a = lexicon.automaton()
    assert toxicity.features(a, toxicity.fold("scum scum trash"))[3] == 3
    assert toxicity.features(a, toxicity.fold("the TR4SH can"))[3] == 0
    assert toxicity.features(a, toxicity.fold("trash, can trash"))[3] == 1
    assert toxicity.features(toxicity.Lexicon({}).automaton(), " a ")[3] == 0


def test_curve_finds_coefficients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 3))
    y = rng.random(20_000) < 1 / (1 + np.exp(-(-1 + x @ [2, 0, -1])))
    assert np.allclose(toxicity.fit_curve(x, y), (-1, 2, 0, -1), atol=0.15)


def test_held_out_labels(spark):
    from lexspan.llm.queries import op1_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op1_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught >= 0.65 * sum(r.toxic for r in rows) and caught >= 0.9 * sum(r.predicted for r in rows)


def test_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), labels)
    out = toxicity.score(docs, lexicon).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(none, lexicon).count() == 0
    assert toxicity.learn(none, labels.where(F.lit(False))).weights == {}


def test_exceptions_against_every_pair():
    """The covering test in order of places gives what comparing each term with each exception gives; long texts do not cost its square."""
    import random
    import time

    rng = random.Random(0)
    words = ["a", "b", "c", "d"]
    lexicon = toxicity.Lexicon({"a": 1.0, "b c": 2.0, "c": 1.5}, ["a b", "b c d", "c c"])
    automaton = lexicon.automaton()
    for _ in range(300):
        folded = " " + " ".join(rng.choices(words, k=rng.randrange(1, 30))) + " "
        found = [(end - n, end, w) for end, (n, w) in automaton.iter(folded)]
        safe = [(a, b) for a, b, w in found if w is None]
        want = [(a, b, w) for a, b, w in found if w is not None and not any(x <= a and b <= y for x, y in safe)]
        assert toxicity.hits(automaton, folded) == want
    began = time.time()
    toxicity.features(automaton, " " + "a b c d " * 100_000)
    assert time.time() - began < 20


def brute_lexicon(rows):
    """Terms and exceptions of (text, toxic), counted text by text."""
    import math
    from collections import Counter

    bad, good = sum(t > 0 for _, t in rows), sum(not t > 0 for _, t in rows)
    if not bad or not good:
        return toxicity.Lexicon({})
    folded = [(toxicity.fold(x).split(), t > 0) for x, t in rows]
    seen = {kind: Counter(w for words, t in folded if t is kind for w in set(words)) for kind in (True, False)}
    weights = {}
    for w, b in seen[True].items():
        g = seen[False][w]
        cells = [(b, bad, b + g), (bad - b, bad, bad + good - b - g), (g, good, b + g), (good - g, good, bad + good - b - g)]
        ratio = 2 * sum(n * math.log(n * (bad + good) / (of * all_)) for n, of, all_ in cells if n)
        weight = math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
        if b >= 5 and weight >= 1.5 and ratio >= 25:
            weights[w] = weight
    around = {True: Counter(), False: Counter()}
    for words, t in folded:
        pairs = {f"{x} {y}" for x, y in zip(words, words[1:]) if x in weights or y in weights}
        around[t].update(pairs)
    return toxicity.Lexicon(weights, sorted(p for p, n in around[False].items() if n >= 8 and not around[True][p]))


def test_query_against_brute_force(spark):
    """op1 as registered: split, lexicon of all, curve on halves that chose no term of their own, scores and verdicts."""
    import zlib

    from lexspan.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.01"
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("half", F.xxhash64(F.lit("half"), "doc_id") % 2 == 0).collect()
    rows = [(texts[r.doc_id], r.toxic, r.half) for r in labels if r.toxic is not None and r.doc_id in texts and not out(r.doc_id)]
    full = brute_lexicon([r[:2] for r in rows])
    halves = {side: brute_lexicon([r[:2] for r in rows if r[2] is not side]) for side in (True, False)}
    x = [toxicity.features(halves[h].automaton(), toxicity.fold(t))[:3] for t, _, h in rows]
    full.coefficients = toxicity.fit_curve(np.array(x), np.array([t > 0 for _, t, _ in rows], float))
    assert full.weights
    got = {r.doc_id: r for r in op1_toxicity(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = toxicity.probability(full.coefficients, toxicity.features(full.automaton(), toxicity.fold(t))[:3])[0]
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].held_out is out(i) and got[i].predicted == (got[i].score >= 0.3)


def test_nothing_bounds_the_lexicon(spark):
    """3,000 words of toxic texts alone are 3,000 terms, and as many phrases of other texts alone exceptions."""
    bad = [(i, " ".join(f"bad{k}x" for k in range(3000)), 1) for i in range(40)]
    good = [(100 + i, " ".join(f"bad{k}x safe{k}x" for k in range(2500)) if i < 9 else "calm", 0) for i in range(400)]
    rows = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert len(lexicon.weights) == 3000 and len(lexicon.exceptions) >= 2500
