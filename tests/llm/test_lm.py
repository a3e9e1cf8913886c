import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.llm import lm


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


class Brute:
    def __init__(self, texts):
        pairs = Counter()
        for t in texts:
            last = 0
            for w in words_of(t):
                pairs[last, w] += 1
                last = w if w is not None else 0
        self.pairs, self.raw, self.kinds = pairs, Counter(), Counter()
        self.total, self.of = Counter(), defaultdict(lambda: [0, 0, 0])
        for (v, w), n in pairs.items():
            self.raw[w] += n
            self.kinds[w] += 1
            self.total[v] += n
            self.of[v][min(n, 3) - 1] += 1
        count = lambda c: [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        self.d, self.e = lm.discounts(count(pairs)), lm.discounts(count(self.kinds))
        self.free = sum(self.e[min(k, 3)] for k in self.kinds.values())
        self.all_kinds, self.all = sum(self.kinds.values()), sum(self.raw.values())

    def p(self, v, w):
        k = self.all_kinds
        low = max(self.kinds[w] - self.e[min(self.kinds[w], 3)], 0) / k + self.free / k / (len(self.raw) + 1)
        if v not in self.total:
            return low
        n = self.pairs.get((v, w), 0)
        return max(n - self.d[min(n, 3)], 0) / self.total[v] + sum(a * b for a, b in zip(self.d[1:], self.of[v])) / self.total[v] * low

    def score(self, text):
        last, out, base, known = 0, 0.0, 0.0, 0
        n, v = self.all, len(self.raw)
        words = words_of(text)
        for w in words:
            out += math.log10(self.p(last, w))
            base += math.log10((self.raw[w] + 1) / (n + v + 1))
            known += self.raw[w] > 0
            last = w if w is not None else 0
        return len(words), known, base, out


def test_against_brute_force(spark, docs, real):
    for df in (docs.select("doc_id", "text"), real.select("doc_id", "text")):
        df = df.withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False)))
        rows = df.collect()
        brute = Brute([r.text for r in rows if not r.held_out])
        model = lm.train(df.where("not held_out"), room=200_000, shard_bytes=500_000)
        assert model.totals["tokens"] == sum(brute.raw.values()) and model.totals["words"] == len(brute.raw)
        got = sorted([(str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(df, model).collect()])
        want = sorted((str(r.doc_id), *brute.score(r.text)) for r in rows)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


def test_probabilities_add_up(real):
    texts = [r.text for r in real.limit(60).collect()]
    brute = Brute(texts)
    for v in (0, "the", "nowhere"):
        assert sum(brute.p(v, w) for w in brute.raw) + brute.p(v, "nowhere") == pytest.approx(1)


def test_held_out_text_is_likelier_than_under_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("held_out", F.col("doc_id") % 7 == 2)
    r = lm.score(df, lm.train(df.where("not held_out"))).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_hashes_cross_pieces(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 64)
    texts = ["Ab cd", "", None, " ", "x" * 500, "a b " * 100, ("w" * 90 + " ") * 5, "é ü", "ab", "ab\x85c", "end "]
    _, words, ends = lm.tokens(pa.array(texts, pa.string()))
    _, again, _ = lm.tokens(pa.array(texts, pa.string()).slice(0, len(texts)))
    assert (words == again).all()
    flat = [w for t in texts for w in words_of(t)]
    assert len(flat) == len(words) and list(ends) == list(np.cumsum([len(words_of(t)) for t in texts]))
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    _, part, _ = lm.tokens(pa.array(texts, pa.string()).slice(5, 3))
    assert (part == words[ends[4] : ends[7]]).all()


def test_empty(spark, none):
    df = none.withColumn("held_out", F.lit(False))
    model = lm.train(df)
    assert lm.score(df, model).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    assert lm.score(one, model).first().score == pytest.approx(0)


def test_hot_contexts_are_dealt_and_summed(spark, monkeypatch):
    """A context of a third of all tokens: its pairs lie in many shards, and all scores are as by brute force."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(x for _ in range(60) for x in ("hot", f"w{rng.integers(4000)}", f"w{rng.integers(40)}")), i % 7 == 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, held_out boolean")
    brute = Brute([t for _, t, h in rows if not h])
    model = lm.train(df.where("not held_out"), room=5_000, shard_bytes=4_000)
    hot = lm.tokens(pa.array(["hot"]))[1][0]
    assert hot in model.hot and len(model.hot) <= lm.HOT
    contexts = np.full(500, hot)
    assert len(set(lm._pair_shard(contexts, lm._pair_key(contexts, np.arange(500, dtype=np.uint64)), model.hot, model.shards).tolist())) > 4
    got = sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in lm.score(df, model).collect())
    assert np.allclose(got, sorted((i, *brute.score(t)[1:]) for i, t, _ in rows), rtol=1e-9)


def test_a_missing_file_is_an_error(spark):
    import glob
    import os

    df = spark.createDataFrame([(1, "a b c a b", False)], "doc_id long, text string, held_out boolean")
    model = lm.train(df)
    files = glob.glob(f"{model.folder}/pairs-*.key")
    assert len(files) == model.shards
    for f in files:
        os.remove(f)
    with pytest.raises(Exception, match="No such file"):
        lm.score(df, model).collect()


def test_one_long_text(spark):
    df = spark.createDataFrame([(1, "a b c " * 400_000, False)], "doc_id long, text string, held_out boolean")
    r = lm.score(df, lm.train(df)).first()
    assert r.n_tokens == r.n_known == 1_200_001
