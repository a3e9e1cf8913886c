"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin ones, digits and signs that stand for letters to those letters. Terms
match whole folded words, so the automaton sees each term between blanks. A
term inside a matched exception phrase does not count. The sum of the weights,
normalised by length, goes through a logistic curve to a score from 0 to 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm import scratch

#: look-alikes of the Latin letters below them, and signs that stand for letters (fixed values); l folds to i as 1 may be either
LOOK_ALIKES = "аɑαвьсϲԁеєёεһніїιıјκкӏмոոопοσрρгѕтτυսνѵωѡхχуγүz"
LATIN_____ = "aaabbccdeeeehhiiiijkkimnnonooppgsttuuvvwwxxyyyz"
SIGNS = {"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g"}


def _table() -> dict[int, str]:
    table = {ord(a): b for a, b in zip(LOOK_ALIKES, LATIN_____)}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)}  # full width
    table |= {0x1D41A + 26 * 2 * k + i: chr(97 + i) for k in range(13) for i in range(26)}  # mathematical alphabets
    table = {k: SIGNS.get(v, v) for k, v in table.items()}
    return table | {ord(k): v for k, v in SIGNS.items()} | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), "")


_FOLD = _table()
_BREAK = re.compile(r"[^\w@$!|+­​-‍⁠﻿]+")
_EDGE = re.compile(r"[@$!|+]+(?!\w)|(?<!\S)[@$!|+]{2,}")


def fold(text: str) -> str:
    """Folded words between single blanks, a blank at either end; signs count as letters only before or between word characters."""
    text = _EDGE.sub("", _BREAK.sub(" ", text.lower())).translate(_FOLD)
    return " " + " ".join(text.split()) + " "


@dataclass
class Lexicon:
    """weights by folded term, and folded phrases in which terms do not count."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, ...] = (-3.0, 1.0, 0.5, 0.5)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(f" {term} ", (len(term), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a if len(a) else None


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms in a folded text that no exception covers."""
    found = [(end - n, end, w) for end, (n, w) in automaton.iter(folded)] if automaton else []
    if all(w is not None for _, _, w in found):
        return found
    # an exception covers a term if, of those that begin no later, the one that reaches farthest reaches its end
    safe = sorted((a, b) for a, b, w in found if w is None)
    starts, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))
    free = lambda a, b: not (i := bisect_right(starts, a)) or reach[i - 1] < b
    return [(a, b, w) for a, b, w in found if w is not None and free(a, b)]


def features(automaton, folded: str) -> tuple[float, float, float, int]:
    """(sum of weights, by length, heaviest, number) of a text's terms."""
    found = hits(automaton, folded)
    if not found:
        return 0.0, 0.0, 0.0, 0
    total = sum(w for _, _, w in found)
    words = folded.count(" ") - 1
    return np.log1p(total), np.log1p(100.0 * total / max(words, 20)), max(w for _, _, w in found), len(found)


def probability(coefficients, x) -> np.ndarray:
    x = np.asarray(x, float).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ np.asarray(coefficients[1:]), -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    keep = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def _counted(items_of):
    """Partial sums (term, toxic texts, clean texts) over (folded, toxic) of the distinct items of each text."""

    def run(batches):
        items = items_of()
        counts = {True: Counter(), False: Counter()}

        def out():
            words = list(counts[True].keys() | counts[False].keys())
            yield pa.RecordBatch.from_pydict({"term": words, "bad": [counts[True][w] for w in words], "good": [counts[False][w] for w in words]})

        for batch in batches:
            for folded, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[bool(toxic)].update(items(folded.as_py()))
            if len(counts[True]) + len(counts[False]) > 300_000:
                yield from out()
                counts = {True: Counter(), False: Counter()}
        yield from out()

    return run


def _words():
    return lambda folded: set(folded.split())


def _neighbours(weights: dict[str, float]):
    """The two-word phrases around the terms of a text."""

    def make():
        automaton = Lexicon(weights).automaton()

        def items(folded):
            phrases = set()
            for a, b, _ in hits(automaton, folded):
                term = folded[a:b]
                # folded words lie between single blanks
                if a > 1:
                    phrases.add(f"{folded[folded.rfind(' ', 0, a - 1) + 1 : a - 1]} {term}")
                if b + 1 < len(folded):
                    phrases.add(f"{term} {folded[b + 1 : folded.find(' ', b + 1)]}")
            return phrases

        return items

    return make


_COUNTS = "term string, bad long, good long"


def _folded(batches):
    for batch in batches:
        folded = pa.array([fold(t.as_py() or "") for t in batch.column(0)], pa.string())
        yield pa.RecordBatch.from_arrays([folded, batch.column(1).cast(pa.int32()), batch.column(2)], names=["folded", "toxic", "half"])


def _lexicon(rows: DataFrame) -> Lexicon:
    """Terms and exceptions of rows (folded, toxic); none without labels of both kinds."""
    totals = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") > 0).agg(F.count("*")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if not bad or not good:
        return Lexicon({})
    rows = rows.select("folded", "toxic")
    summed = lambda items: rows.mapInArrow(_counted(items), _COUNTS).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # likelihood ratio of one rate for both kinds against two; 25 is five standard deviations, at small counts too
    texts = F.col("bad") + F.col("good")
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (of * texts / (bad + good)))).otherwise(0.0)
    g = 2 * sum((part(F.col(c), n) + part(n - F.col(c), n * (bad + good - texts) / texts) for c, n in (("bad", bad), ("good", good))), F.lit(0.0))
    found = summed(_words).where("bad >= 5").select("term", ratio.alias("w"), g.alias("g")).where("w >= 1.5 and g >= 25").collect()
    lexicon = Lexicon({r.term: float(r.w) for r in sorted(found, key=lambda r: r.term)})
    if lexicon.weights:
        lexicon.exceptions = sorted(r.term for r in summed(_neighbours(lexicon.weights)).where("good >= 8 and bad = 0").select("term").collect())
    return lexicon


def learn(texts: DataFrame, labels: DataFrame, rows: int = 40_000, tag: str = "toxicity") -> Lexicon:
    """A lexicon from texts (doc_id, text) with labels (doc_id, toxic).

    At most ``rows`` labelled ids, by hash, are used, so that the labels fit a
    broadcast; their texts are folded and written once. A term is a folded word
    that is far likelier in toxic texts than in others; an exception is a phrase
    of two words around a term that is met in others only. Terms stand in five
    toxic texts of the sample and exceptions in eight others at least, and
    nothing else bounds their number. Each half of the sample chooses a lexicon
    for the other half's features, on which the curve is fitted, so no text
    helps to choose the terms that its own features count; the lexicon that
    scores is of both halves. Without labels of both kinds the lexicon is empty
    and the score is the share of toxic labels.
    """
    sample = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)
    mine = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic", (F.xxhash64(F.lit("half"), "doc_id") % 2 == 0).alias("half"))
    mine = scratch.written(mine.mapInArrow(_folded, "folded string, toxic int, half boolean"), f"{tag}-sample")
    lexicon = _lexicon(mine)
    if not lexicon.weights:
        bad, good = (mine.where(x).count() for x in ("toxic > 0", "not toxic > 0"))
        lexicon.coefficients = (float(np.log((bad + 0.5) / (good + 0.5))), 0.0, 0.0, 0.0)
        return lexicon
    halves = [_featured(mine.where(F.col("half") == side), _lexicon(mine.where(F.col("half") != side))) for side in (True, False)]
    table = halves[0].unionByName(halves[1]).toPandas()  # at most ``rows`` texts, four numbers each
    lexicon.coefficients = fit_curve(table[["a", "b", "c"]].to_numpy(), (table.toxic > 0).to_numpy(float))
    return lexicon


def _featured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            x = [features(automaton, t.as_py())[:3] for t in batch.column(0)]
            a, b, c = zip(*x) if x else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) for v in (a, b, c)] + [batch.column(1)], names=["a", "b", "c", "toxic"])

    return rows.select("folded", "toxic").mapInArrow(run, "a double, b double, c double, toxic int")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, hits, weight) of a frame (doc_id, text).

    A null or empty text has no hits and the score of a text without terms.
    Repeated rows get equal scores; an empty table gives no rows. A text costs
    in proportion to its length, and its terms and exceptions as in sorting.
    """

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            x = [features(automaton, fold(t.as_py() or "")) for t in batch.column(1)]
            p = probability(lexicon.coefficients, [v[:3] for v in x])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array([v[3] for v in x], pa.int32()), pa.array([float(np.expm1(v[0])) for v in x], pa.float64())],
                names=["doc_id", "score", "hits", "weight"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, hits int, weight double")
