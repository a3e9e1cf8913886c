"""Text predicates and similarities as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named; the optimizer cannot put it into a lambda again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in the text (each once)."""
    return sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match somewhere."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def first_match(text: Column, options: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The first option with a keyword in the text."""
    out = F.lit(default).cast("string")
    for name, words in reversed(options):
        out = F.when(keyword_hits(text, words) > 0, F.lit(name)).otherwise(out)
    return out


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def grams(text: Column, n: int) -> Column:
    """Character n-grams in order; none for shorter texts."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays as bags of items."""
    names = F.array_union(a, b)
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x)).cast("double")
    dot = F.aggregate(names, F.lit(0.0), lambda s, x: s + count(a, x) * count(b, x))
    norm = lambda items: F.sqrt(F.aggregate(names, F.lit(0.0), lambda s, x: s + count(items, x) * count(items, x)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, most: int = 500) -> Column:
    """Cosine of uni- and bigram counts of the first characters in lower case; equal texts 1, empty ones 0."""
    a, b = (F.substring(F.lower(x), 1, most) for x in (a, b))
    bag = lambda x: F.concat(grams(x, 1), grams(x, 2))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(cosine(bag(a), bag(b)))


def escape_html(c: Column, quotes: bool = True) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&#39;")] if quotes else [])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def truncated(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def running(sizes: Column) -> Column:
    """The sums of the items before each item of an array of integers.

    Items are taken in runs of about the root of their number: a sum is that of
    whole runs and of the rest of its own run, so that n sums cost n^1.5 steps.
    """

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)

    def sums(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        run = lambda i: F.floor(i / width).cast("int")
        runs = F.transform(F.sequence(F.lit(0), run(F.size(x) - 1)), lambda k: total(F.slice(x, k * width + 1, width)))
        before = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda k: total(F.slice(r, F.lit(1), k)))
        # bound to names in arrays of one, so that nothing is worked out again for each item
        heads = F.flatten(F.transform(F.array(runs), before))
        return F.flatten(F.transform(F.array(heads), lambda h: F.transform(x, lambda _, i: F.get(h, run(i)) + total(F.slice(x, run(i) * width + 1, i - run(i) * width)))))

    some = F.flatten(F.transform(F.array(sizes), lambda x: F.when(F.size(x) > 0, sums(x)).otherwise(F.array().cast("array<bigint>"))))
    return F.when(sizes.isNotNull(), some)


def occurrences(text: Column, word: Column) -> Column:
    """How often the word occurs without overlap; 0 for an empty word."""
    left = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(F.length(word) > 0, (left / F.length(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct items of a that b has; 0 where either is empty."""
    n = F.size(F.array_distinct(a))
    return F.when((n > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))
