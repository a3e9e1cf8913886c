"""Edit similarity and line differences: Arrow-batched, as no built-in expresses them."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time.

    Bits of one integer stand for the rows of the dynamic programme; a zero bit
    is a step in the length.
    """
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def indel(a: str | None, b: str | None, head: int = 500) -> float:
    """2 LCS / (length of both) of the first characters in lower case; equal texts 1, an empty or null one 0."""
    a, b = (a or "").lower()[:head], (b or "").lower()[:head]
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2 * common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([indel(x, y) for x, y in zip(a, b)], dtype="float64")


def changed_lines(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """(mark, line) of lines that differ: ``@`` at each new place, ``-`` removed, ``+`` added."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if kind != "equal":
            out += [("@", "")] + [("-", x) for x in a[i:j]] + [("+", x) for x in b[k:m]]
    return out


#: fixed values: the words of a difference and the classes of its lines
CHANGED, SAME = "条款修订", "无差异"
TAGS = {"+": "diff-added", "-": "diff-removed"}


def difference_html(old: str | None, new: str | None) -> str:
    """Removed and added lines as spans under a heading each; a heading alone where nothing differs."""
    rows = [
        f'<div class="diff-header">{CHANGED}</div>' if mark == "@" else f'<span class="{TAGS[mark]}">{escape(line)}</span><br>' for mark, line in changed_lines(old, new)
    ]
    return "\n".join(['<div class="diff-content">', *(rows or [f'<div class="diff-header">{SAME}</div>']), "</div>"])


@F.pandas_udf(StringType())
def difference(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([difference_html(x, y) for x, y in zip(a, b)], dtype="object")


def bag(text: str) -> tuple[Counter, float]:
    """Counts of a text's characters and pairs of them, and their norm."""
    counts = Counter(text) + Counter(map("".join, zip(text, text[1:])))
    return counts, math.sqrt(sum(n * n for n in counts.values()))


def _alike(text: str, others: list[str], least: float) -> bool:
    some = [x for x in others if x] if text else []
    if text in some:
        return True
    if not some:
        return False
    own, norm = bag(text)
    for x in set(some):
        other, far = bag(x)
        small, large = (own, other) if len(own) < len(other) else (other, own)
        if sum(n * large.get(g, 0) for g, n in small.items()) / (norm * far) > least:
            return True
    return False


def any_alike(text: Column, others: Column, least: float, most: int = 2000) -> Column:
    """Whether ``functions.text.similarity`` of the text and one of the others is over least; time by their lengths."""

    @F.pandas_udf(BooleanType())
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_alike(x, list(y), least) for x, y in zip(a, b)], dtype="bool")

    cut = lambda x: F.substring(F.lower(x), 1, most)
    return found(cut(text), F.transform(others, cut))
