import random
import time

import pyarrow as pa

from lexspan.functions import markup
from lexspan.operators.tables import cells_of
from lexspan.tables import pieces

BITS = [
    "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TH Colspan=\"2\" id=\"a b\">", "</th >", "<td rowspan=2>", "<br>", "<br/>", "a", " b ", "&amp;", "&lt;td&gt;", "&copy", "x > y", "\n",
    "< 5", "<!-- <td> -->", "<script>", "</script>", "<title>", "</title>", "</td a=\"b\">", "<b", "\xa0", "<p class='x'>",
]


def test_plain_pages_are_read_as_the_parser_reads_them():
    rng, plain = random.Random(3), 0
    for _ in range(3000):
        html = "".join(rng.choices(BITS, [8] * 7 + [1] * 21, k=rng.randrange(1, 30)))
        plain += markup._split(html) is not None
        assert markup.marks(html) == markup._parsed(html)
        assert [(t, c, markup.attributes(a), x) for t, c, a, x in markup.steps(html)] == [(m.tag, m.closes, m.attributes, "".join(m.chunks)) for m in markup._parsed(html)]
    assert 300 < plain < 2900


def test_a_long_table_takes_time_by_its_length():
    n = 30_000
    html = "<table>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(n)) + "</table>"
    began = time.time()
    rows = cells_of(html)
    assert len(rows) == n and rows[-1] == [(str(n - 1), 1, 1, False), ("x", 1, 1, False)]
    assert time.time() - began < 20


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * i for i in range(100)]})
    found = list(pieces(iter([batch, batch.slice(0, 0), batch]), 200))
    assert [x for b in found for x in b.column(0).to_pylist()] == batch.column(0).to_pylist() * 2
    assert max(b.num_rows for b in found) < 10 and all(pieces(iter([batch]), 1))
