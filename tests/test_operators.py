"""Operators beyond SQL against plain versions on small and random inputs."""

import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from lexspan.functions import edit
from lexspan.operators import entities, pages, responses, tables
from lexspan.sources import files, word


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_common_length_equals_the_dynamic_programme():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("abc甲", k=r.randrange(0, 90))) for _ in range(2))
        assert edit.common_length(a, b) == lcs(a, b)


def test_indel_of_nulls_empty_and_equal_texts():
    assert edit.indel(None, "x") == edit.indel("", "") == 0.0
    assert edit.indel("Same", "sAME") == 1.0
    assert edit.indel("x" * 500 + "a", "x" * 500 + "b") == 1.0


def test_differences_apply_to_the_old_text():
    r = random.Random(2)
    for _ in range(100):
        old, new = ("\n".join(r.choices("abcd", k=r.randrange(1, 8))) for _ in range(2))
        marks = edit.changed_lines(old, new)
        assert len(old.split("\n")) - sum(m == "-" for m, _ in marks) + sum(m == "+" for m, _ in marks) == len(new.split("\n"))
        assert (old == new) == (not marks)
    assert edit.SAME in edit.difference_html("a", "a")
    assert "&lt;b&gt;" in edit.difference_html("", "<b>")


def folded(blocks):
    """Pages joined one after the other, by hand."""
    by_page = {}
    for p, o, b, kind, text in sorted(blocks):
        by_page.setdefault(p, []).append([b, kind, text])
    order = sorted(by_page)
    import re

    for p, q in zip(order, order[1:]):
        left = [x for x in by_page[p] if x[1] in pages.TEXT]
        right = [x for x in by_page[q] if x[1] in pages.TEXT]
        if left and right:
            a, b = left[-1][2].rstrip(), right[0][2].lstrip()
            if a and b and not re.search(pages.SENTENCE_END, a) and not re.match("|".join(pages.HEADERS), b):
                left[-1][2] = a + b
                by_page[q].remove(right[0])
    return sorted((b, text) for p in order for b, _, text in by_page[p])


def test_joined_pages_equal_the_fold(spark):
    r = random.Random(3)
    rows = []
    for doc in range(60):
        for p in range(r.randrange(1, 7)):
            for o in range(r.randrange(1, 4)):
                rows.append((doc, p, o, f"{p}-{o}", r.choice(["text", "text", "title", "table"]), r.choice(["cut ", "ends.", " off", "第二条 x", "", "a;"])))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, ord int, block_id string, block_type string, content string")
    got = {}
    for x in pages.joined_pages(df).collect():
        got.setdefault(x.doc_id, []).append((x.block_id, x.content))
    for doc in range(60):
        want = folded([x[1:] for x in rows if x[0] == doc])
        # where a block took another in, white space between them is gone on both sides
        assert sorted(got.get(doc, [])) == want


def test_json_in_texts():
    for x in ([1, {"a": "b"}], {"k": [1, 2, {"z": {}}]}):
        assert json.loads(responses.json_in(f"see {json.dumps(x)} and {{more}}")) == x
    assert responses.json_in("```JSON\n[1]\n``` {}") == "[1]"
    assert responses.json_in("```\nnone\n``` then {\"a\": 1}") == '{"a": 1}'
    assert responses.json_in(None) is responses.json_in("]") is responses.json_in("[1") is None


def test_findings_with_odd_fields():
    assert responses.findings_in('{"risks": []}') == responses.findings_in("[1, null]") == []
    one = responses.findings_in('{"name": null, "risk_level": ["high"], "confidence": true, "clause_preview": "%s", "suggestion": ""}' % ("p" * 300))[0]
    assert (one["risk_level"], one["confidence"], len(one["clause_preview"]), one["suggestion"]) == ("medium", 1.0, 200, None)


def test_cells_of_broken_html():
    assert tables.cells_of("<table><td>x</td>") == []
    assert tables.cells_of("<table><tr><td>x</table>") == []
    assert tables.cells_of("<table><tr><td rowspan=0>x</td></tr>") == [[("x", 1, 1, False)]]


def test_empty_tables_of_blocks(spark):
    blocks = spark.createDataFrame([], "doc_id long, page_index int, ord int, block_id string, block_type string, content string")
    assert pages.joined_pages(blocks).count() == pages.document_text(blocks).count() == 0
    lines = blocks.withColumns({c: F.lit(0.0) for c in ("x1", "y1", "page_width", "page_height")})
    assert tables.borderless(lines).count() == 0


def test_chinese_numerals_below_a_hundred(spark):
    names = "〇一二三四五六七八九"
    texts = {n: ("" if n < 20 else names[n // 10]) + ("十" if n >= 10 else "") + (names[n % 10] if n % 10 or not n else "") for n in range(100)}
    df = spark.createDataFrame(list(texts.items()), "n int, t string").select("n", entities.small_number(F.col("t")).alias("strict"), entities.small_number(F.col("t"), False).alias("compat"))
    rows = {x.n: x for x in df.collect()}
    assert all(x.strict == n for n, x in rows.items())
    assert (rows[15].compat, rows[20].compat, rows[12].compat) == (105, 30, 12)


def test_word_files_are_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\n\n-old <x>\n+new & y"), (2, None), (3, "\x00bad￾")], "doc_id long, text string")
    written = word.word_files(docs)
    texts = {x.doc_id: files.docx_text(bytes(x.content)) for x in written.collect()}
    assert texts == {1: "one\n-old <x>\n+new & y", 2: "", 3: "bad"}
    word.save(written, str(tmp_path / "out"))
    word.save(written, str(tmp_path / "out"))
    read = {x.filename: x.text for x in files.documents(spark, str(tmp_path / "out")).collect()}
    assert read == {"1.docx": texts[1], "2.docx": "", "3.docx": "bad"}


def tracked() -> bytes:
    w = f'xmlns:w="{word.W[1:-1]}"'
    body = f'<w:document {w}><w:body><w:p><w:ins w:author="A" w:date="2024-01-02T03:04:05Z"><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment w:author="B"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment></w:comments>')
    return out.getvalue()


def test_tracked_changes(spark):
    df = spark.createDataFrame([(1, tracked()), (2, b"no file"), (3, None)], "doc_id long, content binary")
    rows = [(x.doc_id, x.ord, x.kind, x.content, x.author, x.date) for x in word.tracked_changes(df).collect()]
    assert sorted(rows) == [(1, 0, "comment", "why", "B", None), (1, 1, "insert", "new", "A", "2024-01-02"), (1, 2, "delete", "old", word.UNKNOWN, None)]


def test_risks_are_linked_by_each_strategy(spark):
    from lexspan.operators import rules

    clauses = spark.createDataFrame([(1, 1, "Payment", "The buyer pays within thirty days of delivery."), (1, 2, "Liability", "The seller is LIABLE for short delays, and for defects of the goods.")], "doc_id long, clause_id long, title string, content string")
    risks = [
        (1, 1, "r", "Liability clause", "", []), (1, 2, "r", "", "The buyer pays within thirty", []), (1, 3, "r", "", "liable is not here but this is long", []), (1, 4, "r", "", "is LIABLE for short delays", []),
        (1, 5, "r", "", "short", []), (1, 6, "r", "", "", ["liable", "Defects"]), (1, 7, "r", "", "", ["none"]), (2, 1, "r", "", "", ["liable"]),
    ]
    df = spark.createDataFrame(risks, "doc_id long, ord long, name string, clause_title string, clause_preview string, keywords array<string>")
    got = {(r.doc_id, r.ord): (r.linked_clause, r.strategy) for r in rules.traced(df, clauses).collect()}
    assert got == {(1, 1): (2, 1), (1, 2): (1, 2), (1, 3): (None, None), (1, 4): (2, 3), (1, 5): (None, None), (1, 6): (2, 4), (1, 7): (None, None), (2, 1): (None, None)}


def test_ends_of_segments(spark):
    from lexspan.operators import segment

    texts = {1: "", 2: None, 3: "x" * 5 + "   ", 4: "abcdefgh", 5: "a\n" * 6}
    out = segment.pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), most=4).collect()
    got = {i: [r.content for r in sorted(out, key=lambda r: r.piece) if r.doc_id == i] for i in texts}
    assert got == {1: [""], 2: [""], 3: ["xxxxx"], 4: ["abcde", "fgh"], 5: ["a\na\n", "a\na\n", "a\na\n"]}


def test_columns_by_the_page_width(spark):
    """Of four centres the upper middle one counts, and the page's width, not that of its text."""
    from lexspan.operators import structure

    rows = [(1, 0, f"b{i}", "text", x, 10.0 * i, x + 2, 10.0 * i + 5, w) for w in (100.0,) for i, x in enumerate((10.0, 20.0, 54.0, 60.0))]
    rows += [(2, *r[1:8], 300.0) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block_id string, block_type string, x1 double, y1 double, x2 double, y2 double, page_width double")
    assert {(r.doc_id, r.n_columns) for r in structure.reading_order(df).collect()} == {(1, 2), (2, 1)}


def test_cells_and_texts_of_nested_html():
    from lexspan.sources import files

    page = "<table><tr><th colspan=2>h<br>i</th></tr><tr><td>a<table><tr><td>in</td></tr></table>b</td><td>c</td></tr><tr><td>open</tr><tr><td rowspan='2'>&amp;x</td></tr></table>"
    assert tables.cells_of(page) == [[("h\ni", 1, 2, True)], [("a[嵌套表格]b", 1, 1, False), ("c", 1, 1, False)], [("&x", 2, 1, False)]]
    assert tables.cells_of("<table><tr><td colspan=x>a</td></tr></table>") == []
    assert files.html_text("<head><title>t</title></head><p> a <b>b</b> c</p><script>no</script>d<br/>e\n\n<li>f</li>") == "tabc\nd\nef"
