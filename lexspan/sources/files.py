"""Files as tables: text, HTML, Word paragraphs, feedback lines, rule packs."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.markup import marks
from lexspan.tables import pieces

CHARSETS = ("utf-8", "gbk", "gb2312", "gb18030", "latin-1")
BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr"}
SKIPPED = {"script", "style", "head"}
FEEDBACK = "record_id string, timestamp string, document_type string, playbook_id string, clause_id int, clause_text string, clause_title string, original_risk struct<name:string,risk_level:string,rule_id:string>, user_action string, user_comment string, corrected_level string, corrected_risk_name string, legal_basis_cited string, source string"


def decode(data: bytes) -> str:
    for c in CHARSETS:
        try:
            return data.decode(c)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def html_text(html: str) -> str:
    """Text of a page; chunks are stripped and joined, lines end at block ends, blank lines and runs of blanks collapse.

    Only text right behind the opening of a skipped element is left out.
    """
    found = marks(html)
    ends = ("\n" if m.closes and m.tag in BREAKS else "" for m in found)
    texts = ("" if m.tag in SKIPPED and not m.closes else "".join(map(str.strip, m.chunks)) for m in found)
    joined = "".join(end + text for end, text in zip(ends, texts))
    return re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n+", "\n", joined)).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs and table rows of a Word file in their order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            out.append(text(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(filter(None, (text(c) for c in row.iter(f"{w}tc")))) for row in e.iter(f"{w}tr")]
    return "\n".join(x for x in out if x)


def pages_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(x or "") for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(run, f"{key} long, text string")


def docx_texts(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, text) of Word files."""

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(docx_text, b.column(1).to_pylist()), pa.string())], names=[key, "text"])

    return files.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, text string")


def documents(spark: SparkSession, path: str, max_mb: int = 10) -> DataFrame:
    """(filename, file_type, file_size, text, error) of txt, html and docx files; a bad file has an error, not an exception.

    Spark lists no files without a byte, so those give no row.
    """

    def read(kind: str, data: bytes) -> str:
        if kind == "docx":
            return docx_text(data)
        text = decode(data)
        return html_text(text) if kind in ("html", "htm") or kind == "doc" and "<html" in text[:2000].lower() else text

    def run(batches):
        for b in batches:
            names, sizes, datas = (b.column(i).to_pylist() for i in range(3))
            rows = []
            for name, size, data in zip(names, sizes, datas):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    if data is None:
                        raise ValueError(f"over {max_mb} MB")
                    if kind not in ("txt", "docx", "doc", "html", "htm"):
                        raise ValueError(f"no reader for .{kind}")
                    rows.append((name, kind, size, read(kind, data), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((name, kind, size, None, str(e)[:200]))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["filename", "file_type", "file_size", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.when(F.col("length") <= max_mb << 20, F.col("content"))
    return files.select(F.element_at(F.split("path", "/"), -1), "length", small).mapInArrow(run, "filename string, file_type string, file_size long, text string, error string")


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records of JSON lines; malformed lines and records without an id are left out."""
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path).where("record_id is not null")


def append_feedback(records: DataFrame, path: str) -> None:
    records.withColumn("clause_text", F.substring("clause_text", 1, 2000)).write.mode("append").json(path)
