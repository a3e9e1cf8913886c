"""Word files with the standard library: written reports, tracked changes and comments."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexspan.tables import pieces

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: fixed values: the three parts of the smallest valid file
TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
LINKS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
COLOURS = {"-": "721C24", "+": "155724"}
STAMP = (1980, 1, 1, 0, 0, 0)
REVISION = ArrayType(StructType([StructField(n, StringType()) for n in ("kind", "content", "author", "date")]))
UNKNOWN = "未知"


#: characters that XML cannot hold
INVALID = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")


def word_file(lines: list[str]) -> bytes:
    """A file with a paragraph per line; equal lines give equal bytes. Lines marked - or + have the colours of removed and added text."""
    body = []
    for line in lines:
        colour = COLOURS.get(line[:1])
        style = f'<w:rPr>{"<w:strike/>" if line[:1] == "-" else ""}<w:color w:val="{colour}"/></w:rPr>' if colour else ""
        body.append(f'<w:p><w:r>{style}<w:t xml:space="preserve">{escape(INVALID.sub("", line))}</w:t></w:r></w:p>')
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", TYPES), ("_rels/.rels", LINKS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name, STAMP), part)
    return out.getvalue()


def word_files(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, content): a Word file of each text."""

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((word_file((x or "").split("\n")) for x in b.column(1).to_pylist()), pa.binary())], names=["doc_id", "content"])

    rows = docs.select("doc_id", text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")


def save(files: DataFrame, folder: str, suffix: str = ".docx") -> None:
    """Write each content to folder/doc_id.docx, a folder that every worker has mounted. A task that runs again replaces its files whole."""

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, os.path.join(folder, f"{r['doc_id']}{suffix}"))

    files.select("doc_id", "content").foreachPartition(put)


def changes_in(data: bytes | None) -> list[dict]:
    """Comments, insertions and deletions of a Word file, in that order; none of a file that is no Word file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            parts = {n: ElementTree.fromstring(z.read(n)) for n in ("word/comments.xml", "word/document.xml") if n in z.namelist()}
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []
    out = []
    for kind, part, tag in (("comment", "word/comments.xml", "comment"), ("insert", "word/document.xml", "ins"), ("delete", "word/document.xml", "del")):
        for e in parts[part].iter(W + tag) if part in parts else ():
            # deleted text has an element of its own
            content = "".join(t.text or "" for t in e.iter() if t.tag in (W + "t", W + "delText"))
            if content:
                out.append({"kind": kind, "content": content, "author": e.get(W + "author", UNKNOWN), "date": (e.get(W + "date") or "")[:10] or None})
    return out


@F.pandas_udf(REVISION)
def _changes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([changes_in(x) for x in s], dtype="object")


def tracked_changes(files: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, ord, kind, content, author, date) of the tracked changes and comments of Word files."""
    rows = files.select("doc_id", F.posexplode(_changes(F.col(content))).alias("ord", "c"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "c.*")
