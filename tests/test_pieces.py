import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexspan.operators import privacy
from lexspan.sources import files, word
from lexspan.streaming.capacity import in_order


def test_texts_of_many_pieces(spark):
    """Rows of several MB in one batch, among them one that is a piece by itself."""
    text = F.concat(F.lit("a@b.com\n"), F.repeat(F.lit("line "), F.when(F.col("id") == 3, 400_000).otherwise(8_000)), F.lit("\n"), F.col("id"))
    docs = spark.range(60).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 5, text).alias("text"))
    assert sorted((r["doc_id"], r["n_spans"]) for r in privacy.masked_texts(docs).collect()) == [(i, int(i != 5)) for i in range(60)]
    assert privacy.pii_spans(docs).count() == 59
    back = files.docx_texts(word.word_files(docs)).select("doc_id", F.get(F.split("text", "\n"), F.lit(2)).alias("last"))
    assert sorted((r["doc_id"], r["last"]) for r in back.collect()) == [(i, None if i == 5 else str(i)) for i in range(60)]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    assert files.pages_text(pages).where("length(text) > 30000").count() == 59


def test_events_in_order():
    rng = random.Random(2)
    frames = [pd.DataFrame({"key": [rng.randrange(5) for _ in range(n)], "at": [rng.randrange(9) for _ in range(n)], "seq": rng.sample(range(1000), n)}) for n in (40, 1, 77)]
    every = pd.concat(frames).sort_values(["at", "seq"], kind="stable")
    found = list(in_order(iter(frames), 10))
    assert [at for _, at in found] == every["at"].tolist() and len(found) == 118
    assert {type(x) for pair in found for x in pair} == {int}
    one = pd.DataFrame({"key": [7, 8], "at": [3, 3], "seq": [2**63 - 1, 1]}, dtype=np.int64)
    assert list(in_order([one])) == [(8, 3), (7, 3)]
