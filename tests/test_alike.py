import random
import time

from pyspark.sql import functions as F

from lexspan.functions.edit import any_alike
from lexspan.functions.text import similarity


def test_as_the_similarity_of_each(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 1, 2, 9, 30])))
    rows = [(i, x := text(), [rng.choice([x, x[:-1] + "B", x.upper(), text()]) for _ in range(rng.randrange(5))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b array<string>")
    for least in (0.5, 0.8, 0.99):
        both = df.select(any_alike(F.col("a"), F.col("b"), least, 20).alias("x"), F.exists("b", lambda y: similarity(F.col("a"), y, 20) > least).alias("y"))
        assert both.where("not x <=> y").isEmpty() and both.where("x").count() and both.where("not x").count()


def test_long_texts_take_time_by_their_length(spark):
    """2,000 different characters each, so that bags hold 4,000 items."""
    text = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 20_000 + n * 2000), 4, "0")), "UTF-16BE")), "")
    df = spark.range(200).select(text(F.lit(0)).alias("a"), F.array(*[text(F.lit(n)) for n in (1, 2, 3)]).alias("b"))
    began = time.time()
    assert df.where(any_alike(F.col("a"), F.col("b"), 0.8)).isEmpty()
    assert time.time() - began < 60
