import re
from collections import Counter

import corpus_pipeline
from lexspan.llm import quality
from tests.llm.test_near import brute_kept
from tests.llm.test_packing import whole


def test_run_against_brute_force(spark, real):
    """The verdicts of quality rules have their own brute-force test; the other stages are redone here.

    near_dedup follows the rule of the stage: five-word shingles, similarity 0.8 or more, all pairs compared exactly.
    """
    kept = {r.doc_id for r in quality.judge(real).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in real.collect() if r.doc_id in kept]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = sorted((i, t) for t, i in last.items())
    stay, _ = brute_kept(rows)
    rows = [r for r in rows if r[0] in stay]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert Counter({r.doc_id for r in out}) == Counter(i for i, _ in rows)
    whole(out, rows)


def test_stages_return_documents(spark, docs):
    from pyspark.sql import functions as F

    table = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    for kept in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, "")
            assert out.columns == kept.columns, name
            rows = out.collect()
            kept = spark.createDataFrame(rows, kept.schema)
        ids = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()}
        assert ids == {r.doc_id for r in kept.collect()}


def test_two_runs_stand_side_by_side(spark):
    a = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    b = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert rows(a) == rows(b) and a.count()


def test_names_that_stages_use_themselves(spark, docs):
    """Extra columns called like helpers of the stages, and the verdicts on null, empty, blank and repeated rows."""
    from pyspark.sql import functions as F

    names = ["__hot", "__deal", "__v", "__of", "__w", "__zero", "hot", "deal", "found", "of", "own", "zero", "salt", "n", "base", "group", "cls", "fp", "component_id"]
    table = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long"), **{c: F.lit("clash") for c in names}})
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted((r.doc_id is None, r.doc_id) for r in stages[name](spark, table, "").select("doc_id").collect())
    some = lambda *x: sorted((i is None, i) for i in x)
    assert ids("exact_dedup") == some(2, 3, 6, 5, 7, 9, 10, 11)  # of null and empty texts the largest id, of the rows that repeat one of them
    assert ids("near_dedup") == some(1, 4, 7, 7, 9, 10, 11)  # 10 and 11 share two of three distinct shingles
    assert ids("mixing") == some(*(r.doc_id for r in docs.collect()))
    assert all(stages[name](spark, table, "").columns == table.columns for name in ("exact_dedup", "near_dedup", "mixing", "quality_rules"))


def test_native_stages(spark, real):
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality_rules", "mixing"):
            assert not re.search("Python|Pandas|Arrow", stage(spark, real, "")._jdf.queryExecution().toString())
