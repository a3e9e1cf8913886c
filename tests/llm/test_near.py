import itertools
import random

from lexspan.llm import simhash


def brute_kept(rows, n=5, least=0.8):
    """Ids that stay of (id, text): the smallest of each component by exact similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = set(itertools.chain.from_iterable(itertools.combinations(v, 2) for v in by.values()))
    alike = [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 10 * least * len(sets[a] | sets[b])]
    for a, b in alike:
        a, b = sorted((find(a), find(b)), key=lambda k: rows[k][0])
        root[b] = a
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id[find(k)] = min(i, least_id.get(find(k), i))
    return set(least_id.values()), len(alike)


def copies(spark):
    """Texts and copies with up to eight words changed, chains of copies among them."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(150):
        text = [word() for _ in range(rng.randrange(20, 400))]
        for _ in range(rng.randrange(1, 5)):
            rows.append((rng.randrange(10**9), " ".join(text)))
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = word()
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_copies_of_similarity_0_8_go(spark):
    rows, df = copies(spark)
    want, alike = brute_kept(rows)
    assert alike > 100 and {r.doc_id for r in simhash.one_of_each(df).collect()} == want


def test_recall_on_real_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) >= 10").dropDuplicates(["text"]).cache()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, alike = brute_kept(rows)
    assert alike >= 4 and {r.doc_id for r in simhash.one_of_each(df).collect()} == want


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (None, a), (None, a + " last"), (None, c), (None, c + " end")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, a), (5, b), (None, c), (None, c + " end")], key=str)
