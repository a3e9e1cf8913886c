import itertools
import re

import numpy as np
import xxhash

from lexspan.llm import simhash
from lexspan.llm.components import components


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_triples_leave_one_error_at_most():
    for d in itertools.product(range(5), repeat=6):
        if sum(d) == 4:
            assert any(sum(d[p] for p in t) <= 1 for t in simhash.TRIPLES)


def test_anchors_cover_all_pairs_within_four_bits():
    rng = np.random.default_rng(1)
    for bits in range(5):
        for _ in range(300):
            a = rng.integers(0, 1 << 64, dtype=np.uint64)
            b = a
            for k in rng.choice(64, bits, replace=False):
                b ^= np.uint64(1 << int(k))
            keys, places = simhash.anchors(np.array([a, b], np.uint64))
            assert set(keys[places == 0]) & set(keys[places == 1])
            assert len(set(keys[places == 0])) == (places == 0).sum() <= simhash.REPLICAS + 10


def test_dense_and_chained_stars():
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = np.unique(np.array([base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)] + [base ^ ((1 << k) - 1) for k in range(0, 60, 3)] + [~base], np.int64))
    links = simhash.star(fps)
    assert len(links) < len(fps)
    got = {int(f): int(f) for f in fps}
    got.update({v: u for u, v in links})
    want = brute_groups([int(f) & (2**64 - 1) for f in fps])
    by = {}
    for f, w in zip(fps, want):
        by.setdefault(w, set()).add(got[int(f)])
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_components_of_paths(spark, monkeypatch):
    from lexspan.llm import components as module

    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1003), (7, 500), (2000, 2000)]
    df = spark.createDataFrame(edges, "u long, v long")
    tags, write = [], module.written
    monkeypatch.setattr(module, "written", lambda x, tag: (tags.append(tag), write(x, tag))[1])
    roots = {r.node: r.root for r in components(df, "t").collect()}
    assert len({roots[i] for i in [*range(301), 500]}) == 1 and roots[0] in roots
    assert len({roots[i] for i in (1000, 1001, 1003)}) == 1 and roots[2000] == 2000
    assert len(set(roots.values())) == 3 and len(roots) == 306
    # a path of 301 nodes: about log2(301) rounds, where going over to the least neighbour takes 300
    assert sum("links" in t for t in tags) <= 12


def test_query_against_brute_force(spark, docs, none, real):
    for df in (docs, real):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        fps = [brute_fingerprint(t) for _, t in rows]
        groups = brute_groups(fps)
        least = {}
        for (i, _), g in zip(rows, groups):
            if i is not None:
                least[g] = min(least.get(g, i), i)
        want = sorted([(i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, groups)], key=str)
        out = simhash.near_groups(df).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
        assert sorted([tuple(r) for r in out.collect()], key=str) == want
    assert simhash.near_groups(none).count() == 0


def test_one_of_each(docs, none):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 not in ids and ids.count(7) == 2
    assert simhash.one_of_each(none).count() == 0
