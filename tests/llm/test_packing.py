import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(rows, doc_rows):
    """Holds pieces against the tokenizer, and sequences against overlaps and gaps."""
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in doc_rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.place))
    for x in sequences.values():
        x.sort()
        assert [o for o, _, _ in x] == [sum(n for _, n, _ in x[:k]) for k in range(len(x))]
        assert [p for _, _, p in x] == list(range(len(x))) and sum(n for _, n, _ in x) <= 2048
    return len(sequences)


def test_hard_texts(docs, none):
    doc_rows = [(r.doc_id, r.text) for r in docs.collect()]
    whole(packing.pack(docs, PATH).collect(), doc_rows)
    assert packing.pack(none, PATH).count() == 0


def test_real_texts_pack_tightly(real):
    rows = packing.pack(real, PATH).collect()
    used = whole(rows, [(r.doc_id, r.text) for r in real.collect()])
    least = -(-sum(r.length for r in rows) // 2048)
    assert used <= 1.01 * least + 1


def test_chunks_are_encoded_as_the_whole_text_is():
    encoder = packing.ChunkEncoder(PATH, room=3)
    tokenizer = Tokenizer.from_file(PATH)
    for text in ("It's  a test of é ́x\n\n\tΣΟΦΟΣ ΣΑΣ. <|endoftext|> y", "a b a b 12 345", "́", " ", "\r\nq\x0bw\x1ce\x85r", "<|ENDOFTEXT|> End. End.. a,, 3. É. é, x.\ny,", "E\u0301. e\u0301, \x01 mark", "", "İstanbul K Å ﬁ. it's, we'll."):
        assert encoder.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_nnls_finds_an_exact_mix():
    rng = np.random.default_rng(0)
    a = rng.random((20, 50))
    x = np.zeros(50)
    x[[3, 17, 30]] = 1, 2, 3
    assert np.allclose(a @ packing.nnls(a, a @ x), a @ x, atol=1e-6)


def test_plan_uses_every_length_and_stays_small():
    rng = np.random.default_rng(3)
    for size in (1, 2, 10, 500, 20_000, 2_000_000):
        lengths, counts = np.unique(np.minimum(2048, rng.lognormal(6, 1.1, size).astype(int) + 1), return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist()))
        shapes = packing.plan(histogram)
        used = Counter()
        for lens, times in shapes:
            assert sum(lens) <= 2048 and times > 0
            for n in lens:
                used[n] += times
        assert used == Counter(histogram)
        assert len(shapes) <= 8 * 2048
        if size >= 500:
            assert sum(t for _, t in shapes) <= 1.02 * sum(n * c for n, c in histogram.items()) / 2048 + 1


def laid_out(shapes, n):
    """The places of all pieces of a length, each laid out and sorted by when its sequence comes."""
    base, out = 0, []
    for shape, (lengths, times) in enumerate(shapes):
        offset = 0
        for place, x in enumerate(lengths):
            if x == n:
                out += [((k + shape * 0.6180339887498949 % 1) / times, (shape, place), k, (base + k, offset, place)) for k in range(times)]
            offset += x
        base += times
    return [row for *_, row in sorted(out)]


def test_ordered_places_are_found_without_laying_all_out():
    rng = np.random.default_rng(3)
    shapes = [(tuple(int(x) for x in rng.integers(1, 5, rng.integers(1, 5))), int(t)) for t in [1, 1, 2, 3, 7, 50, 1000, 1001, 333, 40]]
    places = packing.Places(shapes)
    for n in range(1, 5):
        want = laid_out(shapes, n)
        everything = np.arange(len(want))
        assert places.along(np.full(len(want), n), everything).tolist() == [list(x) for x in want]
        some = rng.permutation(everything)[: len(want) // 50]
        assert places.along(np.full(len(some), n), some).tolist() == [list(want[r]) for r in some]
    assert places.along(np.array([], np.int64), np.array([], np.int64)).shape == (0, 3)


def test_a_batch_costs_its_own_places():
    """A length with ten thousand million pieces."""
    places = packing.Places([((7, 7), 10**9), ((7,), 8 * 10**9), ((7, 3), 3)])
    ranks = np.array([0, 5, 5 * 10**9, 5 * 10**9 + 1, 10**10 + 2])
    found = places.along(np.full(5, 7), ranks)
    assert len({tuple(x) for x in found.tolist()}) == 5 and (np.diff(ranks) > 0).all()


def test_files_are_taken_by_number(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x") for i in range(6)], "doc_id long, text string")
    for i in range(6):
        rows.where(f"doc_id = {i}").coalesce(1).write.parquet(str(tmp_path / f"one{i}"))
    folder = tmp_path / "all"
    folder.mkdir()
    for i, number in enumerate((3, 20, 99_999, 100_000, 100_001, 1_000_000)):
        part = next((tmp_path / f"one{i}").glob("part-*.parquet"))
        part.rename(folder / f"part-{number:05d}-x.parquet")
    docs, at, total = packing.in_order(spark.read.parquet(str(folder)), "files")
    assert total == 6 and sorted((r["at"], r["doc_id"]) for r in docs.select(at.alias("at"), "doc_id").collect()) == [(i, i) for i in range(6)]
