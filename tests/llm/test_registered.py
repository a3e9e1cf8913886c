"""The registered queries op2 to op9 as they are registered, over whole tables, against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lexspan.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    assert found
    return found


def luhn(digits):
    twice = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_op2(spark, texts):
    for r in rows(spark, "op2_pii"):
        spans = base_spans(texts[r["doc_id"]])
        told = [f"{kind}:{s}:{e}" for s, _, kind, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) - {""} <= set(r["spans"].split(","))
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(x[2] == k for x in spans) for k in ("email", "ip", "card", "phone"))


def test_op3(spark, texts):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: crc(i) % 7 == 2 for i in texts}
    counts = Counter(t for i, own in tokens.items() if not held[i] for t in own)
    total, kinds = sum(counts.values()), len(counts)
    found = rows(spark, "op3_lm_scoring")
    assert len(found) == len(texts)
    for r in found:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(counts[t] > 0 for t in own), total)
        want = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["score"] < 0
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # the model tells more than the base does


def test_op4(spark, texts):
    for r in rows(spark, "op4_quality"):
        t = texts[r["doc_id"]]
        words = WORD.findall(t)
        seen, twice = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), twice, len(covered), failed), r["doc_id"]
        assert not (failed and r["kept"])


def test_op5(spark, texts):
    prints = {}
    for i, t in texts.items():
        words = WORD.findall(t.translate(LOWER))
        runs = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op5_simhash")} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op6(spark):
    found = rows(spark, "op6_mixing")
    slots = {}
    for r in found:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
    assert sorted(slots) == list(range(len(slots)))
    weights = {s: Fraction(str(queries.TARGETS.get(s, queries.DEFAULT_TARGET))) for s in set(slots.values())}
    total, had, ends = sum(weights.values()), Counter(), {s: max(t for t, x in slots.items() if x == s) for s in weights}
    for t in range(min(ends.values())):  # while all sources last
        had[slots[t]] += 1
        assert all(abs(had[s] - (t + 1) * w / total) < 1 for s, w in weights.items())


def test_op7(spark, texts):
    found = rows(spark, "op7_sharding")
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    slots = defaultdict(list)
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op8(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for i, data in pages.items():
        last[data] = max(i, last.get(data, i))
    got = {r["page_id"]: tuple(r)[1:] for r in queries.QUERIES["op8_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == {i: (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if last[d] == i else "revisit", None if last[d] == i else last[d]) for i, d in pages.items()}


def test_op9(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, lengths = {}, 0
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        lengths += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    found = rows(spark, "op9_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-lengths // 2048) + 1
