import random
import re
import time

from lexspan.operators import privacy

PATTERNS = [re.compile(privacy.PATTERNS[k], re.ASCII) for k in privacy.KINDS]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            s, e = m.span()
            if k == privacy.CARD:
                twice = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(m[0]))]
                if sum(x - 9 if x > 9 else x for x in twice) % 10:
                    continue
            if all(e <= a or b <= s for j, a, b in out if j < k):
                out.append((k, s, e))
    return sorted(out, key=lambda x: x[1])


def test_random_texts():
    rng = random.Random(6)
    pool = ["13812345678", "11010119900101123", "X", "x", "4111111111111111", "6222021234567890128", "91110108MA01ABCD2E", "91110108551385082Q", "a.b@c.de", "@", "a@b", ".com", "x@y.zz@w.co", " ", "1", "é", "文", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert privacy.accepted(text) == brute(text), text


def test_masks():
    masks = {"a@b.co": "a***@b.co", "abcd@b.co": "ab***@b.co"}
    assert {v: privacy.mask(privacy.MAIL, v) for v in masks} == masks
    assert [privacy.mask(k, "123456789012345678") for k in (0, 1, 3, 4)] == ["123456****5678", "123****5678", "1234****5678", "123456****5678"]
    text = "tel 13812345678, mail abcd@b.co."
    assert privacy.masked(text, privacy.accepted(text)) == "tel 138****5678, mail ab***@b.co."


def test_a_text_of_a_hundred_thousand_identifiers():
    text = " ".join(f"u{i}@mail.example.com" if i % 2 else f"138{i:08d}" for i in range(100_000)) + "b" * 1_000_000 + "1" * 1_000_000
    began = time.time()
    spans = privacy.accepted(text)
    assert sum(k < privacy.CARD for k, _, _ in spans) == 100_000 and privacy.masked(text, spans).count("****") == 50_000 + 1_000_000 // 18
    assert time.time() - began < 60


def test_rows(spark):
    rows = [(1, "a@b.co 13812345678", "clash"), (1, "a@b.co 13812345678", "clash"), (None, None, "clash"), (3, "", "clash"), (4, "none", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, masked string")
    got = [tuple(r) for r in privacy.pii_spans(df).collect()]
    assert sorted(got) == sorted([(1, "邮箱", 0, 6, "a***@b.co"), (1, "手机号", 7, 18, "138****5678")] * 2)
    got = privacy.masked_texts(df).collect()
    assert [tuple(r) for r in got] == [(1, "a***@b.co 138****5678", 2, "手机号码、电子邮箱")] * 2 + [(None, None, 0, None), (3, "", 0, None), (4, "none", 0, None)]
    assert "Exchange" not in privacy.masked_texts(df)._jdf.queryExecution().toString()
    assert privacy.pii_spans(df.limit(0)).isEmpty()
