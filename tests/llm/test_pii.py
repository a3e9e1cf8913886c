import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from lexspan.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)), [sum(x[3] == kind for x in out) for kind in BASE]


def test_base_against_brute_force(spark, docs, real):
    rng = random.Random(1)
    hard = [
        "a@b.c_d@e.f.g@h.i x@y x@y.z. 😀 é@b.c +1 (017) 555-7713, +1(2)3", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0003.4 1.2.3", "4111 1111-1111 1111 41111111111111111", "9" * 5000, "a" * 60_000 + "@" + "b.c",
        "+1 " + "2 " * 3000, "4111111111111111@x.com 1.2.3.4@5.6", "+4111111111111111", "é4111111111111111é\n192.168.0.1", "9 " * 4000,
        "1.2.3.4 a@b.c 😀 192.168.10.20 x99999 " * 700, "1.1." * 3000, "a." * 2000, "a1b@" * 1000,
    ]
    hard += ["".join(rng.choice("1234567890+-. @ab()é😀") for _ in range(200)) for _ in range(300)]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    for df in (docs, real, more):
        got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(df).collect())
        want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text)[0].encode()).hexdigest(), *brute(r.text)[1]) for r in df.select("doc_id", "text").collect())
        assert got == want


def brute_patterns(text, a, b):
    """Patterns of the span a..b by plain string work."""
    words = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[0-9]+", "0", x.lower())) if w]
    before, after = ["<", "<", *words(text[max(0, a - 80) : a])][-2:], (words(text[b : b + 40]) or [">"])[0]
    return {f"L1 {before[1]}", f"L2 {before[0]} {before[1]}", f"B {before[1]} _ {after}"}


def brute_discover(rows):
    """Added spans (text number, start, end, kind) by the definition, over dictionaries."""
    seen = []
    for k, (_, t) in enumerate(rows):
        t = t or ""
        base = [tuple(x.split(":")) for x in brute(t)[0].split(",") if x]
        base = [(kind, int(a), int(b)) for kind, a, b in base]
        seen += [(k, a, b, t[a:b].lower(), kind, brute_patterns(t, a, b)) for kind, a, b in base]
        for m in re.finditer(r"[A-Za-z0-9._%+/@:-]+", t):
            token = re.sub(r"^[._%+/@:-]+|[._%+/@:-]+$", "", m[0])
            a = m.start() + len(m[0]) - len(m[0].lstrip("._%+/@:-"))
            b, ahead = a + len(token), m[0].lstrip("._%+/@:-")
            if token and ("@" in ahead or sum(c in "0123456789" for c in ahead) >= 5) and not any(x < b and a < y for _, x, y in base):
                seen.append((k, a, b, token.lower(), None, brute_patterns(t, a, b)))
    graph = defaultdict(set)
    seed = {}
    for _, _, _, v, kind, ps in seen:
        for p in ps:
            graph[p].add(v)
            if kind:
                seed[p, v] = max(kind, seed.get((p, v), ""))
    seeds = {(v, kind): 1.0 for (_, v), kind in seed.items()}
    scores = dict(seeds)
    for _ in range(pii.ROUNDS):
        sure = {}
        by = defaultdict(list)
        for (v, kind), x in scores.items():
            by[v].append((kind, x))
        for p, vs in graph.items():
            mass, support = defaultdict(float), Counter()
            for v in vs:
                for kind, x in by[v]:
                    mass[kind] += x
                    support[kind] += x >= pii.ACCEPT
            sure.update({(p, kind): m / (len(vs) + 1) for kind, m in mass.items() if support[kind] >= pii.SEEDS and m / (len(vs) + 1) >= pii.CONFIDENT})
        wrong = defaultdict(lambda: 1.0)
        for (p, kind), c in sure.items():
            for v in graph[p]:
                if (p, v) not in seed:
                    wrong[v, kind] *= 1 - min(c, 0.999)
        scores = seeds | {key: 1 - w for key, w in wrong.items() if key not in seeds}
        scores |= {key: max(1 - w, scores[key]) for key, w in wrong.items() if key in seeds}
    out = {}
    for k, a, b, v, kind, ps in seen:
        if kind is None:
            for p in ps:
                for (q, c_kind), c in sure.items():
                    if p == q and scores.get((v, c_kind), 0) >= pii.ACCEPT:
                        out[k, a, b] = max(out.get((k, a, b), (0, 0, "")), (scores[v, c_kind], c, c_kind))
    return {(*at, x[2]) for at, x in out.items()}


def planted(seed, n=250):
    """Texts whose cards, phones and mails stand in contexts of their kind, in the base forms and in others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if rng.random() < 0.7 else rng.choice([".".join(d[i : i + 4] for i in (0, 4, 8, 12)), "/" + number(16) + "."])

    forms = {
        "card number is": card, "call me at": lambda: f"+{number(11)}" if rng.random() < 0.7 else f"{number(3)}-{number(4)}-{number(4)}",
        "write to": lambda: f"{word()}{number(2)}@{word()}.{word()}" if rng.random() < 0.7 else f"{word()}@{word()}{number(1)},", "order": lambda: number(8),
    }
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            lead, make = rng.choice(list(forms.items()))
            parts += [word(), word(), lead, make(), rng.choice(["and", "now", "....."])]
        rows.append((i, " ".join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 1, rows[0][1]), (None, rows[1][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_against_brute_force(spark, seed):
    rows = planted(seed)
    want = brute_discover(rows)
    assert len(want) > 50 and len({x[3] for x in want}) == 3
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    added = {k: [] for k in range(len(rows))}
    for k, a, b, kind in want:
        added[k].append((a, pii.KINDS.index(kind), b, kind))
    told = []
    for k, (i, t) in enumerate(rows):
        base = [x.split(":") for x in brute(t)[0].split(",") if x]
        spans = sorted([(int(a), pii.KINDS.index(kind), int(b), kind) for kind, a, b in base] + added[k])
        told.append((str(i), ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans), len(added[k])))
    assert sorted((str(r.doc_id), r.spans, r.n_added) for r in out) == sorted(told)


def test_real_texts_against_brute_force(spark, real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    want = Counter(rows[k][0] for k, *_ in brute_discover(rows))
    got = Counter({r.doc_id: r.n_added for r in pii.find(real).collect() if r.n_added})
    assert got == want


def test_long_texts_cost_in_proportion(spark):
    """300,000 identifiers in one text, and long runs that hold none; comparing each with each would take an hour."""
    rows = [(1, " ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(300_000))), (2, "a." * 600_000), (3, "id " + "x-" * 200 + "12345")]
    began = time.time()
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_ip == 300_000 and out[2].spans == "" and time.time() - began < 240
    found = pii.scan(spark.createDataFrame(rows[2:], "doc_id long, text string")).first().seen
    assert [(x.s, x.e) for x in found] == [(3, 408)]


@pytest.fixture
def cards(spark):
    good = [f"41111111111{i:04d}" for i in range(10_000)]
    good = [g for g in (d + c for d in good for c in "0123456789") if luhn(g)][:12]
    rows = [(i, f"my card number is {g} and that is all") for i, g in enumerate(good)]
    rows += [(100, "his card number is 4111.1111.1111.1111 and so on"), (101, "my card number is 99998888777766 and that"), (102, "card number is mine"), (103, "order 99998888777766 of the day")]
    rows += [(200 + i, f"order {70000000 + i} of the day") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_discover_unseen_identifiers(cards):
    out = {r.doc_id: r for r in pii.find(cards).collect()}
    assert out[100].spans == "card:19:38" and out[101].spans == "card:18:32"
    assert out[100].n_card == 0 and out[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    # the same number in another context stays, and so do numbers of other contexts
    assert out[103].spans == "" and all(out[200 + i].spans == "" for i in range(20))
    assert out[0].spans == "card:18:34" and out[0].n_added == 0


def test_empty(none, cards):
    assert pii.find(none).count() == 0
    assert pii.find(cards.where("doc_id < 0")).count() == 0


def test_main_path_is_native(cards):
    assert not re.search("Python|Pandas|Arrow", pii.find(cards)._jdf.queryExecution().toString())
