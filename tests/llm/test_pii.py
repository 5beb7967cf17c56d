import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from hydrolake.llm import pii
from hydrolake.llm.queries import QUERIES

# The patterns as they are written in the contract; slow on long runs.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and checksum(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def personal(rng):
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    card = digits(15)
    card += next(d for d in "0123456789" if checksum(card + d))
    return [
        f"{rng.choice(['ann', 'bob', 'eve'])}.{digits(2)}@mail{digits(1)}.example.com",
        ".".join(str(rng.randrange(1, 256)) for _ in range(4)),
        card,
        f"+1 ({digits(3)}) 555-{digits(4)}",
    ]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = []
    for _ in range(150):
        body = [f"w{rng.choice('abcdefgh')}rd" for _ in range(rng.randrange(4, 40))]
        for p in rng.sample(personal(rng), rng.randrange(0, 3)):
            body.insert(rng.randrange(len(body)), p)
        out.append(" ".join(body))
    return out


@pytest.fixture(scope="module")
def field(texts):
    return pii.learn(pii.examples_of(texts))


def test_base_spans_are_those_of_the_patterns(texts):
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab@@..--__ 00123456789++()é😀\n%") for _ in range(rng.randrange(45))) for _ in range(8000)]
    for text in [*texts, *odd, "1.2.3.4.5.6.7.8", "a@b.cd@e.f", "a@b.c_d@e.f", "0000255.1.1.1", "1.1.1.256"]:
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for unit in ("1", "a", "@", "a@", "1.", "+1 ", "1 ", "(", "a@b.", "dot ", "1-2 "):
        pii.base_spans(unit * 200_000)
    assert len(list(pii.stretches("12 " * 3000))) == 1


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("please call (415) 555-0137 today", "phone", "(415) 555-0137"),
        ("tel 415-555-0137.", "phone", "415-555-0137"),
        ("write to ann.12 at mail3 dot example dot com now", "email", "ann.12 at mail3 dot example dot com"),
        ("bob [at] mail [dot] example [dot] org", "email", "bob [at] mail [dot] example [dot] org"),
        ("host 10[.]2[.]33[.]4 is up", "ip", "10[.]2[.]33[.]4"),
        ("pay 4111.1111.1111.1111 soon", "card", "4111.1111.1111.1111"),
        ("at +1 (269) 555-3296 4532015112830366 and", "card", "4532015112830366"),
    ],
)
def test_field_adds_what_patterns_miss(field, text, kind, span):
    base, spans = pii.all_spans(text, field)
    assert (kind, span) in [(pii.KINDS[k], text[a:b]) for a, k, b in spans]


@pytest.mark.parametrize("text", ["", "on 2021-03-04 we", "pay 4111.1111.1111.1112 soon", "256[.]1[.]1[.]1", "id 12345678 of", "password=135299847ac0e0f0dc", "we sat at home dot", "in 1999 and 2004"])
def test_field_leaves_the_rest_alone(field, text):
    assert pii.all_spans(text, field) == ([], [])


def test_base_spans_stay_and_added_ones_do_not_overlap(field, texts):
    for text in texts:
        base, spans = pii.all_spans(text, field)
        assert base == brute(text) and set(base) <= set(spans)
        for a, _, b in set(spans) - set(base):
            assert all(b <= s or e <= a for s, _, e in base)


def labellings(s):
    """All sets of segments of a stretch that do not overlap."""
    for n in range(4):
        for some in itertools.combinations(range(len(s.segments)), n):
            if all(s.segments[x][1] <= s.segments[y][0] or s.segments[y][1] <= s.segments[x][0] for x, y in itertools.combinations(some, 2)):
                yield some


def test_dynamic_programming_against_all_labellings():
    rng = np.random.default_rng(2)
    text = "(41) 55 5013 7.1.2.3"
    s = next(pii.stretches(text))
    assert 10 < len(s.segments) < 60
    weights = {(f, k): float(rng.normal()) for _, _, k, names in s.segments for f in names}
    field = pii.Field(weights, rng.normal(size=(4, 4)))
    score = field.scores(s)

    def value(some):
        order = sorted(some, key=lambda x: s.segments[x][0])
        follow = sum(field.follow[s.segments[x][2], s.segments[y][2]] for x, y in itertools.pairwise(order) if s.segments[x][1] == s.segments[y][0])
        return sum(score[x] for x in some) + follow

    every = list(labellings(s))
    best = max(every, key=value)
    want = sorted((s.spans[s.segments[x][0]][0], s.segments[x][2], s.spans[s.segments[x][1] - 1][1]) for x in best)
    assert field.decode(s) == want
    chance, _ = pii.expected(s, score, field.follow)
    z = sum(np.exp(value(v)) for v in every)
    for x in range(len(s.segments)):
        assert abs(chance[x] - sum(np.exp(value(v)) for v in every if x in v) / z) < 1e-9


def test_every_way_to_write_an_address_has_a_candidate():
    forms = set()
    for seed in range(300):
        new, good = pii.rewritten("john.smith@example.com", pii.EMAIL, random.Random(seed))[0]
        forms.add(new)
        text = "x" * 200 + f" write to {new} today " + "x" * 200
        at = text.index(new)
        spans = {(s.spans[i][0], s.spans[j - 1][1]) for s in pii.stretches(text) for i, j, k, _ in s.segments if k == pii.EMAIL}
        assert good and (at, at + len(new)) in spans, new
    assert len(forms) == 7 and "john.smith at example.com" in forms


def test_odd_rows_and_clashing_names(docs, field, texts):
    rows = [None, "", texts[0], texts[0], "1 " * 20_000 + "é a@b.co", "é😀 a@b.co"]
    out = pii.find(docs(rows).withColumnRenamed("lang", "spans"), field)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "base", "spans"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in enumerate(rows):
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in got[i]["base"]] == brute(text or "")
    assert pii.find(docs(["x"]).limit(0), field).collect() == []


def test_sample_takes_copies_once_and_every_sort(docs):
    rows = ["copied text, call 555 1234 now"] * 300
    rows += [f"own {i}, mail u{i}@example.com" for i in range(30)] + [f"host 10.0.{i % 9}.{i} up" for i in range(30)] + [f"call +1 202 555 01{i}" for i in range(10, 40)]
    rows.append(" ".join(f"number {i} " + "word " * 40 for i in range(100, 120)) + "mail far@example.com")
    got = pii.neighbourhoods(docs(rows), sample=24)
    assert len(got) == len(set(got)) == 24
    for sign in ("@", "10.0.", "+1 202"):
        assert sum(sign in x for x in got) >= 5, sign
    assert sum("copied" in x for x in got) <= 1


def test_training_on_nothing(docs):
    assert pii.train(docs(["no data here", None])).weights == {}
    assert pii.train(docs(["x"]).limit(0)).weights == {}


def test_query(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_semi_crf_pii"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r["doc_id"]])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
