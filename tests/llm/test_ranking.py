import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrolake.llm import ranking
from hydrolake.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k=20):
    """Every score of every document, in whole numbers."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 29), st.integers(1, 5), max_size=30), max_size=6), st.integers(1, 6), st.integers(1, 12), st.integers(1, 4))
def test_bounds_resolve_membership_ties_and_scores(lists, k, floor, depth):
    sorted_lists, total = [], Counter()
    for x in lists:
        total.update(x)
        order = sorted(x.items(), key=lambda e: (-e[1], e[0]))
        sorted_lists.append((np.array([d for d, _ in order], np.int64), np.array([v for _, v in order], np.int64)))
    want = sorted(((-s, d) for d, s in total.items() if s >= floor))[:k]
    best, scores = ranking.nra(sorted_lists, 30, k, floor, depth)
    assert [(-s, d) for d, s in zip(best.tolist(), scores.tolist())] == want


def test_reading_stops_early():
    class Counted(np.ndarray):
        most = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.most = max(Counted.most, at.stop or 0)
            return super().__getitem__(at)

    docs = np.arange(10_000)
    impacts = np.concatenate([[1000] * 5, np.ones(9995, np.int64)])
    best, _ = ranking.nra([(docs.view(Counted), impacts)] * 2, 10_000, 5, depth=8)
    assert best.tolist() == [0, 1, 2, 3, 4] and Counted.most == 8


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(60)] + ["ñandú", "the", "THE", "x9"]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.randrange(2, 64)]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(1, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # ties
    docs += [(5, docs[5][1]), (None, docs[9][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, "?!"), (2003, "the " * 30_000), (-3, "The ñandú x9")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    return docs, [*items, (100, None), (101, ""), (102, "unheard of"), (None, "the ñandú"), (104, "w3 w3 W3 w4")]


@pytest.mark.parametrize("postings, block", [(ranking.POSTINGS, ranking.BLOCK), (500, 40)])
def test_as_brute_force(spark, monkeypatch, postings, block):
    monkeypatch.setattr(ranking, "POSTINGS", postings)
    docs, items = corpus(random.Random(4))
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, score int, rank string").repartition(4)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int").repartition(2)
    out = ranking.rank(table, asked, block=block)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, items)


def test_equal_queries_are_ranked_each(spark):
    table = spark.createDataFrame([("b", "one two"), ("a", "one"), ("c", "three")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "one"), (1, "one")], "item_id int, text string")
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in ranking.rank(table, asked, k=1).collect()]
    assert got == [(1, 1, "a")] * 2


def test_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert ranking.rank(docs(["one"]).limit(0), asked).collect() == []
    assert ranking.rank(docs(["one"]), asked.limit(0)).collect() == []
    assert ranking.rank(docs([None, ""]), asked).collect() == []


def test_query_matches_sql(spark, duck, sf):
    assert compare(spark, duck, QUERIES["op13_nra_search"], ORACLES["op13_nra_search"], sf) == ""
