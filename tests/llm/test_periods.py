import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydrolake.llm import periods
from hydrolake.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def brute(words):
    """All runs, by comparing words at every distance."""
    runs = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and all(any(words[i + t] != words[i + t + p] for t in range(length - p)) for p in range(1, q)):
                runs.append((i, length, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {t for i, n, q in runs for t in range(i + q, i + n)}
    return " ".join(w for t, w in enumerate(words) if t not in gone)


def found(texts):
    ids, firsts, known = [], [0], {}
    for t in texts:
        ids += [known.setdefault(w, len(known)) for w in t]
        firsts.append(len(ids))
    begin, length, period = periods.runs_of(np.array(ids, np.int64), np.array(firsts))
    doc = np.searchsorted(firsts, begin, "right") - 1
    out = [[] for _ in texts]
    for d, b, n, q in zip(doc.tolist(), begin.tolist(), length.tolist(), period.tolist()):
        out[d].append((b - firsts[d], n, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=5))
def test_runs_over_two_words(texts):
    assert found(texts) == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 8), st.lists(st.sampled_from("abcd"), max_size=4)), max_size=5))
def test_planted_runs(parts):
    words = [w for unit, times, tail in parts for w in unit * times + unit[: len(unit) // 2] + tail]
    assert found([words, words]) == [brute(words)] * 2


@pytest.mark.parametrize("q", [*range(1, 40), 63, 64, 65, 127, 128, 129])
@pytest.mark.parametrize("before", [0, 1, 3, 5, 6])
def test_shortest_run_of_each_period_at_any_place(q, before):
    unit = [f"w{i}" for i in range(q)]
    words = [f"b{i}" for i in range(before)] + (unit * 6)[: max(6, 4 * q)] + ["z"]
    assert found([words]) == [[(before, max(6, 4 * q), q)]]
    words.remove("w0")  # one word less is no run
    assert found([words]) == [[]]


def test_successor_as_sorted_lists():
    rng = np.random.default_rng(1)
    values = rng.permutation(500).astype(np.int32)
    lo = rng.integers(0, 500, 400)
    hi = np.minimum(500, lo + rng.integers(0, 80, 400))
    x = rng.integers(-1, 500, 400).clip(0)
    want = [min((v for v in values[a:b].tolist() if v > c), default=-1) for a, b, c in zip(lo, hi, x)]
    assert periods.Wavelet(values).successor(lo, hi, x).tolist() == want


def test_operator_on_odd_texts(spark, docs):
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "no no no no no no",
        "no\tno\nno  no\r\nno \x0bno yes",
        "nó nó nó nó nó nó NÓ",
        "a b " * 3 + "a",
        "a b " * 4,
        "x y " * 6,  # no ASCII space: one word
        "a b c " * 4000,
        " ".join(f"w{i % 7}" for i in range(30_000)),
        "a a a a a a b " * 5,
        "dup dup dup dup dup dup dup",
        "dup dup dup dup dup dup dup",
    ]
    table = docs(texts).withColumnRenamed("lang", "runs").withColumn("_id", F.lit(7))
    out = periods.collapse(table)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "_id", "n_words", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        words = split(t)
        want = [(0, 12000, 3)] if i == 10 else [(0, 30000, 7)] if i == 11 else brute(words)
        assert rows[i]["text"] == t and rows[i]["_id"] == 7 and rows[i]["n_words"] == len(words)
        assert [tuple(r) for r in rows[i]["runs"]] == want
        assert rows[i]["collapsed"] == kept(words, want)
    assert periods.collapse(table.limit(0)).collect() == []


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choice("abcde"[: 1 + i % 5]) * rng.randrange(1, 3) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (None, "a " * 9), (7, "x " * 50), (7, "x " * 50), (-5, "p q r s t " * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    want, planted = [], 0
    for i, text in rows:
        words = split(text)
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if t < a else words[a + (t - a) % p] for t, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *first, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(kept(words, runs))))
    assert got == sorted(want, key=repr) and planted > 10 and sum(w[1] for w in want) > 20
