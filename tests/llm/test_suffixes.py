import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.llm import suffixes
from hydrolake.llm.queries import QUERIES


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def hostile(rng):
    def noise(n, alphabet="abcdefgh é"):
        return "".join(rng.choice(alphabet) for _ in range(n))

    shared = [noise(n) for n in (30, 39, 40, 41, 60, 200)]
    rows = []
    for _ in range(120):
        parts = [noise(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 4)):
            piece = rng.choice(shared)
            low = rng.randrange(0, 12)
            parts += [piece[low:], noise(rng.randrange(0, 60))]
        rows.append("".join(parts))
    return rows + ["", None, "a" * 39, "a" * 40, "a" * 41, "ab" * 300, "ab" * 300, "x" * 5000, "short", "short", rows[0], rows[0], noise(30_000)]


@pytest.mark.parametrize("common", [10_000, 1])
def test_as_brute_force(docs, common):
    rows = hostile(random.Random(5))
    table = docs(rows).withColumnRenamed("lang", "n_spans")
    out = suffixes.remove_repeats(table, length=40, anchor=16, common=common)
    assert out.columns == ["doc_id", "source", "n_chars", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    for i, want in enumerate(brute(rows, 40)):
        assert got[i] == want, i


def test_small_bitmap_only_costs_time(docs):
    rows = hostile(random.Random(6))
    out = suffixes.remove_repeats(docs(rows), length=40, anchor=16, filter_bits=1 << 15)
    got = {r["doc_id"]: bytes(r["kept"]) for r in out.collect()}
    assert got == {i: w[3] for i, w in enumerate(brute(rows, 40))}


def strings_to_refine(length):
    rng = random.Random(length)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(300)).encode() * 3 + bytes(rng.randrange(256) for _ in range(500)), np.uint8)
    starts = np.unique([rng.randrange(len(data) - length + 1) for _ in range(400)])
    count = Counter(data[s : s + length].tobytes() for s in starts)
    return data, starts, [count[data[s : s + length].tobytes()] > 1 for s in starts]


@pytest.mark.parametrize("gram", [1, 3, 8, 50])
@pytest.mark.parametrize("length", [20, 33, 64, 200])
def test_refinement_finds_equal_strings(length, gram):
    data, starts, want = strings_to_refine(length)
    assert suffixes.repeated(data, starts, length, gram).tolist() == want
    assert suffixes.repeated(data, starts[:0], length, gram).tolist() == []


@pytest.mark.parametrize("gram", [8, 50])
def test_bytes_decide_where_hashes_agree(monkeypatch, gram):
    class Poor(suffixes.Rolling):
        def windows(self, width):
            return super().windows(width) % np.uint64(3)

    monkeypatch.setattr(suffixes, "Rolling", Poor)
    for length in (20, 64, 200):
        data, starts, want = strings_to_refine(length)
        assert suffixes.repeated(data, starts, length, gram).tolist() == want


def test_every_string_names_the_leftmost_smallest_anchor():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (10, 100, 0, 57, 200)] + [b"a" * 90]
    a = suffixes.Anchors(texts, 40, 16)
    named = {}
    for low, high, h, d in zip(a.low, a.high, a.hash, a.doc):
        for s in range(low, high + 1):
            named[d, s - a.begins[d]] = h
    grams = {}
    for d, t in enumerate(texts):
        data = np.frombuffer(t + b"\n", np.uint8)
        if len(t) >= 40:
            grams[d] = suffixes.Rolling(data).windows(16)
    want = {(d, s): grams[d][s : s + 25].min() for d, t in enumerate(texts) for s in range(len(t) - 39)}
    assert named == want


def test_columns_named_like_internal_ones_pass_through(docs):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    extra = ["_id", "_text_hash", "_spans", "low", "high", "digest", "a.b"]
    table = docs([text, text, "short"]).withColumns({c: F.lit(c) for c in extra})
    out = suffixes.remove_repeats(table)
    assert out.columns == [c for c in table.columns if c != "text"] + ["n_bytes", "n_removed", "n_spans", "kept"]
    rows = out.collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 300, 300] and all(r[c] == c for r in rows for c in extra)


def test_null_and_repeated_ids_and_empty_table(docs):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    out = suffixes.remove_repeats(docs([(None, text), (1, text), (1, text), (1, text[:150] + "!" + text[150:])])).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in out) == [("1", 300, 300), ("1", 300, 300), ("1", 301, 0), ("None", 300, 300)]
    assert suffixes.remove_repeats(docs(["x"]).limit(0)).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_suffix_buckets"](spark, sf).collect()}
    for (i, _), (n, gone, spans, kept) in zip(rows, brute([t for _, t in rows], 200), strict=True):
        assert got[i] == (n, gone, spans, hashlib.sha256(kept).hexdigest())
