import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hydrolake.llm import ngram_lm
from hydrolake.llm.queries import QUERIES
from tests.llm.conftest import words_of

RESULT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split(None) + [b"\0"]


def base(rows, train):
    c = Counter(t for text in train for t in tokens(text))
    n, v = c.total(), len(c)
    z = n + 0.5 * (v + 1)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / z) if n else 0.0 for w in tokens(t))) for _, t in rows]


def assert_base(out, rows, train):
    def key(x):
        return (x[0], x[1], round(x[3], 6))

    got = sorted(((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=key)
    want = sorted(base(rows, train), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) <= 1e-9 * max(1, abs(w[3]))


def some_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(words_of(rng, rng.randrange(0, 80), 900))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, " \x0b\x0c\r\n"), (203, "Word wORD é É"), (204, "a b " * 20_000), (204, "a b " * 20_000), (None, "x\x00y")]


def test_base_score_is_exact_with_and_without_joined_words(docs):
    rows = some_rows()
    table = docs(rows).withColumnRenamed("lang", "score")
    train = [t for i, t in rows if i is not None and i % 3]
    learn = table.where("doc_id % 3 != 0").select("text")
    for frequent in (10, 10**6):
        out = ngram_lm.scored(table, learn, frequent=frequent)
        assert out.columns == ["doc_id", "text", "source", "n_chars", *RESULT]
        assert_base(out.collect(), rows, train)


def test_model_prefers_texts_like_those_it_learnt(docs):
    rng = random.Random(7)
    phrases = [" ".join(words_of(rng, 6)) for _ in range(30)]
    learn = docs([" ".join(rng.choice(phrases) for _ in range(10)) for _ in range(200)]).select("text")
    alike = [" ".join(rng.choice(phrases) for _ in range(10)) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in alike]
    out = {r["doc_id"]: r for r in ngram_lm.scored(docs(alike + mixed), learn).collect()}
    assert min(out[i]["score"] for i in range(20)) > max(out[i]["score"] for i in range(20, 40))
    assert all(out[i]["score"] > out[i]["base_score"] for i in range(20))
    assert all(r["score"] < 0 for r in out.values())


def test_levels_read_from_the_filter_are_those_of_the_counts(spark, docs):
    rng = random.Random(1)
    texts = [" ".join(words_of(rng, 200, 60)) for _ in range(30)]
    table = docs(texts).select("text")
    model = ngram_lm.build(ngram_lm.unigram_counts(table), table, order=3, bits_per_key=64)
    token, doc = ngram_lm.tokens([t.encode() for t in texts])
    for n in (1, 2, 3):
        key, count = np.unique(ngram_lm.ngrams(token, doc, n)[0], return_counts=True)
        want = ngram_lm.level_of(count, model.base)
        assert (model.levels(key, np.full(len(key), model.most[n - 1])) == want).mean() > 0.999 and model.most[n - 1] == want.max()
        absent = model.levels(key ^ np.uint64(1), np.full(len(key), model.most[n - 1]))
        assert (absent > 0).mean() < 0.01
    assert 0 < model.filled < 0.5


def test_probabilities_of_a_history_sum_to_one_nearly(docs):
    rng = random.Random(9)
    texts = [" ".join(words_of(rng, 300, 40)) for _ in range(20)]
    table = docs(texts).select("text")
    model = ngram_lm.build(ngram_lm.unigram_counts(table), table, bits_per_key=64, base=1.05)
    vocabulary = sorted({w for t in texts for w in t.split()})
    total = 0.0
    for w in [*vocabulary, None]:
        token, doc = ngram_lm.tokens([f"{vocabulary[3]} {w}".encode() if w else vocabulary[3].encode()])
        total += 10 ** model.log10(token, doc)[1]
    assert abs(total - 1) < 0.1


def test_small_filter_keeps_base_and_finite_scores(docs):
    rows = some_rows()
    out = ngram_lm.scored(docs(rows), docs(rows).select("text"), most_bytes=1)
    assert_base(out.collect(), rows, [t for _, t in rows])
    assert all(math.isfinite(r["score"]) for r in out.collect())


def test_filter_grows_with_the_training_texts(spark):
    # Counts of a corpus of 160 million tokens, far more than 64 MB hold: only the sums decide the size.
    counts = spark.createDataFrame([(1, 160_000_000)], "key bigint, count bigint")
    model = ngram_lm.build(counts, spark.createDataFrame([], "text string"))
    assert model.blocks * ngram_lm.BLOCK_BITS * ngram_lm.PARTS >= 160_000_000 * ngram_lm.BITS_PER_KEY


def test_scores_from_parts_are_those_of_the_whole_filter(docs, monkeypatch):
    rows = some_rows()
    table = docs(rows)
    learn = table.where("doc_id % 3 != 0").select("text")
    for order in (2, 3):
        model = ngram_lm.build(ngram_lm.unigram_counts(learn), learn, order=order)
        for group in (50, ngram_lm.GROUP):
            monkeypatch.setattr(ngram_lm, "GROUP", group)
            got = ngram_lm.scored(table, learn, order=order, broadcast_bytes=0).collect()
            assert len(got) == len(rows)
            for r in got:
                want = model.log10(*ngram_lm.tokens([(r["text"] or "").encode()])).sum()
                assert abs(r["score"] - want) <= 1e-9 * max(1, abs(want))


def test_broadcast_filter_and_parts_give_the_same_scores(docs):
    rows = some_rows()
    table = docs(rows)
    learn = table.where("doc_id % 3 != 0").select("text")
    size = ngram_lm.whole_bytes(ngram_lm.build(ngram_lm.unigram_counts(learn), learn))
    for frequent in (10, 10**6):
        found = [ngram_lm.scored(table, learn, frequent=frequent, broadcast_bytes=n).collect() for n in (size, size - 1)]
        whole, parts = (sorted((r["n_tokens"], r["base_score"], r["score"]) for r in f) for f in found)
        assert len(whole) == len(rows) and np.allclose(whole, parts, rtol=1e-12, atol=0)


def test_columns_named_like_internal_ones_pass_through(docs):
    extra = ["_row", "_group", "_rare", "_times", "_score", "_base", "_known", "key", "count", "a.b"]
    table = docs(some_rows()[:30]).withColumns({c: F.lit(c) for c in extra})
    learn = table.select("text")
    for frequent, most in ((10, 0), (10**6, 0), (10, 2**30), (10**6, 2**30)):
        out = ngram_lm.scored(table, learn, frequent=frequent, broadcast_bytes=most)
        assert out.columns == [*table.columns, *RESULT]
        rows = out.collect()
        assert len(rows) == 30 and all(r[c] == c for r in rows for c in extra)


def test_empty_tables(docs):
    table = docs(["a b", ""])
    out = ngram_lm.scored(table, table.select("text").limit(0)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out] == [(0, 0, 0.0, 0.0)] * 2
    assert ngram_lm.scored(table.limit(0), table.select("text")).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_bloom_lm"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    assert_base(got, rows, [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
