import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from hydrolake.llm import toxicity
from hydrolake.llm.queries import QUERIES
from tests.llm.conftest import words_of

BAD = ["scumbag", "worthless", "idiotic", "garbagey"]


def corpus(n=500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words, bad = words_of(rng, rng.randrange(3, 300)), i % 5 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, docs):
    rows, labels = corpus()
    odd = [(900, None), (901, ""), (902, "word " * 30_000), (902, "word " * 30_000), (None, "scumbag " * 20_000 + "é😀"), (903, "a")]
    table = docs(rows + odd).withColumnRenamed("lang", "score")
    known = spark.createDataFrame([*labels, (7, None), (None, 1), (5000, 1)], "doc_id bigint, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(table, known, only=held != 0)
    out = toxicity.score(table, model)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "score"]
    got = [(r["doc_id"], r["score"]) for r in out.collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    test = [(score[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in test]) >= 0.97
    assert score[None] >= 0.5 and max(score[i] for i in (900, 901, 902)) < 0.5


def test_labels_of_one_class_or_none(spark, docs):
    table = docs(["some text here", "other text there"])
    for labels, want in (([(0, 1)], 1.0), ([(0, 0)], 0.0), ([], 0.0)):
        model = toxicity.train(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert all(abs(r["score"] - want) < 1e-9 for r in toxicity.score(table, model).collect())
    assert toxicity.score(table.limit(0), model).collect() == []


def test_counts_are_those_of_a_walk(spark, docs):
    rows, labels = corpus(40)
    joined = docs(rows).join(spark.createDataFrame(labels, "doc_id bigint, label bigint"), "doc_id").select("text", "label")
    counts, totals = toxicity.ratio_counts(joined, (3,), 1 << 12)
    want = np.zeros((2, 1 << 12))
    for (_, text), (_, y) in zip(rows, labels):
        want[y, sorted(set(toxicity.features([text], (3,), 1 << 12)[0].tolist()))] += 1
    assert (counts == want).all() and totals.tolist() == [32, 8]


def test_features_are_a_set_of_ngrams():
    ids, owners = toxicity.features(["abcabcabc", "", "ab", "ABCabc\t abc"], (3,), 1 << 20)
    # " ab", "abc", "bca", "cab", "bc "; " " twice is one blank; " ab", "ab "
    assert np.bincount(owners, minlength=4).tolist() == [5, 0, 2, 6]


def test_query(spark):
    # The smallest scale has eleven toxic documents, too few to learn from.
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p == y for p, y in held]) >= 0.95
    assert np.mean([p for p, y in held if not y]) <= 0.02
