import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.llm import ann
from hydrolake.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 1.0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, is_query, k):
    """Exact answers of a list of (id, vector), one vector per id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([np.asarray(v, np.float32) for _, v in rows], np.float64)
    out = {}
    for at in np.flatnonzero([is_query(i) for i in ids]):
        s = x @ x[at]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def assert_same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_all_cells_give_the_exact_answer(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=7)) for i in range(300)]
    # Copies in larger numbers than an answer holds, and a cell with many entries.
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, np.ones(7) + 1e-3 * rng.normal(size=7)) for i in range(200)]
    got = ann.nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, k=6, centroids=8, share=1.0, block=50, chunk=9)
    assert_same(answers(got), brute(rows, lambda i: i % 20 == 0, 6))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1, 0]), (20, [0, 1]), (3, [0.5, 0.5]), (4, [-1, 0])]
    bad = [(40, None), (60, [0, 0]), (80, [nan, 1]), (100, [1, inf]), (120, [1, None]), (140, [1, 2, 3]), (160, []), (None, [1, 1])]
    got = ann.nearest_neighbours(table(spark, good + bad + [good[0]]), F.col("vec_id") % 20 == 0, k=5)
    assert_same(answers(got), brute(good, lambda i: i % 20 == 0, 5))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30, 0, -1)] + [(40, [0.0, 1.0])]
    got = answers(ann.nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, k=4))
    assert [i for i, _ in got[20]] == [1, 2, 3, 4] and [i for i, _ in got[40]] == [1, 2, 3, 4]


def test_one_component_and_empty_table(spark):
    rows = [(i, [float(i + 1)]) for i in range(25)]
    assert_same(answers(ann.nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, k=3)), brute(rows, lambda i: i % 20 == 0, 3))
    empty = ann.nearest_neighbours(table(spark, rows).limit(0), F.col("vec_id") % 20 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_walk_meets_cells_in_order_of_their_sums():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=9), rng.normal(size=11)
    cells = ann.walk(a, b, np.ones(99, int), 99)
    sums = [a[c // 11] + b[c % 11] for c in cells]
    assert sorted(cells) == list(range(99)) and sums == sorted(sums)
    assert ann.walk(a, b, np.full(99, 5), 11) == cells[:3]


@pytest.mark.parametrize("n", [6000])
def test_recall(spark, n):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(n, 32)))]
    want = brute(rows, lambda i: i % 100 == 0, 20)
    got = answers(ann.nearest_neighbours(table(spark, rows), F.col("vec_id") % 100 == 0))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    # Fewer vectors than a query looks at in any case: the answer is exact.
    assert_same(answers(QUERIES["op9_multi_index"](spark, sf)), brute(rows, lambda i: i % 20 == 0, 20))
