import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from hydrolake.llm import decontaminate as D
from hydrolake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import words_of
from tests.oracle import compare


def fixture(spark, docs):
    rng = random.Random(6)
    items = [(i, " ".join(words_of(rng, n))) for i, n in enumerate([30, 40, 13, 9, 7, 5, 0, 25])]
    items += [(50, None), (51, items[0][1])]
    rows, leaks = [(i, " ".join(words_of(rng, rng.randrange(5, 200)))) for i in range(40)], set()
    for i, item in enumerate([0, 1, 2, 3, 4, 7]):
        for k in range(3):
            words = items[item][1].split()
            if k == 1:  # every sixth word replaced
                words = [f"other{j}" if j % 6 == 4 else w for j, w in enumerate(words)]
            if k == 2:  # capitals and punctuation
                words = [w.upper() + ("," if j % 3 else ".\n") for j, w in enumerate(words)]
            d = 100 + 10 * i + k
            filler = words_of(rng, 60)
            rows.append((d, " ".join(filler[:30] + words + filler[30:])))
            if k != 1 or len(words) >= 25:
                leaks.add((d, item))
    leaks |= {(d, 51) for d, i in leaks if i == 0}
    rows += [(900, None), (901, ""), (902, "word " * 20_000), (903, rows[-1][1]), (903, rows[-1][1])]
    leaks.add((903, 7))
    return docs(rows), spark.createDataFrame(items, "item_id bigint, text string"), leaks, rows


@pytest.mark.parametrize("room", [D.BROADCAST_BYTES, 0])
def test_leaks_are_found_and_nothing_else(spark, docs, room):
    table, bench, leaks, _ = fixture(spark, docs)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(table, bench, broadcast_bytes=room).collect()}
    assert leaks <= got
    # Beyond the certain ones only the same passages with substitutions.
    assert all(100 <= d < 200 and d % 10 == 1 for d, _ in got - leaks)


def test_repeated_ids_give_the_same_on_both_paths(spark, docs):
    rng = random.Random(4)
    item, other = (" ".join(words_of(rng, 20)) for _ in range(2))
    long = " ".join(words_of(rng, 80))
    table = docs([(1, f"{long} {item}"), (1, f"{long} {item}"), (2, f"{long} {item}"), (2, "short one"), (2, f"{other} x"), (None, item), (None, f"y {other}")])
    bench = spark.createDataFrame([(7, item), (7, other), (7, "a b c d e f"), (None, other)], "item_id bigint, text string")
    near, far = (sorted(map(tuple, D.contaminated(table, bench, broadcast_bytes=room).collect()), key=str) for room in (D.BROADCAST_BYTES, 0))
    assert near == far and len(near) >= 4


def brute(doc, item, width=D.WIDTH, least=D.LEAST):
    """Whether a window of the item agrees with the document on some alignment, without any seed."""
    need = min(width, len(item))
    for shift in range(-len(item), len(doc)):
        same = [item[t] == doc[t + shift] for t in range(max(0, -shift), min(len(item), len(doc) - shift))]
        if any(sum(same[i : i + need]) >= math.ceil(need * least - 1e-9) for i in range(len(same))):
            return True
    return False


@pytest.mark.parametrize("room", [D.BROADCAST_BYTES, 0])
def test_short_items_with_every_allowed_substitution(spark, docs, room):
    rng = random.Random(3)
    items = {n: [f"item{n}word{i}" for i in range(n)] for n in range(1, 21)}
    rows = []
    for n, item in items.items():
        free = min(n, D.WIDTH) - math.ceil(min(n, D.WIDTH) * D.LEAST - 1e-9)
        places = list(itertools.combinations(range(n), free))
        for out in places if n <= D.WIDTH else rng.sample(places, 30):
            words = [f"other{i}" if i in out else w for i, w in enumerate(item)]
            rows.append([*words_of(rng, 3), *words, *words_of(rng, 3)])
        if n < D.WIDTH:
            rows += [item[free:], item[: n - free], item[free:] + words_of(rng, 4), [*words_of(rng, 4), *item[: n - free]]]
            rows += [item[free + 1 :], [f"other{i}" if i <= free else w for i, w in enumerate(item)]]  # one too many
    want = {(d, n) for d, r in enumerate(rows) for n, item in items.items() if brute(r, item)}
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id bigint, text string")
    got = D.contaminated(docs([" ".join(r) for r in rows]), bench, broadcast_bytes=room)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 300


def test_short_item_word_for_word_and_clashing_columns(spark, docs):
    table = docs(["so alpha beta gamma delta eps it is", "alpha beta gamma", "eps"]).withColumns({n: F.lit(1) for n in ("_found", "_words", "_seed", "item_id")})
    bench = spark.createDataFrame([(1, "alpha beta gamma delta eps", 2)], "item_id bigint, text string, doc_id int")
    assert [(r["doc_id"], r["item_id"]) for r in D.contaminated(table, bench).collect()] == [(0, 1)]
    kept = D.decontaminate(table, bench)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


@pytest.mark.parametrize("room", [D.BROADCAST_BYTES, 0])
def test_stretches_change_nothing_and_hits_carry_near_words_only(spark, docs, room, monkeypatch):
    table, bench, _, rows = fixture(spark, docs)
    joined, near = [], D.near
    monkeypatch.setattr(D, "near", lambda df, words, *a: joined.append((words, near(df, words, *a))) or joined[-1][1])
    whole, cut = (sorted(map(tuple, D.contaminated(table, bench, broadcast_bytes=room, stretch=n).collect())) for n in (1 << 30, 16))
    assert whole == cut and len(cut) > 15
    for words, df in joined:
        assert 13 <= df.agg(F.max(F.size(words))).head()[0] <= 2 * (D.WIDTH - 1) + max(map(len, D.MASKS))


def test_a_long_text_full_of_an_item(spark, docs):
    item = words_of(random.Random(8), 37)
    table = docs([" ".join(item * 800), "nothing of it"])  # 30,000 words, 76,000 hits
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string")
    (found,) = D.contaminated(table, bench).collect()
    assert (found["doc_id"], found["item_id"], found["agreeing"]) == (0, 5, D.WIDTH) and found["n_hits"] > 70_000


def test_decontaminate_keeps_clean_documents(spark, docs):
    table, bench, leaks, rows = fixture(spark, docs)
    kept = {r["doc_id"] for r in D.decontaminate(table, bench).collect()}
    assert {d for d, _ in rows if d < 100 or d in (900, 901, 902)} <= kept
    assert not kept & {d for d, _ in leaks}
    assert D.decontaminate(table, bench).columns == table.columns


def test_empty_tables(spark, docs):
    table, bench, _, _ = fixture(spark, docs)
    assert D.contaminated(table.limit(0), bench).collect() == []
    assert D.contaminated(table, bench.limit(0)).collect() == []
    assert D.decontaminate(table, bench.limit(0)).count() == table.count()


def test_query_matches_sql(spark, duck, sf):
    assert compare(spark, duck, QUERIES["op5_decontaminate"], ORACLES["op5_decontaminate"], sf) == ""
