import random
from collections import Counter, defaultdict

import numpy as np

from hydrolake.llm import graph, minhash
from hydrolake.llm.queries import QUERIES
from tests.llm.conftest import words_of


def shingle_counts(text):
    w = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split(None)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """class_id of each document: components of exact weighted Jaccard of at least 0.8, through all pairs that share a shingle."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    sets, holders = {}, defaultdict(list)
    for t, ids in texts.items():
        root[t], sets[t] = t, shingle_counts(t)
        for s in sets[t]:
            holders[s].append(t)
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if find(a) != find(b):
                    low, high = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
                    if low >= 0.8 * high:
                        root[find(a)] = find(b)
    least = {}
    for t, ids in texts.items():
        least[find(t)] = min([*ids, least.get(find(t), ids[0])])
    return {(d, t or ""): d if not sets[t or ""] else least[find(t or "")] for d, t in rows}


def near_copies(rng, n_groups=8, n_copies=25):
    rows = []
    for g in range(n_groups):
        base = words_of(rng, rng.randrange(60, 300))
        for c in range(n_copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((g * n_copies + c, " ".join(w)))
    return rows


def edge_cases(start):
    texts = ["", "", None, " \n\t", "one", "One", "one two three four", "one two three four", "a " * 40_000, "a " * 39_000, "é É", "é é"]
    return [(start + i, t) for i, t in enumerate(texts)]


def test_classes_are_those_of_all_pairs(docs):
    rng = random.Random(12)
    rows = near_copies(rng) + [(1000 + i, " ".join(words_of(rng, rng.randrange(1, 90)))) for i in range(60)] + edge_cases(2000)
    rows += [rows[3], rows[3]]
    out = minhash.near_duplicates(docs(rows).withColumnRenamed("lang", "class_id"))
    got = {r["doc_id"]: r["class_id"] for r in out.collect()}
    want = brute(rows)
    assert got == {d: c for (d, _), c in want.items()}
    assert len({c for d, c in got.items() if d < 200}) < 200


def test_one_of_each_group_stays(docs):
    rng = random.Random(2)
    base = " ".join(words_of(rng, 100))
    table = docs([(5, base), (3, base), (9, base + " more"), (7, "other text here with words"), (1, ""), (2, ""), (4, None)])
    out = minhash.drop_near_duplicates(table)
    assert out.columns == table.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 4, 7]


def test_null_and_repeated_ids(docs):
    rng = random.Random(3)
    a, b = (" ".join(words_of(rng, 50)) for _ in range(2))
    out = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs([(None, a), (4, a), (4, a), (4, b)])).collect()), key=str)
    assert out == [(4, 4), (4, 4), (None, 4)]


def test_empty_table(docs):
    assert minhash.near_duplicates(docs(["x"]).limit(0)).collect() == []


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**62, 100).astype(np.uint64)
    w1 = rng.random(100) * 3
    w2 = w1 * rng.random(100) * 1.2
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    found = []
    for t in range(150):
        e = a + np.uint64(t)
        s = minhash.signatures(np.concatenate([e, e]), np.concatenate([w1, w2]), np.repeat([0, 1], 100), 2, 80)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - true) < 0.02


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    element, weight, doc = rng.integers(1, 2**62, 300).astype(np.uint64), rng.integers(1, 4, 300).astype(float), np.sort(rng.integers(0, 7, 300))
    whole = minhash.signatures(element, weight, doc, 7, 16)
    for d in range(7):
        assert (minhash.signatures(element[doc == d], weight[doc == d], doc[doc == d] * 0, 1, 16)[0] == whole[d]).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200)] + [(500, 500 + i) for i in range(1, 60)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and got[202] == 200 and got[100] == 100 and {got[500 + i] for i in range(60)} == {500}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op10_dart_minhash"](spark, sf).collect()}
    assert got == {d: c for (d, _), c in brute(rows).items()}


def test_clashing_column_passes_through(docs):
    table = docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")]).withColumnRenamed("lang", "_kept")
    out = minhash.drop_near_duplicates(table)
    assert out.columns == table.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_members_of_a_bucket_are_linked_across_blocks_and_texts_go_to_partners_only(spark, docs):
    rng = random.Random(4)
    rows = near_copies(rng, 3, 10) + [(100 + i, " ".join(words_of(rng, 80))) for i in range(15)]
    signed = minhash.signed(docs(rows)).drop("bands").collect()
    # All in one bucket of the first band, each its own component but for two that are linked already.
    members = [(1, 0, len(rows), r["digest"], signed[0]["digest"] if i == 1 else r["digest"], r["signature"]) for i, r in enumerate(signed)]
    members = spark.createDataFrame(members, "key bigint, band int, n bigint, digest binary, component binary, signature binary")
    digest = {r["doc_id"]: bytes(r["digest"]) for r in signed}
    texts = spark.createDataFrame([(digest[d], t) for d, t in rows if d < 100], "digest binary, text string")
    for block in (4, 1000):
        links = minhash.block_links(members, texts, 5, 0.8, minhash.BANDS, minhash.ROWS, block).collect()
        root = {x: x for x in digest.values()}
        for r in links:
            a, b = bytes(r["a"]), bytes(r["b"])
            root = {x: root[a] if c == root[b] else c for x, c in root.items()}
        known = [(bytes(signed[0]["digest"]), bytes(signed[1]["digest"]))]
        for a, b in known:
            root = {x: root[a] if c == root[b] else c for x, c in root.items()}
        got = defaultdict(set)
        for d, x in digest.items():
            got[root[x]].add(d)
        want = defaultdict(set)
        for (d, _), c in brute(rows).items():
            want[c].add(d)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
