import random

from pyspark.sql import functions as F

from hydrolake.llm import lines
from hydrolake.llm.queries import QUERIES, ORACLES
from tests.llm.conftest import words_of
from tests.oracle import compare


def brute(rows):
    """(n_lines, n_removed, text) of each (doc_id, text), by maximal runs of lines that stood earlier in that order."""
    seen, out = set(), {}
    for d, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = text.split("\n")
        full = [i for i, x in enumerate(parts) if x.strip(" ")]
        gone, k = set(), 0
        new = set()
        while k < len(full):
            # The longest run of neighbours that each stood earlier, here or in a document before.
            end = k
            while end + 1 < len(full) and (pair := (parts[full[end]], parts[full[end + 1]])) in seen | new:
                end += 1
            if end > k:
                gone |= set(range(full[k], full[end] + 1))
            if end + 1 < len(full):
                new.add((parts[full[end]], parts[full[end + 1]]))
            k = end + 1
        for i in full:
            if len(parts[i].split()) > 50:
                if (parts[i],) in seen | new:
                    gone.add(i)
                new.add((parts[i],))
        seen |= new
        out[d] = (len(parts), len(gone), "\n".join(x for i, x in enumerate(parts) if i not in gone))
    return out


def passages(rng):
    def line():
        return " ".join(words_of(rng, 8))

    shared = [[line() for _ in range(rng.randrange(5, 12))] for _ in range(4)]
    rows = []
    for i in range(60):
        body = [line() for _ in range(rng.randrange(1, 12))]
        if i % 2:
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(shared)
        rows.append((i, "\n".join(body)))
    return rows


def test_as_brute_force(spark, docs):
    rng = random.Random(3)
    rows = passages(rng)
    rows += [(100, rows[1][1]), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "one line"), (105, "one line"), (None, rows[3][1])]
    rows += [(200, "\n".join(["same line"] * 3000)), (201, "\n".join(" ".join(words_of(rng, 5)) for _ in range(5000)))]
    out = lines.dedup_lines(docs([*rows, (300, None)]).withColumnRenamed("lang", "n_removed"))
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute(rows)
    assert {d: (r["n_lines"], r["n_removed"], r["text"]) for d, r in got.items() if d != 300} == want
    assert (got[300]["text"], got[300]["n_lines"], got[300]["n_removed"]) == (None, 0, 0)
    assert all(r["n_chars"] == len(r["text"]) for d, r in got.items() if d != 300)
    assert sum(w[1] for w in want.values()) > 50


def test_copies_of_a_row_keep_their_text(docs):
    text = "\n".join(f"line number {i}" for i in range(30))
    out = lines.dedup_lines(docs([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 0), (1, 0), (2, 30)]


def test_whole_passage_goes_at_any_place(docs):
    rng = random.Random(8)
    for size in (2, 3, 5, 20):
        passage = [" ".join(words_of(rng, 26)) for _ in range(size)]
        passage[size // 2 : size // 2] = ["", "  "]  # blank lines in it go as well
        rows = [(i, "\n".join([f"own {size} {i} {k}" for k in range(i)] + passage + [f"end {size} {i}"])) for i in range(6)]
        got = {r["doc_id"]: r for r in lines.dedup_lines(docs(rows)).collect()}
        assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == size + 2 for i in range(1, 6))
        assert all(got[i]["text"].split("\n") == [*(f"own {size} {i} {k}" for k in range(i)), f"end {size} {i}"] for i in range(1, 6))


def test_equal_lines_and_long_lines(docs):
    long, short = " ".join(words_of(random.Random(1), 51)), " ".join(words_of(random.Random(2), 50))
    rows = [(1, "\n".join(["same"] * 50)), (2, "\n".join(["same"] * 50)), (3, f"a\n{long}\nb"), (4, f"c\n{long}\nd"), (5, short), (6, f"x\n{short}"), (7, "\n \n\n"), (8, "\n \n\n")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(rows)).collect()}
    # Of equal lines the first stays; one line of fifty words is no passage.
    assert [got[i]["n_removed"] for i in range(1, 9)] == [49, 50, 0, 1, 0, 0, 0, 0]
    assert (got[1]["text"], got[2]["text"], got[4]["text"]) == ("same", "", "c\nd")


def test_clashing_names_pass_through(docs):
    names = ["_id", "_text_hash", "_k", "_h", "_chunk", "_gone", "_kept", "_lines", "_row", "_text", "_first", "_full", "_before"]
    text = "\n".join(f"line {i}" for i in range(9))
    table = docs([(1, text), (2, text), (3, "other")]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    out = lines.dedup_lines(table)
    assert out.columns == [*table.columns, "n_lines", "n_removed"]
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names) and r["n_removed"] == (9 if r["doc_id"] == 2 else 0)


def test_empty_table(docs):
    assert lines.dedup_lines(docs(["x"]).limit(0)).collect() == []


def test_query_matches_sql(spark, duck, sf):
    assert compare(spark, duck, QUERIES["op6_line_dedup"], ORACLES["op6_line_dedup"], sf) == ""
