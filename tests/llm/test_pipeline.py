"""Every stage of the pipeline on what its predecessor kept, against plain Python."""

import re
import struct
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from hydrolake.llm import bpe, toxicity
from hydrolake.llm.queries import RANK_FILE, fold
from hydrolake.sources.shared import materialize
from tests.llm.test_lines import brute as cut_lines
from tests.llm.test_minhash import brute as near_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output rows of each stage, by its name."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf), f"test-{name}")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "byte_bpe"]
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == COLUMNS, name
    assert stages["byte_bpe"][2] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxicity(spark, sf, stages):
    before, after, _ = stages["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), only=fold() != 0)
    scores = model.score([r["text"] or "" for r in before])
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, scores) if s < 0.5}


def test_line_dedup(stages):
    before, after, _ = stages["line_dedup"]
    want = {d: w for d, w in cut_lines([(r["doc_id"], r["text"]) for r in before]).items() if not w[1] or w[2].strip(" ")}
    assert {r["doc_id"]: r["text"] for r in after} == {d: w[2] for d, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after if want[r["doc_id"]][1])


def test_near_duplicates(stages):
    before, after, _ = stages["minhash_near_dedup"]
    classes = near_classes([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {d for (d, _), c in classes.items() if d == c}


def test_decontamination(spark, sf, stages):
    before, after, _ = stages["decontamination"]

    def runs(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    items = Counter(s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for s in runs(r["text"]))
    kept = {r["doc_id"] for r in after}
    leaks = {r["doc_id"] for r in before if any(s in items for s in runs(r["text"]))}
    assert leaks and not kept & leaks
    # Whatever else goes holds most of thirteen words of an item in a row.
    sixes = {s[i : i + 4] for s in items for i in range(10)}
    for r in before:
        if r["doc_id"] not in kept | leaks:
            assert any(s[i : i + 4] in sixes for s in runs(r["text"]) for i in range(10))


def test_tokens(stages):
    before, after, _ = stages["byte_bpe"]
    import hashlib

    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in after}
    assert len(got) == len(before)
    for r in before:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in stages["byte_bpe"][1])


def test_odd_tables(spark, tmp_path, docs):
    docs([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 20_000)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, str(tmp_path)).count() >= 4
        assert stage(spark, table.where(F.lit(False)), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
