import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hydrolake.llm import bpe
from hydrolake.llm.queries import RANK_FILE, QUERIES


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(RANK_FILE))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    odd = "ab é\n\t  \x1c\x85 .1٣日本😀'sll!!--​<|endoftext|>"
    out = ["", None, " ", "a", "\n\n\n", "<|endoftext|>", "the the the", "the the the"]
    out += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(200)]
    out += ["".join(rng.choice("abcdefgh") for _ in range(30_000)), "a" * 5000, "word " * 8000]
    return out


def test_ids_are_those_of_the_library_and_decode_to_the_text(docs, ranks, reference):
    rows = texts()
    df = docs(rows).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    v = bpe.Vocabulary(ranks)
    out = bpe.decode(bpe.encode(df, v, public_tokenizers.PATTERN), v)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        ids = reference.encode_ordinary(text or "")
        assert bytes(got[i]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(got[i]["decoded"]).decode() == (text or "")


def test_batches_and_single_pieces_merge_alike(ranks):
    v = bpe.Vocabulary(ranks)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"etaoin shr\xc3\xa9\xff") for _ in range(rng.randrange(1, 17))) for _ in range(300)]
    for p, ids in zip(pieces, bpe.merge_many([p.ljust(1, b"a") for p in pieces], 16, v)):
        assert ids.tolist() == bpe.merge_one(p, v)


def test_faster_pattern_cuts_alike():
    import regex

    cut, wide = bpe.cutter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(3000):
        s = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(32, 64), rng.randrange(0x2000, 0x2040)])) for _ in range(rng.randrange(14)))
        assert cut(s) == wide.findall(s)


def test_other_escapes_use_the_general_engine():
    assert bpe.narrow(r"\d+|\p{Lu}") is None


def test_empty_table(docs, ranks):
    assert bpe.encode(docs(["x"]).limit(0), bpe.Vocabulary(ranks), public_tokenizers.PATTERN).collect() == []


def test_query(spark, sf, reference):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_byte_bpe"](spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(reference.encode_ordinary(t)) for i, t in rows.items()}
