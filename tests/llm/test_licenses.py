import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.llm import licenses
from hydrolake.llm.queries import QUERIES
from tests.llm.conftest import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute_phrases(text):
    """(label, start, words, base) of every place of every phrase, word by word."""
    words = split(text)
    out = []
    for p in licenses.PHRASES:
        what = split(p.text)
        out += [(i, len(what), p.label, p.base) for i in range(len(words) - len(what) + 1) if words[i : i + len(what)] == what]
    return sorted(out)


def has(words, phrase):
    what = split(phrase)
    return any(words[i : i + len(what)] == what for i in range(len(words) - len(what) + 1))


def test_phrases_as_brute_force(spark, docs):
    rng = random.Random(2)
    bits = ["GNU", "general", "Public", "license", "Apache", "License,", "CC", "BY-NC", "BY", "4.0", "MIT", "version", "2", "2.0", "3", "é", "x", "\n", "gnu general public license"]
    texts = [None, "", "...", "MIT License", "the MIT  license\nMIT-LICENSE", "mitlicense", "MIT", "CC BY " * 3000, "GNU GENERAL PUBLIC", "LICENSE", "cc_by", "MITé License"]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += texts[3:5]
    table = docs(texts).withColumnRenamed("lang", "places").withColumn("words", F.lit(1))
    index = licenses.corpus_index(table)
    out = licenses.scan(table, index)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "words", "n_words", "places"]
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert (rows[i]["text"], rows[i]["n_words"]) == (t, len(split(t)))
        assert [(p["start"], p["length"], p["label"], p["base"]) for p in rows[i]["places"]] == brute_phrases(t)
        assert all(p["score"] == 1.0 for p in rows[i]["places"])
    assert licenses.scan(table.limit(0), licenses.corpus_index(table.limit(0))).collect() == []


def test_index_holds_the_rarest_words(docs):
    index = licenses.corpus_index(docs(["gnu general public", "general public license", "public license", "license", None]))
    assert index.vocabulary == sorted(index.vocabulary)
    idf = dict(zip(index.vocabulary, index.idf))
    assert idf[b"gnu"] > idf[b"general"] > idf[b"public"] == idf[b"license"] and idf[b"general"] == pytest.approx(np.log(6 / 2.5))
    anchors = {p.text: split(p.text)[a] for p, _, a in index.phrases}
    assert anchors["gnu general public license"] == "gnu"
    for number, (notice, ids, _) in enumerate(index.notices):
        keys = {w for w, t, _ in index.postings.tolist() if t == number}
        assert len(keys) == min(licenses.KEYS, len(set(ids.tolist()))) and index.need[number] == -(-len(keys) // 2)
        assert min(index.idf[sorted(keys)]) >= max(index.idf[i] for i in set(ids.tolist()) - keys)


def labels(row):
    return {p["label"] for p in row["places"] if not p["base"]}


def test_notices_reflowed_marked_and_altered(spark, docs):
    rng = random.Random(7)
    rows, want = [], {}
    for t in licenses.NOTICES:
        lines = re.findall(r".{1,60}(?:\s|$)", t.text)
        before, after = " ".join(words_of(rng, 300)), " ".join(words_of(rng, 200))
        comment = "\n".join(f" * {x}" for x in lines)
        words = t.text.split()
        key = {w for m in t.mandatory for w in split(m)}
        some = " ".join(w if rng.random() > 0.06 or set(split(w)) & key else "other" for w in words)
        spread = " ".join(w + (" Copyright 2020 Some Holder" if i % 30 == 20 and not set(split(" ".join(words[i : i + 2]))) & key else "") for i, w in enumerate(words))
        for text in (t.text, f"{before}\n/*\n{comment}\n*/\n{after}", f"{before} {some} {after}", f"{spread} {after}", t.text.upper()):
            want[len(rows)] = t.label
            rows.append(text)
        rows.append(f"{before} {' '.join(words[: len(words) // 3])} {after}")  # a third of it is no notice
        rows.append(" ".join(sorted(words)))  # nor are its words without its phrases
    clean = len(rows)
    rows += [" ".join(words_of(rng, 400)) for _ in range(30)] + ["Permission is hereby granted, free of charge, to nobody."]
    table = docs(rows)
    got = {r["doc_id"]: r for r in licenses.scan(table, licenses.corpus_index(table)).collect()}
    for i, label in want.items():
        assert label in labels(got[i]), rows[i]
    for i in set(range(clean)) - set(want):
        assert not any(p["length"] > 20 for p in got[i]["places"]), rows[i]
    assert all(not got[i]["places"] for i in range(clean, len(rows)))


def test_windows_hold_what_they_claim(spark, docs):
    """Each notice found is checked in the words of its window."""
    rng = random.Random(9)
    rows = []
    for _ in range(60):
        t, words = rng.choice(licenses.NOTICES), []
        for w in t.text.split():
            words += [] if rng.random() < 0.1 else [w]
        rows.append(" ".join(words_of(rng, rng.randrange(50)) + words + words_of(rng, rng.randrange(50)) + rng.choice(licenses.NOTICES).text.split()))
    table = docs(rows)
    index = licenses.corpus_index(table)
    idf = {w.decode(): x for w, x in zip(index.vocabulary, index.idf)}
    n = 0
    for r in licenses.scan(table, index).collect():
        words = split(r["text"])
        for p in r["places"]:
            if p["length"] < 20:
                continue
            window = words[p["start"] : p["start"] + p["length"]]
            held = [t for t in licenses.NOTICES if t.label == p["label"] and all(has(window, m) for m in t.mandatory)]
            weights = [{w: max(0.0, idf[w]) for w in split(t.text)} for t in held]
            shares = [sum(x for w, x in weight.items() if w in window) / sum(weight.values()) for weight in weights]
            assert any(abs(s - p["score"]) < 1e-9 for s in shares) and p["score"] >= licenses.COVERED
            n += 1
    assert n >= 60


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, sf).collect()}
    base = {p.label for p in licenses.PHRASES if p.base}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    n = 0
    for r in rows:
        places = brute_phrases(r["text"])
        own = [p for p in places if p[3]]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(split(r["text"])), len(own))
        assert (g["first_word"], g["last_word"]) == ((min(own)[0], max(own)[0]) if own else (None, None))
        assert g["base_labels"] == ",".join(sorted({p[2] for p in own})) and set(g["base_labels"].split(",")) <= base | {""}
        assert g["labels"] == ",".join(sorted({p[2] for p in places}))  # these tables hold no notice
        assert g["score"] == (1.0 if places else 0.0)
        n += bool(own)
    assert n
