"""Lempel-Ziv fingerprints against a plain parse of every text, over all documents in order."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fairrank.llm import lz_fingerprint as lz

LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(9000))
TEXTS = [(0, "abcabcabcabc"), (1, None), (2, ""), (3, "é" * 9 + "ßü"), (4, LONG), (5, LONG), (6, LONG[:-20] + "another ending of it"), (7, "x"),
         (9, "same id"), (9, "same id"), (9, "same id, other text"), (None, "no id"), (None, None), (12, "a b\nc\t😀d" * 40)]
TEXTS += [(100 + i, f"Document {i % 30} of some words, " * (1 + i % 7)) for i in range(120)]


def plain(text):
    data, phrases, start = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in phrases:
            phrases.add(data[start:end])
            start = end
    return {xxhash.xxh3_64_intdigest(p) >> 32 for p in phrases}


def printed(hashes):
    return "".join(f"{h:08x}" for h in sorted(hashes)[:lz.KEPT])


def alike(a, b):
    x, y = set(sorted(a)[:lz.KEPT]), set(sorted(b)[:lz.KEPT])
    both = sorted(x | y)[:lz.KEPT] if max(len(x), len(y)) == lz.KEPT else sorted(x | y)
    return sum(h in x and h in y for h in both) / len(both) if both else 1.0


def brute(rows):
    """All documents by falling id (null last), ties by text hash, each with the next one."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    out = []
    for i, (doc_id, text, _) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text)
        edited = text[:n - n // 2] + after[:n // 2]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [64, 8 << 20])
def test_every_document_against_a_plain_parse(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(lz, "RANGE_BYTES", range_bytes)
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(7)
    wide = df.select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("key"), F.lit(3).alias("bucket"))
    hashed = [(r.doc_id, r.t, r.h) for r in df.select("doc_id", F.coalesce(df["text"], F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()]
    assert got(lz.compare_with_neighbours(wide)) == brute(hashed)


def test_single_document_and_empty_table(spark):
    one = spark.createDataFrame([("k", "abcdef")], "name string, body string")
    r = lz.compare_with_neighbours(one, "name", "body").collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r[0].near_next == 1.0
    assert lz.compare_with_neighbours(one.where("false"), "name", "body").collect() == []
    assert lz.fingerprint_documents(one.where("false"), "name", "body").collect() == []


def test_likeness_follows_shared_text(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    prints = lz.fingerprint_documents(df.withColumn("N_CHARS", F.lit(0)))
    by = {r.doc_id: r for r in prints.collect() if r.doc_id != 9}
    assert by[4].fingerprint == by[5].fingerprint and by[1].fingerprint == by[2].fingerprint == "" and by[3].n_chars == 11
    pairs = prints.alias("a").join(prints.alias("b"), F.expr("a.doc_id in (4, 7) and b.doc_id in (2, 5, 6, 12)"))
    pairs = pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.col("a.fingerprint").alias("x"), F.col("b.fingerprint").alias("y"))
    near = {(r.a, r.b): r.likeness for r in lz.compare_fingerprints(pairs, "x", "y").collect()}
    assert near[4, 5] == 1.0 and near[4, 6] > 0.9 and near[4, 12] < 0.1 and near[7, 2] == 0.0


def test_sampled_likeness_is_near_the_jaccard_similarity():
    r = np.random.default_rng(2)
    base = [" ".join(map(str, r.integers(0, 400, 3000))) for _ in range(12)]
    off = []
    for x, y in zip(base, base[1:]):
        for cut in (0.2, 0.5, 0.8):
            k = int(len(x) * cut)
            a, b = plain(x), plain(x[:k] + y[k:])
            off.append(abs(alike(a, b) - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05 and max(off) < 0.16
