"""Whitening against a plain eigendecomposition in exact or double arithmetic."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairrank.llm import queries, whitening
from fairrank.llm.spectrum import count_above, leading_pairs

SF = "/root/testdata/sf0.01"


def check(got, rows, components=16):
    """``got`` against the contract, recomputed from (id, vector) rows of one length."""
    use = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
           if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in use})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(use)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    z = np.array([[by[i][c + 1][0].whitened for c in range(k)] for i, _ in use])
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for _, x in use], object)
    want = centred.astype(float) / n @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):  # either sign, but the same one for all rows
        sign = np.sign(z[:, c] @ want[:, c])
        assert np.allclose(z[:, c], sign * want[:, c], atol=1e-7)
    for (i, _), c in zip(use, centred):
        for comp, rs in by[i].items():
            for r in rs:
                assert r.n == n and r.deviation == int((c * c).sum()) and 0 <= r.identity_error <= 1e-4
                assert abs(r.explained / (values[comp - 1] / values.sum()) - 1) < 1e-6
    assert len({r.identity_error for r in got}) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op12_embedding_whitening(spark, SF).collect()
    assert got[0].identity_error < 1e-9
    check(got, rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in r.normal(0, 3, 5) * [9, 4, 4, 2, 0]]) for i in range(300)]
    copies = [(1000 + i, rows[0][1]) for i in range(150)] + [rows[3], rows[3]]
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + copies + bad, "vec_id bigint, embedding array<float>").repartition(9)
    wide = df.select("*", F.lit(1).alias("VEC_ID"), F.lit(2).alias("n"), F.lit(3).alias("x"))
    got = whitening.whiten_components(wide).collect()
    check(got, rows + copies)  # four components: the fifth has no variance
    again = whitening.whiten_components(df.repartition(3)).collect()
    assert sorted(r[:-1] for r in got) == sorted(r[:-1] for r in again)  # to the last digit, however rows are dealt
    assert whitening.whiten_components(df.where("false")).count() == 0
    assert whitening.whiten_components(df.where("vec_id >= 1000 and vec_id < 2000")).count() == 0  # one vector has no variance


def test_lengths_apart_and_huge_components(spark):
    data = [(i, [float(i % 7), float(i * i % 11)]) for i in range(60)] + [(100 + i, [float(i)]) for i in range(9)]
    data += [(None, [3.0, 3.0]), (200, []), (300, [1e300, -1e300, 1.0]), (301, [1.0, 2.0, 3.0]), (302, [5.0, 1e17, 0.0])]
    got = whitening.whiten_components(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    assert {r.n for r in got if r.vec_id is not None and 100 <= r.vec_id < 200} == {9}
    check([r for r in got if r.vec_id is not None and 100 <= r.vec_id < 200], data[60:69])
    assert all(r.deviation is None for r in got if r.vec_id in (300, 302)) and {r.component for r in got if r.vec_id == 301} <= {1, 2}


def test_counts_and_pairs_of_hard_spectra():
    r = np.random.default_rng(5)
    for d in (1, 2, 7, 40):
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        for e in (r.uniform(0, 5, d), np.r_[np.full(d // 2, 3.0), r.uniform(0, 1, d - d // 2)], np.zeros(d), 1 + 1e-9 * np.arange(d), np.exp(-np.arange(d) / 4)):
            a = q @ np.diag(e) @ q.T
            a = (a + a.T) / 2
            for s in r.uniform(-1, 5, 5):
                assert count_above(a, s) == (np.linalg.eigvalsh(a) > s).sum()
            values, x = leading_pairs(a, 16)
            want = np.sort(e)[::-1][:len(values)]
            assert len(values) >= min(16, (e > 1e-10).sum()) and np.allclose(values, want, atol=1e-12)
            assert np.allclose(a @ x, x * values, atol=1e-12) and np.allclose(x.T @ x, np.eye(len(values)), atol=1e-12)
