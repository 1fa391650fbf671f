"""Negative sampling against brute force on small random fixtures."""

import datetime
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fairrank.operators import labels


def _fixture(spark, seed, n_clients=12, n_products=15, n_rows=120):
    rnd = random.Random(seed)
    cats = ["a", "b", "c", None]
    pcat = {p: rnd.choice(cats) for p in range(n_products)}
    hist = [(rnd.randrange(n_clients), p, pcat[p]) for p in
            (rnd.randrange(n_products) for _ in range(n_rows))]
    pos = {(rnd.randrange(n_clients), rnd.randrange(n_products)) for _ in range(20)}
    h = spark.createDataFrame([(c, p, cat) for c, p, cat in hist], "ClientID long, ProductID long, Category string")
    h = h.withColumn("txn_date", F.lit("2020-01-01").cast("timestamp_ntz"))
    pdf = spark.createDataFrame(sorted(pos), "ClientID long, ProductID long").withColumn("label", F.lit(1))
    return hist, pos, h, pdf


def _brute(hist, pos, k, mode):
    cnt, cat = {}, {}
    for c, p, ca in hist:
        cnt[p] = cnt.get(p, 0) + 1
        if ca is not None:
            cat[p] = max(cat.get(p, ca), ca)
    order = sorted(cnt, key=lambda p: (-cnt[p], p))
    seen = {(c, p) for c, p, _ in hist}
    pref = {}
    for c in {c for c, _, _ in hist}:
        cc = {}
        for c2, _, ca in hist:
            if c2 == c and ca is not None:
                cc[ca] = cc.get(ca, 0) + 1
        if cc:
            pref[c] = sorted(cc, key=lambda x: (-cc[x], x))[0]
    out = {}
    for c in {c for c, _ in pos}:
        n = k * sum(1 for c2, _ in pos if c2 == c)
        uni = [p for p in order if (c, p) not in seen and (c, p) not in pos]
        if mode == "pop":
            out[c] = uni[:n]
        else:
            t0 = [p for p in uni if pref.get(c) is not None and cat.get(p) == pref[c]][:n]
            out[c] = t0 + [p for p in uni if p not in t0][:n - len(t0)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("mode", ["pop", "pop_in_prefcat"])
def test_hard_negatives_match_brute_force(spark, seed, mode):
    hist, pos, h, pdf = _fixture(spark, seed)
    got = {}
    for r in labels.negatives(h, pdf, 2, mode).orderBy("ClientID", "neg_order").collect():
        got.setdefault(r.ClientID, []).append(r.ProductID)
    exp = {c: v for c, v in _brute(hist, pos, 2, mode).items() if v}
    assert got == exp


@pytest.mark.parametrize("seed", [4, 5])
def test_random_negatives_invariants(spark, seed):
    hist, pos, h, pdf = _fixture(spark, seed)
    rows = labels.negatives(h, pdf, 2, "none").collect()
    seen = {(c, p) for c, p, _ in hist}
    catalog = {p for _, p, _ in hist}
    per = {}
    for r in rows:
        assert (r.ClientID, r.ProductID) not in seen and (r.ClientID, r.ProductID) not in pos
        assert r.ProductID in catalog
        per.setdefault(r.ClientID, []).append(r.ProductID)
    for c in {c for c, _ in pos}:
        n = 2 * sum(1 for c2, _ in pos if c2 == c)
        universe = {p for p in catalog if (c, p) not in seen and (c, p) not in pos}
        got = per.get(c, [])
        assert len(got) == len(set(got)) == min(n, len(universe))
    # deterministic
    again = labels.negatives(h, pdf, 2, "none").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def _bits(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def _random_brute(history, pos, per_pos, seed=42):
    """Draws by hashed rank where the catalog is large, else (or if they fail) the catalog in hash order."""
    pop = Counter(p for _, p in history)
    ranked = sorted(pop, key=lambda p: (-pop[p], p))
    out = {}
    for c in {c for c, _ in pos}:
        blocked = {p for c2, p in [*history, *pos] if c2 == c}
        n, size = per_pos * len({p for c2, p in pos if c2 == c}), len(ranked)
        got = []
        if size > labels.PROBE_FACTOR * (n + len(blocked)):
            for j in range(1, 2 * n + labels.PROBE_SPARE + 1):
                p = ranked[_bits(seed, c, j) % size]
                if p not in blocked and p not in got:
                    got.append(p)
        if len(got) < n:
            got = sorted(set(ranked) - blocked, key=lambda p: (_bits(seed, c, p), p))
        out[c] = got[:n]
    return out


@pytest.mark.parametrize("products, spare", [(12, 64), (900, 64), (900, -7)])
def test_random_negatives_match_brute_force(spark, monkeypatch, products, spare):
    """Catalog order, hashed draws, and draws that do not suffice (too few of them)."""
    monkeypatch.setattr(labels, "PROBE_SPARE", spare)
    hist = [(c, f"P{p:04d}") for p in range(products) for c in (f"C{p % 7}", "C9")[: 1 + (p % 50 == 0)]]
    pos = [("C9", "P0003"), ("C9", "P0004"), ("C9", "P0005"), ("C1", "P0002")]
    h = spark.createDataFrame([(c, p, "A", datetime.datetime(2024, 1, 1)) for c, p in hist],
                              "ClientID string, ProductID string, Category string, txn_date timestamp_ntz")
    got = {}
    rows = labels.negatives(h, spark.createDataFrame(pos, "ClientID string, ProductID string"), 4, "none")
    for r in rows.orderBy("ClientID", "neg_order").collect():
        got.setdefault(r.ClientID, []).append(r.ProductID)
    assert got == {c: v for c, v in _random_brute(hist, pos, 4).items() if v}
