"""Tasks of a boosted fit exchange files, exact sums spare the larger sibling, and trees don't depend on the tasks."""

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from test_trees import KEY, same_trees, table

from fairrank.operators import boosting
from fairrank.operators.boosting import BoostingParams, FileSums, fit_boosting


def test_tasks_add_up_by_files(tmp_path):
    a = np.random.default_rng(1).integers(0, 9, (3, 5, 4, 2)).astype(complex)

    def run(task):
        files, out = FileSums(str(tmp_path / "x"), task, 3, 20.0), []
        for turn in range(20):
            out.append(files.scatter(a[task] + turn))
            out.append(files.gather(a[task] * turn))
            out.append(files(a[task] - turn))
            out.append(files.scatter(a[task][:1]))  # fewer columns than tasks
        return out, files.share(5)
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(run, range(3)))
    assert [s for _, s in got] == [slice(0, 1), slice(1, 3), slice(3, 5)]
    for turn in range(20):
        at = 4 * turn
        assert np.array_equal(np.concatenate([out[at] for out, _ in got]), a.sum(axis=0) + 3 * turn)
        assert all(np.array_equal(out[at + 1], a * turn) and np.array_equal(out[at + 2], a.sum(axis=0) - 3 * turn) for out, _ in got)
        assert np.array_equal(np.concatenate([out[at + 3] for out, _ in got]), a.sum(axis=0)[:1])
    assert len(os.listdir(tmp_path / "x")) == 2 * 3  # older files are gone
    with pytest.raises(TimeoutError):
        FileSums(str(tmp_path / "y"), 0, 2, 0.1)(a[0])


@pytest.mark.parametrize("width", [1, 6, 7])
def test_siblings_by_difference_equal_counted_ones(width, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_PER_JOINED_NODE", 100)
    r = np.random.default_rng(7)
    bins = r.integers(0, 64, (4000, width)).astype(np.uint8)
    bins[:, 0] = np.minimum(bins[:, 0], 9)  # empty bins
    grid = boosting._grid(4000.0)
    g, h = (np.rint(x / grid) * grid for x in (r.normal(size=4000) + bins[:, 0] / 9, r.uniform(0.01, 1, 4000)))
    used, params = r.random(4000) < 0.8, BoostingParams(depth=6)
    columns = [c for c in range(width) if c != 2]
    counted = []
    plain = boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda *a: counted.append(len(a[3])) or plain(*a))
    want, at = boosting.grow(bins, g, h, used, columns, params, lambda a: a)
    every, counted[:] = sum(counted), []
    got, place = boosting.grow(bins, g, h, used, columns, params, lambda a: a, True, boosting.joined_columns(bins))
    assert sum(counted) < 0.65 * every  # the larger siblings are not counted
    for k in ("feature", "bin", "left", "right"):
        assert got[k] == want[k]
    assert np.array_equal(at, place) and np.allclose(got["value"], want["value"], rtol=1e-4, atol=1e-6)
    for leaf in set(place):
        rows = used & (place == leaf)
        assert got["value"][leaf] == -g[rows].sum() / (h[rows].sum() + params.l2)  # to the last bit


def test_more_tasks_with_files_grow_the_same_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "EXACT_ROWS", 100)
    df, p = table(spark), BoostingParams(rounds=7, depth=4, step_rounds=4)
    one = fit_boosting(df, list("abcd"), str(tmp_path / "one"), KEY, params=p)
    monkeypatch.setattr(boosting, "ROWS_PER_FILE_TASK", 1000)
    three = fit_boosting(df, list("abcd"), str(tmp_path / "three"), KEY, params=p)
    assert spark.read.parquet(f"{tmp_path}/one/done").first().tasks == 1
    assert spark.read.parquet(f"{tmp_path}/three/done").first().tasks == 3
    assert same_trees(one, three)
    assert os.listdir(tmp_path / "three/exchange") == []
    alone = fit_boosting(df, list("abcd"), str(tmp_path / "alone"), KEY, params=p, most_tasks=1)
    assert spark.read.parquet(f"{tmp_path}/alone/done").first().tasks == 1 and same_trees(one, alone)
    # without files few rows take one task, and more of them add up by allGather
    monkeypatch.setattr(boosting, "exchange_folder", lambda *a: None)
    fit_boosting(df, list("abcd"), str(tmp_path / "slow"), KEY, params=BoostingParams(rounds=1, depth=2))
    assert spark.read.parquet(f"{tmp_path}/slow/done").first().tasks == 1
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 2000)
    p = BoostingParams(rounds=2, depth=2)
    slow = fit_boosting(df, list("abcd"), str(tmp_path / "two"), KEY, params=p)
    assert spark.read.parquet(f"{tmp_path}/two/done").first().tasks == 2
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 3_000_000)
    assert same_trees(slow, fit_boosting(df, list("abcd"), str(tmp_path / "again"), KEY, params=p))


def test_folder_for_files(spark, tmp_path):
    assert boosting.exchange_folder(spark, str(tmp_path), 2) == f"{tmp_path}/exchange"
    assert boosting.exchange_folder(spark, f"file://{tmp_path}", 2) == f"{tmp_path}/exchange"
    assert boosting.exchange_folder(spark, "hdfs://nowhere/path", 2) is None
