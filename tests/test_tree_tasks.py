"""A boosted fit takes another task only where its rows outweigh the waits of the tasks for each other."""

import numpy as np
import pyarrow as pa

from fairrank.operators import boosting


def test_a_task_more_only_for_very_many_rows():
    # an allGather takes about a second, a round needs one per level: 270,000 rows take one task less time than that
    assert boosting.step_tasks(270_000, 12) == 1
    assert boosting.step_tasks(0, 12) == 1
    assert boosting.step_tasks(16_000_000, 12) == 6
    assert boosting.step_tasks(10**10, 12) == 12
    assert boosting.step_tasks(10**10, 1000) == boosting.MAX_TASKS


def test_bins_are_read_from_arrow_slices():
    rows = [bytes([i, i // 2, 63 - i]) for i in range(40)]
    for kind in (pa.binary(), pa.large_binary()):
        part = pa.array(rows, kind).slice(7, 20)
        assert np.array_equal(boosting._bytes(part).reshape(-1, 3), [list(r) for r in rows[7:27]])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(rows[a:b], pa.binary()), pa.array(np.arange(a, b) % 2.0),
                                           pa.array(np.ones(b - a)), pa.array(np.zeros(b - a))], ["id", "bins", "y", "w", "margin"])
               for a, b in ((0, 25), (25, 25), (25, 40))]
    params = boosting.BoostingParams(rounds=2, depth=2, row_share=1.0, column_share=1.0)
    out = pa.Table.from_batches(boosting._step(3, 0, 2, params, lambda a: a)(batches)).to_pylist()
    assert [(r["id"], r["bins"]) for r in out[:40]] == list(enumerate(rows))
    assert [r["round"] for r in out[40:]] == [0, 1] and all(r["tree"] for r in out[40:])
