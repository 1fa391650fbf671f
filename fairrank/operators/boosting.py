"""Boosted trees (M3) that scale out and can be resumed.

Features become bins at quantile cuts, once.  A step of ``step_rounds`` rounds is one Spark job in
barrier mode: every task holds its share of the binned rows, builds gradient histograms of the
nodes of a level, and the tasks add them up, so that all grow the same Newton tree
(XGBoost's gain and leaf values, L2 ``l2``).  Only histograms travel, never rows: by files where the tasks
see each other's in the folder of the fit at once (tried before), each task adding up and searching its
share of the columns, else by ``allGather``.  The rows and columns of a round come from a hash and a seeded draw.

Above ``EXACT_ROWS`` rows gradients are rounded to a grid fine enough that every sum of them is exact
in a double.  Then a node's histogram is its parent's less its sibling's, so that only the smaller of
two siblings is counted, and trees do not depend on the number of tasks.

Each step writes the rows with their new margins and the trees below ``path``, then a line in the
ledger ``done``.  A fit that finds a ledger goes on after its last line, whatever an interrupted run
has left behind, and ends with the same trees as an unbroken one; a lost executor repeats a step.

Trees are arrays (feature, threshold, left, right, value, gain); feature -1 marks a leaf.
"""

from __future__ import annotations

import json
import math
import os
import random
import shutil
import threading
import time
import uuid
from base64 import b64decode, b64encode
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins per feature, rows a task takes before another one joins (an ``allGather`` takes about a second, and a
#: round needs one per level: a task of its own has done a round over so many rows by then; about 300 bytes
#: a row), and the most tasks of a step (each receives the histograms of all).
BINS, ROWS_PER_TASK, MAX_TASKS = 64, 3_000_000, 64
#: The same where tasks exchange files (about a millisecond a level), and rows from which sums are exact.
ROWS_PER_FILE_TASK, EXACT_ROWS = 40_000, 20_000
#: Rows a node should have for counting two columns at once: the table of a pair has BINS times the cells.
ROWS_PER_JOINED_NODE = 6_000
#: Seconds that one exchange of files may take when it is tried, and those after which a task gives up on the others.
_QUICK, _PATIENCE = 0.1, 900.0
_ROWS = "id bigint, bins binary, y double, w double, margin double"
_TREE = {"feature": "int", "threshold": "double", "left": "int", "right": "int", "value": "double", "gain": "double"}
_MIN_CHILD = 1.0


@dataclass(frozen=True)
class BoostingParams:
    """The declared settings of the boosted trees."""

    rounds: int = 600
    depth: int = 8
    step_size: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    seed: int = 42
    step_rounds: int = 50


class FileSums:
    """Sums over the tasks of a barrier stage by files in a folder that all of them see.

    Each call writes one file a task, under its final name when it is whole, and reads the others'.  A task
    that has read all files of a call knows that those of the call before are read by all."""

    def __init__(self, folder: str, task: int, tasks: int, patience: float = _PATIENCE):
        self.folder, self.task, self.tasks, self.patience, self.calls = folder, task, tasks, patience, 0
        os.makedirs(folder, exist_ok=True)

    def _name(self, call: int, task: int) -> str:
        return f"{self.folder}/{call}-{task}"

    def _put(self, a: np.ndarray) -> None:
        self.calls += 1
        name = self._name(self.calls, self.task)
        np.ascontiguousarray(a).tofile(f"{name}.part")
        os.rename(f"{name}.part", name)
        if self.calls > 2:
            os.unlink(self._name(self.calls - 2, self.task))

    def _get(self, task: int, dtype, count: int, offset: int) -> np.ndarray:
        name, begun, pause = self._name(self.calls, task), time.monotonic(), 0.0
        while True:
            try:
                with open(name, "rb") as f:
                    return np.fromfile(f, dtype, count, offset=offset)
            except FileNotFoundError:
                if time.monotonic() - begun > self.patience:
                    raise TimeoutError(f"no file of task {task} in {self.folder}") from None
                time.sleep(pause)
                pause = min(0.002, pause + 0.0001)

    def share(self, n: int, task: int | None = None) -> slice:
        """The columns, of n, that a task adds up and searches."""
        task = self.task if task is None else task
        return slice(n * task // self.tasks, n * (task + 1) // self.tasks)

    def scatter(self, a: np.ndarray) -> np.ndarray:
        """The sum over the tasks of this task's share of the first axis."""
        self._put(a)
        mine = self.share(len(a))
        width = a[:1].size
        out, count = np.zeros((mine.stop - mine.start, *a.shape[1:]), a.dtype), (mine.stop - mine.start) * width
        for task in range(self.tasks) if count else ():
            out += a[mine] if task == self.task else self._get(task, a.dtype, count, mine.start * width * a.itemsize).reshape(out.shape)
        if not count:  # nobody may run ahead of a task that has not been heard
            for task in range(self.tasks):
                self._get(task, a.dtype, 0, 0)
        return out

    def gather(self, a: np.ndarray) -> np.ndarray:
        """The arrays of all tasks, of one shape."""
        self._put(a)
        return np.stack([a if task == self.task else self._get(task, a.dtype, a.size, 0).reshape(a.shape) for task in range(self.tasks)])

    def __call__(self, a: np.ndarray) -> np.ndarray:
        return self.gather(a).sum(axis=0)


def joined_columns(bins: np.ndarray) -> np.ndarray:
    """The bins of columns 0 and 1, 2 and 3, ... as one number a pair and row."""
    even = bins.shape[1] // 2 * 2
    return np.ascontiguousarray((bins[:, :even:2].astype(np.uint16) * BINS + bins[:, 1:even:2]).T)


def _histograms(lines: np.ndarray, pairs: np.ndarray | None, columns: Sequence[int], rows: np.ndarray, node: np.ndarray, v: np.ndarray,
                nodes: int) -> np.ndarray:
    """Sums of v (gradients, i x Hessians) of the rows by column, node and bin.  Where nodes have many rows two
    columns are counted at once, if ``pairs`` has them joined."""
    out = np.zeros((len(columns), nodes, BINS), complex)
    place, left = {c: i for i, c in enumerate(columns)}, list(columns)
    if pairs is not None and len(rows) >= ROWS_PER_JOINED_NODE * nodes:
        cell = node * (BINS * BINS)
        for q in sorted({c // 2 for c in columns if c // 2 < len(pairs)}):
            sums = np.zeros((nodes, BINS, BINS), complex)
            np.add.at(sums.ravel(), cell + pairs[q].take(rows), v)
            for c, axis in ((2 * q, 2), (2 * q + 1, 1)):
                if c in place:
                    out[place[c]] = sums.sum(axis=axis)
        left = [c for c in columns if c // 2 >= len(pairs)]
    cell = node * BINS
    for c in left:
        np.add.at(out[place[c]].ravel(), cell + lines[c].take(rows), v)
    return out


def _best_splits(hist: np.ndarray, l2: float) -> np.ndarray:
    """Per node the best split of some columns: gain, place of the column, bin, sums of both sides (4); without
    columns a gain of -1."""
    def score(s):
        return s[0] * s[0] / (s[1] + l2)

    out = np.full((hist.shape[1], 7), -1.0)
    if not len(hist):
        return out
    below = np.stack((hist.real, hist.imag)).cumsum(axis=3)
    whole = below[..., -1:]
    above = whole - below
    gain = score(below) + score(above) - score(whole)
    gain[(below[1] < _MIN_CHILD) | (above[1] < _MIN_CHILD)] = 0.0
    flat = gain.transpose(1, 0, 2).reshape(len(out), -1)
    best = flat.argmax(axis=1)
    node, (c, b) = np.arange(len(out)), np.divmod(best, BINS)
    out[:, 0], out[:, 1], out[:, 2] = flat[node, best], c, b
    out[:, 3:5], out[:, 5:] = below[:, c, node, b].T, above[:, c, node, b].T
    return out


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, columns: Sequence[int], params: BoostingParams,
         add_up: Callable[[np.ndarray], np.ndarray], exact: bool = False, pairs: np.ndarray | None = None) -> tuple[dict[str, list], np.ndarray]:
    """One tree, level by level, and every row's leaf.  ``bins``: rows x features; gradients count for
    ``used`` rows only; ``add_up`` sums an array over all tasks.  ``exact``: sums of g and h are exact, so that
    the larger of two siblings is their parent less the smaller one; ``pairs``: ``joined_columns``, for that case."""
    tree: dict[str, list] = {k: [] for k in ("feature", "bin", "left", "right", "value", "gain")}

    def leaf(gs, hs) -> int:
        for k, v in zip(tree, (-1, 0, -1, -1, -float(gs) / (float(hs) + params.l2), 0.0)):
            tree[k].append(v)
        return len(tree["value"]) - 1

    files = add_up if isinstance(add_up, FileSums) else None
    lines = np.ascontiguousarray(bins.T)
    n, flat = len(bins), lines.ravel()
    sums = add_up(np.array([g[used].sum(), h[used].sum()]))
    at = np.full(n, leaf(*sums))  # every row's node
    # the rows that count and are not in a leaf yet, in order
    live = np.flatnonzero(used)
    v = np.empty(len(live), complex)
    v.real, v.imag = g[live], h[live]
    level, counted, hist = [0], [0], None
    for depth in range(1, params.depth + 1):
        place = np.full(len(tree["value"]), -1)
        place[counted] = np.arange(len(counted))
        cell = place[at[live]]
        if len(counted) < len(level) or (cell < 0).any():
            inside = np.flatnonzero(cell >= 0)
            new = _histograms(lines, pairs, columns, live[inside], cell[inside], v[inside], len(counted))
        else:
            new = _histograms(lines, pairs, columns, live, cell, v, len(counted))
        new = files.scatter(new) if files else add_up(new)
        if not exact:
            new = new.astype(np.complex64).astype(complex)
        if hist is None or not exact:
            hist = new
        else:  # the counted ones, and next to each its sibling
            nodes, kept = np.array(level).reshape(-1, 2), hist[:, parents]
            hist = np.empty((len(new), len(level), BINS), complex)
            first = place[nodes[:, 0]] >= 0
            hist[:, ::2] = np.where(first[:, None], new, kept - new)
            hist[:, 1::2] = np.where(first[:, None], kept - new, new)
        best = _best_splits(hist, params.l2)
        if files:
            best[:, 1] += files.share(len(columns)).start
            every = files.gather(best)
            best = every[every[:, :, 0].argmax(axis=0), np.arange(len(level))]
        nexts, parents = [], []
        for i, (node, (gain, c, b, *sides)) in enumerate(zip(level, best.tolist())):
            if gain <= 1e-6:
                continue
            tree["feature"][node], tree["bin"][node], tree["gain"][node] = int(columns[int(c)]), int(b), gain
            tree["left"][node] = leaf(*sides[:2])
            tree["right"][node] = leaf(*sides[2:])
            nexts += [tree["left"][node], tree["right"][node]]
            parents.append(i)
        if not nexts:
            break
        # a leaf's rows go nowhere: its children are itself, and any bin is at most the last
        node = np.arange(len(tree["value"]))
        feature, cut = np.array(tree["feature"]), np.array(tree["bin"])
        inner = feature >= 0
        kids = np.column_stack((np.where(inner, tree["right"], node), np.where(inner, tree["left"], node))).ravel()
        low = flat.take((np.maximum(feature, 0) * n).take(at) + np.arange(n)) <= cut.take(at)
        at = kids.take(2 * at + low)
        if len(parents) < len(level):
            left = np.ones(len(tree["value"]), bool)
            left[nexts] = False
            stay = np.flatnonzero(~left.take(at.take(live)))
            live, v = live[stay], v[stay]
        level = counted = nexts
        if exact and depth < params.depth:
            rows = np.bincount(at.take(live), minlength=len(tree["value"]))[nexts].reshape(-1, 2)
            rows = add_up(rows.astype(float))
            counted = np.where(rows[:, 0] <= rows[:, 1], nexts[::2], nexts[1::2]).tolist()
    return tree, at


def _drawn(ids: np.ndarray, r: int, params: BoostingParams) -> np.ndarray:
    """The rows of round r: a mix of id, seed and round below the share."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((params.seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) < params.row_share * float(1 << 53)


def _add_up(a: np.ndarray) -> np.ndarray:
    """Sum over the tasks of a barrier stage, in the order of the tasks."""
    context = BarrierTaskContext.get()
    if len(context.getTaskInfos()) == 1:
        return a
    parts = context.allGather(b64encode(np.ascontiguousarray(a).tobytes()).decode())
    return sum(np.frombuffer(b64decode(p), a.dtype).reshape(a.shape) for p in parts)


def _bytes(a: pa.Array) -> np.ndarray:
    """The bytes of a binary array without nulls, one value after the other."""
    a = a.cast(pa.binary())
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[ends[0]:ends[-1]]


def step_tasks(rows: int, most: int, rows_per_task: int | None = None) -> int:
    """Tasks of a step: one more only where there are rows for it."""
    return int(max(1, min(-(-rows // (rows_per_task or ROWS_PER_TASK)), most, MAX_TASKS)))


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once; a barrier stage of more would never begin."""
    context = spark.sparkContext
    scala = context._jsc.sc()
    return max(1, min(context.defaultParallelism, scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())))


def exchange_folder(spark: SparkSession, path: str, tasks: int) -> str | None:
    """A folder below ``path`` in which ``tasks`` tasks see each other's files at once; None where there is none."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    url = urlparse(path)
    if (url.scheme or urlparse(default).scheme) != "file":
        return None
    folder = f"{url.path}/exchange"

    def tried(_):
        context, seconds = BarrierTaskContext.get(), float("inf")
        try:
            files = FileSums(f"{folder}/{trial}", context.partitionId(), tasks, 5.0)
            failed = None
        except OSError as e:
            failed = e
        context.barrier()
        try:
            if failed is None:
                for turn in range(6):
                    if turn == 1:  # the barrier lets tasks go up to a second after each other
                        begun = time.monotonic()
                    if files(np.array([float(turn)]))[0] != turn * tasks:
                        raise OSError("files of others are read wrong")
                seconds = (time.monotonic() - begun) / 5
        except OSError:  # TimeoutError is one
            pass
        yield pa.RecordBatch.from_arrays([pa.array([seconds])], ["seconds"])

    trial = f"trial-{uuid.uuid4().hex}"
    slowest = spark.range(tasks, numPartitions=tasks).mapInArrow(tried, "seconds double", barrier=True).agg(F.max("seconds")).first()[0]
    shutil.rmtree(f"{folder}/{trial}", ignore_errors=True)
    return folder if slowest is not None and slowest <= _QUICK else None


def _grid(weight: float) -> float:
    """A power of two of whose multiples all sums of gradients are exact, as they stay below the sum of weights."""
    return 2.0 ** (math.frexp(max(weight, 1e-30))[1] + 1 - 52)


def _step(n_features: int, first: int, upto: int, params: BoostingParams, add_up=_add_up, folder: str | None = None):
    """The worker of one step: rows in, rows with new margins out, and from the first task the trees."""
    exact_rows = EXACT_ROWS

    def run(batches, add_up=add_up):
        table = [b for b in batches if b.num_rows]
        col = {n: np.concatenate([b.column(i).to_numpy() for b in table] or [np.zeros(0, t)])
               for i, n, t in ((0, "id", np.int64), (2, "y", float), (3, "w", float), (4, "margin", float))}
        bins = np.concatenate([_bytes(b.column(1)) for b in table] or [np.zeros(0, np.uint8)]).reshape(-1, n_features)
        bins = np.asfortranarray(bins)  # a column after the other
        margin, trees = col["margin"].copy(), []
        alone = add_up is not _add_up
        if folder and not alone and (tasks := len((context := BarrierTaskContext.get()).getTaskInfos())) > 1:
            # one folder for each attempt of the stage: the first task names it
            add_up = FileSums(f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}", context.partitionId(), tasks)
        rows, weight = add_up(np.array([len(margin), col["w"].sum()]))
        exact, grid = bool(rows > exact_rows), _grid(weight)
        pairs = joined_columns(bins) if exact else None
        for r in range(first, upto):
            columns = sorted(random.Random(params.seed * 1_000_003 + r).sample(range(n_features), max(1, round(params.column_share * n_features))))
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = col["w"] * (p - col["y"]), col["w"] * np.maximum(p * (1 - p), 1e-16)
            if exact:
                g, h = (np.rint(x / grid) * grid for x in (g, h))
            tree, at = grow(bins, g, h, _drawn(col["id"], r, params), columns, params, add_up, exact, pairs)
            margin += params.step_size * np.array(tree["value"])[at]
            trees.append(json.dumps(tree))
        kinds, first_row = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64()), 0
        for b in table:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(margin[first_row:first_row + n]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
            first_row += n
        if alone or BarrierTaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(trees), k) for k in kinds]
                                             + [pa.array(range(first, upto), pa.int32()), pa.array(trees)], names)

    names = ["id", "bins", "y", "w", "margin", "round", "tree"]
    return run


class Forest:
    """Trees for scoring in batches, in 14 bytes a node: workers get them with the function that scores."""

    def __init__(self, trees: Sequence[dict]):
        self.trees = []
        for t in trees:
            feature, threshold, left, right, value = (np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "value"))
            leaf = feature < 0
            if not np.array_equal(right[~leaf], left[~leaf] + 1):
                raise ValueError("the children of a node must lie side by side")
            # a leaf is its own child and holds its value where others hold their threshold
            left = np.where(leaf, np.arange(len(leaf)), left).astype(np.int32)
            self.trees.append((feature.astype(np.int16), np.where(leaf, value, threshold).astype(float), left))

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values per row of x; a missing value goes right, like one over the threshold."""
        out = np.zeros(len(x))
        cells, begin = x.ravel(), np.arange(len(x)) * x.shape[1]
        for feature, number, left in self.trees:
            at, rows, cell = np.zeros(len(x), np.int64), None, begin
            node, column = at, feature.take(at)
            while not (done := column < 0).all():
                if 2 * np.count_nonzero(done) > len(node):  # go on with the rows that are not in a leaf yet
                    if rows is not None:
                        at[rows] = node
                    else:
                        at = node
                    stay = np.flatnonzero(~done)
                    rows = stay if rows is None else rows[stay]
                    node, cell, column, done = at[rows], begin[rows], column[stay], np.zeros(len(stay), bool)
                low = cells.take(cell + np.maximum(column, 0)) <= number.take(node)
                node = left.take(node) + ~(low | done)
                column = feature.take(node)
            if rows is None:
                at = node
            else:
                at[rows] = node
            out += number.take(at)
        return out


@dataclass
class BoostedModel:
    """A fitted model: its preparation, the trees, the margin before the first and the step size."""

    prep: PipelineModel
    trees: list[dict]
    start: float
    step_size: float

    def _scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        forest, start, step = Forest(self.trees), self.start, self.step_size
        return lambda x: 1.0 / (1.0 + np.exp(-(start + step * forest.total(x))))

    def predict_proba(self, df: DataFrame, out_col: str = "proba") -> DataFrame:
        score = self._scorer()

        @F.pandas_udf("double")
        def proba(x: pd.Series) -> pd.Series:
            return pd.Series(score(np.array(x.tolist(), float).reshape(len(x), -1)))

        return self.prep.transform(df).withColumn(out_col, proba(vector_to_array("features"))).select(*df.columns, out_col)

    def importances(self, n_features: int) -> list[float]:
        """Each feature's share of all gains."""
        total = np.zeros(n_features)
        for t in self.trees:
            f = np.asarray(t["feature"], int)
            total += np.bincount(f[f >= 0], np.asarray(t["gain"], float)[f >= 0], n_features)
        return (total / max(total.sum(), 1e-300)).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        rows = [(i, *[np.asarray(t[k]).tolist() for k in _TREE], self.start, self.step_size) for i, t in enumerate(self.trees)]
        schema = "round int, " + ", ".join(f"{k} array<{v}>" for k, v in _TREE.items()) + ", start double, step_size double"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        rows = spark.read.parquet(f"{path}/trees").orderBy("round").toPandas()
        trees = [{k: r[k] for k in _TREE} for r in rows.to_dict("records")]
        return cls(PipelineModel.load(f"{path}/prep"), trees, float(rows["start"][0]), float(rows["step_size"][0]))


def preparation(features: Sequence[str]) -> Pipeline:
    """Median imputation and assembly into the column ``features``."""
    imputed = [f"__imp_{c}" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=imputed),
                            VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep")])


def _ledger(spark: SparkSession, path: str):
    """The ledger's last line: rounds done, tasks, start margin, cuts and what is fitted; None without a ledger."""
    try:
        return spark.read.parquet(f"{path}/done").orderBy(F.desc("rounds")).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _write_line(spark: SparkSession, path: str, *line) -> None:
    line = spark.createDataFrame([line], "rounds int, tasks int, start double, cuts string, spec string")
    line.coalesce(1).write.mode("append").parquet(f"{path}/done")


def binned_rows(df: DataFrame, features: Sequence[str], key: Sequence[str], label_col: str, weight_col: str | None):
    """(preparation, rows id, bins, y, w, cuts per feature, number of rows, weighted share of label 1)."""
    if df.isEmpty():
        raise ValueError("no rows to fit")
    prep = preparation(features).fit(df)
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = prep.transform(df).select(F.xxhash64(*key).alias("id"), vector_to_array("features").alias("x"),
                                     F.col(label_col).cast("double").alias("y"), w.alias("w"))
    # cuts at equal shares of the values, by sketches of fixed size
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    sketch = F.array(*[F.percentile_approx(F.col("x")[i], shares, 10_000) for i in range(len(features))])
    n, p, cuts = rows.agg(F.count("*"), F.sum(F.col("w") * F.col("y")) / F.sum("w"), sketch).first()
    cuts = [sorted(set(c or [])) for c in cuts]
    edges = [np.array(c) for c in cuts]

    def binned(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edges))
            bins = np.column_stack([np.searchsorted(e, x[:, i]).astype(np.uint8) for i, e in enumerate(edges)])
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(len(edges))
            bins = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([b.column(0), bins, b.column(2), b.column(3)], ["id", "bins", "y", "w"])

    return prep, rows.mapInArrow(binned, "id bigint, bins binary, y double, w double"), cuts, n, p


class Binned:
    """Binned rows written once below ``path`` (when they are first asked for) for fits on the first of some columns."""

    def __init__(self, df: DataFrame, features: Sequence[str], path: str, key: Sequence[str], label_col: str = "label",
                 weight_col: str | None = None):
        self._args, self._path, self._lock, self._made = (df, features, key, label_col, weight_col), path, threading.Lock(), None

    def first(self, k: int):
        """As ``binned_rows`` for the first ``k`` columns; the preparation has all of them, in order."""
        with self._lock:
            if self._made is None:
                prep, rows, cuts, n, p = binned_rows(*self._args)
                rows.write.mode("overwrite").parquet(self._path)
                self._made = prep, rows.sparkSession.read.parquet(self._path), cuts, n, p
        prep, rows, cuts, n, p = self._made
        return prep, rows.withColumn("bins", F.substring("bins", 1, k)), cuts[:k], n, p


def thresholds(trees: list[dict], cuts: list[list[float]]) -> list[dict]:
    """The trees with thresholds in place of bins; beyond the last cut every value is below."""
    table = np.full((len(cuts), BINS), 1e308)
    for i, c in enumerate(cuts):
        table[i, :len(c)] = c
    for t in trees:
        f, b = np.asarray(t["feature"], int), np.asarray(t.pop("bin"), int)
        t["threshold"] = np.where(f < 0, 0.0, table[np.maximum(f, 0), b])
    return trees


def _begin(df: DataFrame, features: Sequence[str], path: str, key: Sequence[str], label_col: str, weight_col: str | None, spec: str,
           most_tasks: int | None, binned: Binned | None) -> str | None:
    """Preparation, cuts and binned rows of round 0, then the ledger's first line; the folder in which tasks exchange files."""
    spark = df.sparkSession
    prep, rows, cuts, n, p = binned.first(len(features)) if binned else binned_rows(df, features, key, label_col, weight_col)
    prep.write().overwrite().save(f"{path}/prep")
    p = min(max(p or 0.0, 1e-6), 1 - 1e-6)
    start = float(np.log(p / (1 - p)))
    rows.withColumn("margin", F.lit(start)).write.mode("overwrite").parquet(f"{path}/steps/rounds=000000")
    most, folder = min(slots(spark), most_tasks or MAX_TASKS), None
    tasks = step_tasks(n, most, min(ROWS_PER_TASK, ROWS_PER_FILE_TASK))
    if tasks > 1 and (folder := exchange_folder(spark, path, tasks)) is None:
        tasks = step_tasks(n, most)
    _write_line(spark, path, 0, tasks, start, json.dumps(cuts), spec)
    return folder


def fit_boosting(df: DataFrame, features: Sequence[str], path: str, key: Sequence[str], label_col: str = "label",
                 weight_col: str | None = None, params: BoostingParams = BoostingParams(),
                 stop_after: int | None = None, most_tasks: int | None = None, binned: Binned | None = None) -> BoostedModel:
    """The model after ``params.rounds`` rounds, resumed from ``path`` if a fit was begun there.

    ``key`` names columns that tell rows apart (their hash draws the rows of a round); ``stop_after``
    ends this call after so many steps; fits side by side take ``most_tasks`` at most, as a step waits until
    all of its tasks can begin.  ``binned``: the rows of ``df``, if its first columns are ``features``."""
    spark, folder = df.sparkSession, None
    spec = json.dumps([asdict(params), list(features), list(key), label_col, weight_col])
    if _ledger(spark, path) is None:
        folder = _begin(df, features, path, key, label_col, weight_col, spec, most_tasks, binned)
    done, tasks, start, cuts, begun = _ledger(spark, path)
    if begun != spec:
        raise ValueError(f"another fit was begun at {path}")
    if tasks > 1 and folder is None and done < params.rounds:
        folder = exchange_folder(spark, path, tasks)
    steps = 0
    while done < params.rounds and (stop_after is None or steps < stop_after):
        upto = min(params.rounds, done + params.step_rounds)
        rows = spark.read.parquet(f"{path}/steps/rounds={done:06d}").where("id is not null").select("id", "bins", "y", "w", "margin")
        rows = rows.repartition(tasks, "id").sortWithinPartitions("id", "y", "w", "bins")
        mine = folder and f"{folder}/{uuid.uuid4().hex}"
        rows = rows.mapInArrow(_step(len(features), done, upto, params, folder=mine), f"{_ROWS}, round int, tree string", barrier=True)
        rows.write.mode("overwrite").parquet(f"{path}/steps/rounds={upto:06d}")
        if mine:
            shutil.rmtree(mine, ignore_errors=True)  # each task's last two files
        _write_line(spark, path, upto, tasks, start, cuts, spec)
        done, steps = upto, steps + 1
    ends = [min(r + params.step_rounds, params.rounds) for r in range(0, done, params.step_rounds)]
    trees = []
    for upto in ends:
        got = spark.read.parquet(f"{path}/steps/rounds={upto:06d}").where("tree is not null").select("round", "tree")
        trees += [json.loads(r.tree) for r in got.orderBy("round").collect()]  # at most 2^depth nodes a round
    return BoostedModel(PipelineModel.load(f"{path}/prep"), thresholds(trees, json.loads(cuts)), start, params.step_size)
