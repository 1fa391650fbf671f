"""Model training, selection and feature ranking.

Logistic regression is a Spark ML pipeline (median Imputer -> VectorAssembler -> StandardScaler ->
classifier); boosted trees and forests are grown on binned features by ``boosting`` and ``forest``.
All take class-balance and fairness weights.
Folds are assigned by hashing ClientID so a client never spans folds.
Only per-model metric rows (a handful of scalars) reach the driver.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairrank.operators.boosting import Binned, BoostedModel, BoostingParams, fit_boosting, slots
from fairrank.operators.curves import score_metrics
from fairrank.operators.forest import ForestModel, ForestParams, fit_forest
from fairrank.operators.order import rank_within
from fairrank.operators.ranking import group_ranking_metrics
from fairrank.sources.tables import materialize, read_dated, table_path, write_dated

# Fixed values, the reference's model settings: LR (L2, balanced, C = 1), RF 400 trees / min leaf 2,
# boosted trees 600 rounds of depth 8 on 0.8 of the rows and columns.
MODEL_DEFAULTS = {
    "logreg": {"C": 1.0, "elasticNetParam": 0.0, "maxIter": 100},
    "rf": {"numTrees": 400, "minInstancesPerNode": 2, "maxDepth": 30},
    "gbt": {"maxIter": 600, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
}
# Names of the settings in Spark ML and in the growers of trees.
_FOREST_NAMES = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "min_leaf"}
_BOOSTING_NAMES = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "step_size", "subsamplingRate": "row_share",
                   "featureSubsetStrategy": "column_share"}
# What models are chosen by.
METRICS = ("pr_auc", "roc_auc", "map_at_k", "recall_at_k")
# Fixed values of the feature curve (400 rounds of up to 96 leaves) and ranking (300 rounds, 64 leaves).
CURVE_PARAMS = {"maxIter": 400, "maxDepth": 7, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
RANKING_PARAMS = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "0.9"}


def grouped_folds(df: DataFrame, k: int = 3, key: str = "ClientID", col: str = "fold", seed: int = 42) -> DataFrame:
    """M9: fold = the first 48 bits of md5(seed|key), modulo k; a key never
    spans folds (folds are hash-balanced, not size-balanced)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return df.withColumn(col, F.pmod(bits, F.lit(k)).cast("int"))


def _dealing(size: int, groups: int, loads: list[int]) -> list[tuple[int, int, list[int]]]:
    """How ``groups`` groups of ``size`` rows go to the lightest fold (the first of several) one after the
    other: (first, last, folds in turn) of the groups' ranks.  Adds to ``loads``."""
    out, at = [], 1
    while at <= groups:
        order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
        # folds within one group of the lightest take turns until they reach the next one
        turn = [f for f in order if loads[f] < loads[order[0]] + size]
        others = [loads[f] for f in order if f not in turn]
        rounds = (groups - at + 1) // len(turn)
        if others:
            rounds = min(rounds, (min(others) - max(loads[f] for f in turn)) // size)
        if rounds > 0:
            for f in turn:
                loads[f] += rounds * size
            out.append((at, at + rounds * len(turn) - 1, turn))
            at += rounds * len(turn)
        else:
            loads[order[0]] += size
            out.append((at, at, order[:1]))
            at += 1
    return out


def balanced_folds(df: DataFrame, k: int = 3, key: str = "ClientID", col: str = "fold") -> DataFrame:
    """M9: (``key``, rows, ``col``): folds of about equal numbers of rows, a key in one fold only.

    Groups go longest first (ties by key) to the lightest fold.  The dealing needs the histogram of group
    sizes alone (at most the root of twice the rows); a group's turn is its rank among those of its size."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    sizes = materialize(sizes, "folds", uuid.uuid4().hex)
    loads, deals = [0] * k, []
    for r in sizes.groupBy("rows").count().orderBy(F.desc("rows")).collect():
        deals += [(r["rows"], *d) for d in _dealing(r["rows"], r["count"], loads)]
    plan = df.sparkSession.createDataFrame(deals, "__size bigint, __first bigint, __last bigint, __turn array<int>")
    ranked = rank_within(sizes, "rows", [F.col(key).asc_nulls_first()], "__nth")
    on = (F.col("rows") == F.col("__size")) & F.col("__nth").between(F.col("__first"), F.col("__last"))
    turn = F.element_at("__turn", ((F.col("__nth") - F.col("__first")) % F.size("__turn") + 1).cast("int"))
    return ranked.join(plan, on).select(key, "rows", turn.alias(col))


def with_balance_weight(df: DataFrame, label_col: str = "label", out_col: str = "weight",
                        base_col: str | None = None) -> DataFrame:
    """E13 as a weight column: positives weigh neg/pos, negatives 1 (times an
    optional fairness weight ``base_col``, M11)."""
    stats = df.agg(F.count_if(F.col(label_col) == 1).alias("__p"), F.count_if(F.col(label_col) == 0).alias("__n"))
    w = F.when(F.col(label_col) == 1, F.when(F.col("__p") > 0, F.col("__n") / F.col("__p")).otherwise(1.0)
               ).otherwise(F.lit(1.0))
    if base_col:
        w = w * F.col(base_col)
    return df.crossJoin(F.broadcast(stats)).withColumn(out_col, w.cast("double")).drop("__p", "__n")


def build_pipeline(kind: str, features: Sequence[str], label_col: str = "label", weight_col: str | None = None,
                   seed: int = 42, total_weight: float | None = None, **params) -> Pipeline:
    """M1-M3: imputation + assembly (+ scaling for LR) + classifier.

    LR takes the inverse penalty ``C`` of a summed loss; Spark averages the
    loss, so ``regParam`` = 1 / (C * ``total_weight``), the sum of the row
    weights of the training data (rows, if unweighted)."""
    imputed = [f"__imp_{c}" for c in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=imputed),
              VectorAssembler(inputCols=imputed, outputCol="__raw", handleInvalid="keep")]
    p = {**MODEL_DEFAULTS[kind], **params}
    common = {"featuresCol": "features", "labelCol": label_col}
    if kind == "logreg":
        if (c := p.pop("C", None)) is not None and "regParam" not in p:
            if not total_weight:
                raise ValueError("logreg with C needs total_weight (or give regParam)")
            p["regParam"] = 1.0 / (c * total_weight)
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
        clf = LogisticRegression(**common, **p)
    else:
        stages[-1].setOutputCol("features")
        clf = (RandomForestClassifier(**common, seed=seed, **p) if kind == "rf"
               else GBTClassifier(**common, seed=seed, **p))
    if weight_col:
        clf.setWeightCol(weight_col)
    return Pipeline(stages=stages + [clf])


def total_weight(df: DataFrame, weight_col: str | None = None) -> float:
    """Sum of the row weights (rows, without a weight column)."""
    return float(df.agg(F.sum(F.col(weight_col) if weight_col else F.lit(1))).first()[0] or 0)


def _renamed(params: dict, names: dict) -> dict | None:
    """The settings under the growers' names; None if one of them only Spark ML has."""
    if set(params) - set(names):
        return None
    return {names[k]: float(v) if names[k].endswith("share") else v for k, v in params.items()}


def fit_model(kind: str, train: DataFrame, features: Sequence[str], weight_col: str | None = None, total: float | None = None,
              path: str | None = None, seed: int = 42, side_by_side: int = 1, binned: Binned | None = None,
              **params) -> PipelineModel | BoostedModel:
    """M1-M3: one model.  Boosted trees and forests are grown by ``boosting`` (resumable below ``path``)
    and ``forest``; a forest over a table beyond its bound, and settings that only Spark ML has, by Spark ML.
    ``side_by_side``: fits that run at the same time, each with its share of the tasks; ``binned``: the rows of
    boosted trees, if several fits share them."""
    spec = {**MODEL_DEFAULTS[kind], **params}
    if kind == "gbt" and (own := _renamed(spec, _BOOSTING_NAMES)) is not None:
        path = path or table_path(train.sparkSession, "models", f"boosting-{uuid.uuid4().hex}")
        most = max(1, slots(train.sparkSession) // side_by_side) if side_by_side > 1 else None
        return fit_boosting(train, features, path, ["ClientID", "ProductID"], weight_col=weight_col,
                            params=BoostingParams(seed=seed, **own), most_tasks=most, binned=binned)
    if kind == "rf" and (own := _renamed(spec, _FOREST_NAMES)) is not None:
        model = fit_forest(train, list(features), ["ClientID", "ProductID"], weight_col=weight_col, params=ForestParams(seed=seed, **own))
        if model is not None:
            return model
    return build_pipeline(kind, features, weight_col=weight_col, total_weight=total, seed=seed, **params).fit(train)


def predict_proba(model: PipelineModel | BoostedModel, df: DataFrame, out_col: str = "proba") -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.predict_proba(df, out_col)
    return model.transform(df).withColumn(out_col, vector_to_array("probability")[1])


def evaluate(model: PipelineModel, df: DataFrame, label_col: str = "label", k: int = 10) -> DataFrame:
    """E9-E12 + E7/E8 of one model on one split (one row).  The predictions
    are written once, as the metrics read them several times."""
    pred = materialize(predict_proba(model, df).select("ClientID", "ProductID", label_col, "proba"),
                       "predictions", uuid.uuid4().hex)
    return score_metrics(pred, label_col, "proba").crossJoin(
        group_ranking_metrics(pred, k, "proba", label_col, "ClientID"))


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known metrics: {', '.join(METRICS)}")


def save_model(model: PipelineModel | BoostedModel, path: str) -> None:
    """M5: write a fitted model to shared storage, next to a line with its kind."""
    spark = SparkSession.getActiveSession()
    if isinstance(model, BoostedModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    spark.createDataFrame([(type(model).__name__,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")


def load_model(path: str) -> PipelineModel | BoostedModel:
    spark = SparkSession.getActiveSession()
    kind = spark.read.parquet(f"{path}/kind").first()[0]
    own = {"BoostedModel": BoostedModel, "ForestModel": ForestModel}
    return own[kind].load(spark, path) if kind in own else PipelineModel.load(path)


def train_and_select(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str],
                     kinds: Sequence[str] = ("logreg", "rf", "gbt"), params: dict | None = None,
                     metric: str = "pr_auc", weight_col: str | None = "weight",
                     fair_col: str | None = None, path: str | None = None) -> tuple[DataFrame, PipelineModel | BoostedModel]:
    """M5: fit every model, pick the best validation ``metric``, score test;
    returns (leaderboard DF, best fitted model).  ``fair_col`` names a
    fairness weight (X8) that multiplies the class balance (M11); boosted
    trees resume below ``path``."""
    params = params or {}
    _check_metric(metric)
    if weight_col:
        train = with_balance_weight(train, out_col=weight_col, base_col=fair_col)
    rows, models = [], {}
    total = total_weight(train, weight_col)
    for kind in kinds:
        m = fit_model(kind, train, features, weight_col, total, path and f"{path}/{kind}", **params.get(kind, {}))
        models[kind] = m
        v = evaluate(m, val).select(*[F.col(c).alias(f"val_{c}") for c in
                                      ("roc_auc", "pr_auc", "logloss", "best_f1", "recall_at_k", "map_at_k")])
        t = evaluate(m, test).select(*[F.col(c).alias(f"test_{c}") for c in ("roc_auc", "pr_auc", "recall_at_k")])
        rows.append(v.crossJoin(t).withColumn("model", F.lit(kind)))
    board = rows[0]
    for r in rows[1:]:
        board = board.unionByName(r)
    board = materialize(board, "leaderboard", uuid.uuid4().hex)
    best = board.orderBy(F.desc(f"val_{metric}"), F.asc("model")).first()["model"]
    return board.withColumn("selected", F.col("model") == best), models[best]


def leaderboard_top(board: DataFrame, metric: str = "val_pr_auc", n: int = 3) -> DataFrame:
    """M6: best ``n`` models by ``metric``."""
    return board.orderBy(F.desc(metric), F.asc("model")).limit(n)


def feature_ranking(df: DataFrame, features: Sequence[str], label_col: str = "label", **gbt_params) -> DataFrame:
    """M7: gain importances of boosted trees, descending."""
    params = BoostingParams(**_renamed(RANKING_PARAMS | gbt_params, _BOOSTING_NAMES))
    path = table_path(df.sparkSession, "models", f"ranking-{uuid.uuid4().hex}")
    imp = fit_boosting(df, features, path, ["ClientID", "ProductID"], label_col, params=params).importances(len(features))
    rows = sorted(zip(features, imp), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                           "feature string, importance double, rank int")


def curve_grid(n_features: int) -> list[int]:
    """M8: every fifth k up to 50 and the number of features (all, if fewer than five)."""
    return list(range(5, min(50, n_features) + 1, 5)) or [n_features]


#: Trials that are fitted side by side.
WORKERS = 8


def run_trials(spark: SparkSession, path: str, trials: dict[str, Callable[[], DataFrame]], workers: int = WORKERS) -> DataFrame:
    """The one-row results of all trials, each with its name as column ``trial``.

    Trials run side by side, as jobs of their own; a trial's row is written below ``path`` when it is done, and a
    trial whose row is there is not run again, so that an interrupted search goes on where it was."""
    done = {n: t for n in trials if (t := read_dated(spark, path, n)) is not None}

    def run(name: str) -> None:
        write_dated(trials[name]().coalesce(1), path, name)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        for f in [pool.submit(inheritable_thread_target(spark)(run), n) for n in trials if n not in done]:
            f.result()
    return spark.read.parquet(path).withColumn("trial", F.col("cutoff").cast("string")).drop("cutoff").where(F.col("trial").isin(list(trials)))


def topk_feature_curve(df: DataFrame, ranked: Sequence[str], ks: Sequence[int] | None = None,
                       folds: int = 3, kind: str = "gbt", path: str | None = None, **params) -> DataFrame:
    """M8: for each k, grouped k-fold CV of a model on the top-k features;
    mean / std (ddof=0) of PR-AUC and ROC-AUC per k; ``best`` flags argmax.
    The fits are trials below ``path`` (see ``run_trials``)."""
    if not ranked:
        raise ValueError("no features to choose from")
    spark = df.sparkSession
    path = path or table_path(spark, "models", f"curve-{uuid.uuid4().hex}")
    d = materialize(grouped_folds(df, folds), "curves", uuid.uuid4().hex)
    # a fold's rows become bins once, for the fits of every k
    bins = [Binned(d.where(F.col("fold") != f), list(ranked), f"{path}-bins/{uuid.uuid4().hex}", ["ClientID", "ProductID"])
            for f in range(folds)]

    def trial(k: int, f: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            fit_on = d.where(F.col("fold") != f)
            m = fit_model(kind, fit_on, list(ranked[:k]), total=total_weight(fit_on), path=f"{path}-fits/k={k}/fold={f}",
                          side_by_side=min(WORKERS, len(sizes) * folds), binned=bins[f], **params)
            scored = materialize(predict_proba(m, d.where(F.col("fold") == f)).select("label", "proba"), "predictions", uuid.uuid4().hex)
            return score_metrics(scored, "label", "proba").select(F.lit(k).alias("k"), F.lit(f).alias("fold"), "pr_auc", "roc_auc")
        return run

    sizes = sorted({min(k, len(ranked)) for k in (ks or curve_grid(len(ranked)))})
    # the longest fits begin first, so that none of them runs on alone at the end
    res = run_trials(spark, path, {f"k={k:03d},fold={f}": trial(k, f) for k in reversed(sizes) for f in range(folds)})
    curve = res.groupBy("k").agg(F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_pop("pr_auc").alias("pr_auc_std"),
                                 F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_pop("roc_auc").alias("roc_auc_std"))
    best = curve.agg(F.max_by("k", F.struct("pr_auc_mean", -F.col("k"))).alias("__best"))
    return curve.crossJoin(best).withColumn("best", F.col("k") == F.col("__best")).drop("__best")


# Fixed values, the reference's search ranges: (kind of draw, low, high).  Spark's trees are at
# most 30 deep; the split size, L2 and gamma parameters have no counterpart in Spark.
SEARCH_SPACES = {
    "logreg": {"C": ("log", 1e-3, 10.0), "maxIter": ("int", 200, 800)},
    "rf": {"numTrees": ("int", 200, 900), "maxDepth": ("int", 6, 30), "minInstancesPerNode": ("int", 1, 10),
           "featureSubsetStrategy": ("share", 0.2, 1.0)},
    "gbt": {"maxIter": ("int", 300, 1200), "maxDepth": ("int", 4, 12), "stepSize": ("log", 0.01, 0.2),
            "subsamplingRate": ("float", 0.5, 1.0), "featureSubsetStrategy": ("share", 0.5, 1.0)},
}


def draw_params(space: dict, rnd: random.Random) -> dict:
    """One parameter set; a ``share`` is a fraction that Spark wants as text."""
    out = {}
    for name, (kind, low, high) in space.items():
        if kind == "int":
            out[name] = rnd.randint(low, high)
        elif kind == "log":
            out[name] = math.exp(rnd.uniform(math.log(low), math.log(high)))
        else:
            x = rnd.uniform(low, high)
            out[name] = f"{x:.4f}" if kind == "share" else x
    return out


@dataclass
class SearchResult:
    """Every trial's mean CV metric, the best parameters, the refitted model and its metrics."""
    trials: DataFrame
    params: dict
    model: PipelineModel
    metrics: DataFrame


def random_search(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], kind: str,
                  metric: str = "pr_auc", n_trials: int = 10, folds: int = 3, seed: int = 42,
                  space: dict | None = None, weigh: Callable[[DataFrame], DataFrame] | None = None,
                  path: str | None = None) -> SearchResult:
    """Seeded random search by the mean ``metric`` of a grouped CV, then a
    refit of the best set on the whole train split, scored on val and test.

    ``weigh`` adds fairness weights (X8) as column ``sample_weight`` to what is
    fitted on, computed anew for each fold (M11); they multiply the class balance.
    Trials run side by side; a search with the same ``path`` goes on where it was (see ``run_trials``)."""
    _check_metric(metric)
    rnd = random.Random(seed)
    space = space or SEARCH_SPACES[kind]
    d = grouped_folds(train, folds, seed=seed)

    def fit(rows: DataFrame, params: dict, side: int) -> PipelineModel:
        weighed = with_balance_weight(weigh(rows) if weigh else rows, base_col="sample_weight" if weigh else None)
        return fit_model(kind, weighed, features, "weight", total_weight(weighed, "weight"), seed=seed, side_by_side=side, **params)

    path = path or table_path(train.sparkSession, "models", f"search-{uuid.uuid4().hex}")
    sets = [draw_params(space, rnd) for _ in range(n_trials)]

    def trial(t: int, f: int) -> Callable[[], DataFrame]:
        return lambda: evaluate(fit(d.where(F.col("fold") != f), sets[t], WORKERS), d.where(F.col("fold") == f)).select(
            F.lit(t).alias("nth"), F.lit(str(sets[t])).alias("params"), F.col(metric).alias("value"))

    out = run_trials(train.sparkSession, path, {f"{t:04d},{f}": trial(t, f) for t in range(n_trials) for f in range(folds)})
    trials = materialize(out.groupBy(F.col("nth").alias("trial"), "params").agg(F.avg("value").alias(f"cv_{metric}")),
                         "search", uuid.uuid4().hex)
    best = sets[trials.orderBy(F.desc(f"cv_{metric}"), F.asc("trial")).first()["trial"]]
    model = fit(train, best, 1)
    scores = [evaluate(model, rows).withColumn("split", F.lit(name)) for name, rows in (("val", val), ("test", test))]
    return SearchResult(trials, best, model, scores[0].unionByName(scores[1]))
