"""Registered queries: splits, labels, scoring, fairness, evaluation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from fairrank.config import SIGNAL_WEIGHTS, LabelledSplit, Negatives, RecommendCfg
from fairrank.operators import fairness, labels, ranking, scoring
from fairrank.plans.pipeline import infer_cutoffs_frame
from fairrank.plans.recommend import run_recommendations
from fairrank.plans.registry import Context, query
from fairrank.sources.tables import materialize

PAIR = ["ClientID", "ProductID"]
# Split and recommendation settings used by the registered queries (the
# reference CLI defaults: 30-day label window, 5 negatives per positive,
# preferred-category hard negatives, top-10, lambda 0.25, gender groups).
LABEL_DAYS = 30
NEG_PER_POS = 5
TOP_K = 10


SPLITS = ("train", "val", "test")


def split_cfg(ctx: Context, name: str, mode: str = "pop_in_prefcat") -> LabelledSplit:
    return LabelledSplit(name, ctx.cutoffs.for_split(name), LABEL_DAYS, negatives=Negatives(NEG_PER_POS, mode))


def test_cfg(ctx: Context, mode: str = "pop_in_prefcat") -> LabelledSplit:
    return split_cfg(ctx, "test", mode)


def _window(ctx: Context):
    return labels.history_window(ctx.history, ctx.cutoffs.test_end, LABEL_DAYS)


def _split_at(ctx: Context, name: str):
    cfg = split_cfg(ctx, name)
    return ctx._memo(f"split_{name}", lambda: materialize(
        labels.build_split_dataset(ctx.history, cfg, ctx.features(cfg.cutoff)), ctx.sf_dir, f"split_{name}"))


def _split(ctx: Context):
    return _split_at(ctx, "test")


def _splits(ctx: Context) -> dict:
    """All three splits by name.  They are built side by side, as jobs of their own: one's last tasks
    leave cores to the others.  What they share is built before."""
    ctx.history, ctx.cutoffs
    with ThreadPoolExecutor(max_workers=len(SPLITS)) as pool:
        building = [pool.submit(inheritable_thread_target(ctx.spark)(_split_at), ctx, name) for name in SPLITS]
        return {name: b.result() for name, b in zip(SPLITS, building)}


def _each_split(ctx: Context, report):
    """The rows of ``report(split rows, settings)`` for all three splits."""
    out = None
    for name, rows in _splits(ctx).items():
        r = report(rows, split_cfg(ctx, name))
        out = r if out is None else out.unionByName(r)
    return out


def _run(ctx: Context):
    """R9 outputs written as stage tables (scored candidates, base and fair lists)."""
    def build():
        r = run_recommendations(ctx.history, test_cfg(ctx), RecommendCfg(top_k=TOP_K), split=_split(ctx))
        # the split's features are in its own table: with the pairs they would be shuffled by every join
        r.scored = materialize(r.scored.select(*PAIR, "label", "target", "Category", *SIGNAL_WEIGHTS, "hybrid_score"),
                               ctx.sf_dir, "reco_test_scored")
        r.client_groups = materialize(r.client_groups, ctx.sf_dir, "reco_test_client_groups")
        return r.relist(lambda name, df: materialize(df, ctx.sf_dir, f"reco_test_{name}"))
    return ctx._memo("reco_test", build)


# --- splits / labels ----------------------------------------------------------
@query("infer_cutoffs")
def q_cutoffs(ctx: Context):
    """L2: train/val/test cutoffs from the latest transaction."""
    return infer_cutoffs_frame(ctx.history, LABEL_DAYS)


@query("time_split_summary")
def q_time_splits(ctx: Context):
    """L1: rows / clients / products per time split."""
    c = ctx.cutoffs
    return labels.split_summary(labels.split_by_dates(ctx.history, c.train_end, c.val_end, c.test_end))


@query("positives_count_txn")
def q_pos_count(ctx: Context):
    """L3 (count_txn): positive pairs in the test label window with their txn count."""
    _, window = _window(ctx)
    return labels.positives(window, "count_txn")


@query("positives_sum_qty")
def q_pos_qty(ctx: Context):
    """L3 (sum_qty): positive pairs with summed quantity > 0."""
    _, window = _window(ctx)
    return labels.positives(window, "sum_qty")


@query("client_pref_category")
def q_pref_cat(ctx: Context):
    """L4: preferred category per client over the test history."""
    hist, _ = _window(ctx)
    return labels.client_pref_category(hist)


@query("product_popularity")
def q_popularity(ctx: Context):
    """Global and in-category popularity ranks over the test history."""
    hist, _ = _window(ctx)
    return labels.product_popularity(hist)


def _negatives(ctx: Context, mode: str):
    hist, window = _window(ctx)
    return labels.negatives(hist, labels.positives(window, "binary"), NEG_PER_POS, mode, 42)


@query("negatives_pop")
def q_neg_pop(ctx: Context):
    """Globally popular unseen negatives."""
    return _negatives(ctx, "pop")


@query("negatives_pop_in_prefcat")
def q_neg_prefcat(ctx: Context):
    """Preferred-category popular negatives with global backfill."""
    return _negatives(ctx, "pop_in_prefcat")


@query("negatives_none")
def q_neg_none(ctx: Context):
    """Uniform unseen negatives by MD5."""
    return _negatives(ctx, "none")


@query("split_test_dataset")
def q_split(ctx: Context):
    """Labelled test split with u_/p_/cp_/cat_ features."""
    return _split(ctx)


@query("split_summary")
def q_split_summary(ctx: Context):
    """Q18: label-sampling summaries of the three splits."""
    return _each_split(ctx, labels.split_dataset_summary)


@query("split_validation")
def q_split_validation(ctx: Context):
    """A validation row per split (positives in window, negatives unseen, ...)."""
    return _each_split(ctx, lambda ds, cfg: labels.validate_split(ds, ctx.history, cfg))


# --- scoring / fairness -------------------------------------------------------
@query("scored_candidates")
def q_scored(ctx: Context):
    """Hybrid scores of unseen test candidates."""
    r = _run(ctx)
    return r.scored.select(*PAIR, "label", "Category", "affinity_score", "collab_score", "content_score",
                           "popularity_score", "hybrid_score")


@query("recommendations_base")
def q_base(ctx: Context):
    """Top-10 per client by hybrid score."""
    return _run(ctx).base.select(*PAIR, "Category", "hybrid_score", "rank")


@query("recommendations_fair")
def q_fair(ctx: Context):
    """Fairness re-ranked top-10 (flagship)."""
    return _run(ctx).fair.select(*PAIR, "Category", "ClientGender", "hybrid_score", "lift", "fair_score", "rank")


@query("client_groups")
def q_client_groups(ctx: Context):
    """Client -> gender / age / country lookup over the test history."""
    return _run(ctx).client_groups


@query("fairness_exposure_pre")
def q_exposure_pre(ctx: Context):
    """X1 on the base lists."""
    return _run(ctx).audit("pre")[0]


@query("fairness_exposure_post")
def q_exposure_post(ctx: Context):
    """X1 on the re-ranked lists."""
    return _run(ctx).audit("post")[0]


@query("category_parity_pre")
def q_parity_pre(ctx: Context):
    """X4 on the base lists."""
    return _run(ctx).audit("pre")[1]


@query("fairness_summary")
def q_fair_summary(ctx: Context):
    """X3+X5: pre/post parity summary rows."""
    r = _run(ctx)
    return (r.audit("pre")[2].withColumn("variant", F.lit("pre"))
            .unionByName(r.audit("post")[2].withColumn("variant", F.lit("post"))))


def _focus_run(ctx: Context):
    """The test run with Male and Female as the groups its focus audit looks at."""
    r = _run(ctx)
    return replace(r, cfg=replace(r.cfg, fairness_groups=["Male", "Female"]))


@query("fairness_focus_summary")
def q_focus_summary(ctx: Context):
    """R9 focus audit: X3+X5 over the lists of the focus groups alone."""
    r = _focus_run(ctx)
    return (r.audit("pre", focus=True)[2].withColumn("variant", F.lit("pre"))
            .unionByName(r.audit("post", focus=True)[2].withColumn("variant", F.lit("post"))))


@query("category_exposure_matrix")
def q_cat_matrix(ctx: Context):
    """X2 on the base lists."""
    r = _run(ctx)
    wg = fairness.attach_group_labels(r.base, r.client_groups, "ClientGender")
    return fairness.category_exposure_matrix(wg, "ClientGender", "Category")


@query("category_lift")
def q_lift(ctx: Context):
    """Lift table from the base top-10."""
    r = _run(ctx)
    wg = fairness.attach_group_labels(r.base, r.client_groups, "ClientGender")
    return fairness.category_lift_table(wg, "ClientGender", "Category")


@query("sample_weights")
def q_weights(ctx: Context):
    """Inverse-frequency weights for the test split rows (Male/Female eligible)."""
    r = _run(ctx)
    wg = fairness.attach_group_labels(_split(ctx).select(*PAIR, "label"), r.client_groups, "ClientGender")
    return fairness.sample_weights(wg, "ClientGender", ["Male", "Female"])


# --- evaluation -----------------------------------------------------------------
@query("eval_base")
def q_eval_base(ctx: Context):
    """precision/recall/MAP/NDCG/hitrate@10 of the base lists."""
    r = _run(ctx)
    return ranking.evaluate_recommendations(r.base, _split(ctx).select(*PAIR, "label"), TOP_K, "hybrid_score")


@query("eval_base_vs_fair")
def q_eval_cmp(ctx: Context):
    """Base vs fair metrics and delta."""
    return _run(ctx).evaluation()


@query("group_ranking_metrics")
def q_group_metrics(ctx: Context):
    """E7+E8: training-flavour recall@10 and MAP@10 over the split scored by fallback affinity."""
    s = scoring.fallback_affinity(_split(ctx))
    return ranking.group_ranking_metrics(s, TOP_K, "affinity_score", "label", "ClientID")


@query("class_weight")
def q_class_weight(ctx: Context):
    """Negatives / positives of the test split."""
    return ranking.class_imbalance_weight(_split(ctx))
