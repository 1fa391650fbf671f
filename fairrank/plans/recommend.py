"""Recommendation job: split dataset -> hybrid scores -> base top-K ->
fairness re-rank -> pre/post audits -> offline evaluation (R9, E6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.config import LabelledSplit, RecommendCfg
from fairrank.operators import fairness, labels, ranking, scoring


@dataclass
class RecommendationRun:
    scored: DataFrame
    client_groups: DataFrame
    base: DataFrame
    fair: DataFrame
    split: DataFrame
    cfg: RecommendCfg

    def relist(self, sink=None) -> "RecommendationRun":
        """Recompute base / fair lists from ``scored`` (optionally passing each
        through ``sink(name, df)``, e.g. to write them as stage tables)."""
        sink = sink or (lambda name, df: df)
        self.base = sink("base", scoring.top_k(self.scored, self.cfg.top_k, "hybrid_score"))
        self.fair = sink("fair", fairness.rerank_for_exposure_balance(
            self.scored, self.client_groups, self.cfg.group_col, self.cfg.top_k, self.cfg.lambda_fairness,
            "hybrid_score", "Category", self.cfg.fairness_groups))
        return self

    def audit(self, which: str = "pre", focus: bool = False):
        """X5 report of the base (pre) or re-ranked (post) lists; ``focus``
        restricts to the configured fairness groups."""
        g = self.cfg.group_col
        recs, score = (self.base, "hybrid_score") if which == "pre" else (self.fair, "fair_score")
        if focus and self.cfg.fairness_groups is not None:
            recs = fairness.attach_group_labels(recs, self.client_groups, g)
            recs = recs.where(F.col(g).isin(list(self.cfg.fairness_groups)))
        return fairness.fairness_report(recs, self.client_groups, g, "ProductID", "Category", score)

    def evaluation(self) -> DataFrame:
        return ranking.compare_base_vs_fair(self.base, self.fair, self.split.select("ClientID", "ProductID", "label"),
                                            self.cfg.top_k)


def run_recommendations(full: DataFrame, split_cfg: LabelledSplit, cfg: RecommendCfg = RecommendCfg(),
                        split: DataFrame | None = None, model=None) -> RecommendationRun:
    """R9 on one split; ``full`` is the (collapsed) interactions table."""
    split = split if split is not None else labels.build_split_dataset(full, split_cfg)
    history = full.where(F.col("txn_date") <= F.lit(split_cfg.cutoff).cast("timestamp_ntz"))
    scored = scoring.score_hybrid_candidates(split, history, cfg.weights, exclude_seen=True, model=model)
    groups = scoring.client_group_frame(history)
    base = scoring.top_k(scored, cfg.top_k, "hybrid_score")
    fair = fairness.rerank_for_exposure_balance(scored, groups, cfg.group_col, cfg.top_k, cfg.lambda_fairness,
                                               "hybrid_score", "Category", cfg.fairness_groups)
    return RecommendationRun(scored, groups, base, fair, split, cfg)
