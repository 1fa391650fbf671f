"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query starts from the driver tables of ``sf_dir`` (mapped to the retail
domain by ``fixtures``) and runs the library's operators over the whole
tables.  Floating columns are rounded to 6 places at the very end so the
results compare exactly with the DuckDB oracle (see ``oracle_sql``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from fairrank.functions.columns import round_doubles
from fairrank.plans import fixtures
from fairrank.plans.pipeline import canonical_tables, infer_cutoffs
from fairrank.operators.interactions import load_interactions
from fairrank.sources.store import FeatureStore
from fairrank.sources.tables import bucket_count, materialize, materialize_bucketed, table_path

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


@dataclass
class Context:
    """Lazy per-directory building blocks shared by the queries."""
    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def _memo(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    @property
    def domain(self) -> dict[str, DataFrame]:
        return self._memo("domain", lambda: fixtures.load_domain(self.spark, self.sf_dir))

    @property
    def canonical(self) -> dict[str, DataFrame]:
        return self._memo("canonical", lambda: {
            name: materialize(df, self.sf_dir, f"canonical_{name}") for name, df in canonical_tables(self.domain).items()})

    @property
    def buckets(self) -> int:
        return self._memo("buckets", lambda: bucket_count(self.canonical["transactions"].count()))

    @property
    def joined(self) -> DataFrame:
        """Interactions that are not written yet, dealt by client."""
        def build():
            from fairrank.plans.pipeline import interactions_from_canonical
            return interactions_from_canonical(self.canonical, False, self.buckets)
        return self._memo("joined", build)

    @property
    def prepared(self):
        """(interactions, collapsed, metrics); the interactions table is
        written once as a stage table, in buckets of clients, and the collapse reads it back."""
        def build():
            from fairrank.operators.dedupe import collapse_duplicates
            raw = materialize_bucketed(self.joined, self.sf_dir, "interactions", "ClientID", self.buckets)
            collapsed, metrics = collapse_duplicates(raw, "c_p_d_s")
            return raw, collapsed, metrics
        return self._memo("prepared", build)

    @property
    def interactions(self) -> DataFrame:
        return self.prepared[0]

    @property
    def collapsed(self) -> DataFrame:
        return self.prepared[1]

    @property
    def history(self) -> DataFrame:
        """Collapsed interactions, materialised once per directory in buckets of clients.  Where no
        query has written the interactions, they are collapsed as they come out of the joins."""
        def build():
            from fairrank.operators.dedupe import collapse_duplicates
            collapsed = self.collapsed if "prepared" in self._cache else collapse_duplicates(self.joined, "c_p_d_s")[0]
            return materialize_bucketed(load_interactions(collapsed, None), self.sf_dir, "interactions_collapsed",
                                        "ClientID", self.buckets)
        return self._memo("history", build)

    @property
    def store(self) -> FeatureStore:
        return FeatureStore(self.spark, table_path(self.spark, self.sf_dir, "feature_store"))

    def features(self, cutoff: str) -> dict[str, DataFrame]:
        """F14 from the feature store: user, product, rfm, cp and category tables of a cutoff."""
        from fairrank.operators.features import feature_builders
        return self._memo(("features", cutoff), lambda: {
            name: self.store.get(name, cutoff, lambda build=build: build(self.history, cutoff))
            for name, build in feature_builders().items()})

    @property
    def cutoffs(self):
        return self._memo("cutoffs", lambda: infer_cutoffs(self.history))


_CONTEXTS: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


def query(name: str):
    def deco(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(context(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    # importing the query modules fills QUERIES
    from fairrank.plans import queries_core, queries_more, queries_ops, queries_reco  # noqa: F401
    return dict(QUERIES)
