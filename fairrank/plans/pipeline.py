"""End-to-end jobs composing the operators (lazy DataFrames throughout).

ingest -> canonical tables -> interactions -> collapse -> features at a
cutoff -> labelled splits -> scoring -> top-K -> fairness re-rank -> audit /
evaluation.  Only small scalars (cutoff dates) are ever pulled to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.config import Cutoffs
from fairrank.operators.dedupe import collapse_duplicates, dedupe_table
from fairrank.operators.interactions import build_interactions, drop_orphans
from fairrank.sources.contracts import CONTRACTS, ingest_frame


def canonical_tables(domain: dict[str, DataFrame], fix: bool = False,
                     validate: bool = False, orphans: bool = True) -> dict[str, DataFrame]:
    """S1 over already-loaded frames: contract coercion + value normalisation;
    stocks limited to known products; optional table-aware dedupe (U5).  Without
    ``orphans`` only transactions of known clients, products and stores stay (J3)."""
    out = {}
    for name in ("clients", "products", "stores", "transactions", "stocks"):
        known = out.get("products") if name == "stocks" else None
        df = ingest_frame(domain[name], CONTRACTS[name], known_products=known,
                          raise_on_error=validate)
        if fix:
            df = dedupe_table(name, df, list(CONTRACTS[name].primary_key) or None)
        out[name] = df
    if not orphans:
        out["transactions"] = drop_orphans(out["transactions"], out["clients"], out["products"], out["stores"])
    return out


def interactions_from_canonical(tables: dict[str, DataFrame], validate: bool = True,
                                client_partitions: int | None = None) -> DataFrame:
    return build_interactions(tables["transactions"], tables["clients"], tables["products"],
                              tables["stores"], tables["stocks"], validate=validate, client_partitions=client_partitions)


def prepared_interactions(domain: dict[str, DataFrame], level: str = "c_p_d_s",
                          validate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw interactions, collapsed interactions, collapse metrics)."""
    tables = canonical_tables(domain)
    raw = interactions_from_canonical(tables, validate=validate)
    collapsed, metrics = collapse_duplicates(raw, level)
    return raw, collapsed, metrics


def infer_cutoffs_frame(interactions: DataFrame, label_days: int = 30) -> DataFrame:
    """L2 as a one-row frame: test_end = max - D, val_end = max - 2D,
    train_end = max - 3D, each truncated to midnight."""
    mx = interactions.agg(F.max("txn_date").alias("mx"))
    return mx.select(*[
        F.to_date(F.col("mx") - F.expr(f"INTERVAL {k * label_days} DAYS")).cast("timestamp_ntz").alias(name)
        for name, k in (("train_end", 3), ("val_end", 2), ("test_end", 1))])


def infer_cutoffs(interactions: DataFrame, label_days: int = 30) -> Cutoffs:
    """L2: the three cutoffs as dates (one scalar row to the driver)."""
    row = infer_cutoffs_frame(interactions, label_days).first()
    if row is None or row["test_end"] is None:
        raise ValueError("no cutoffs: every txn_date is null")
    def fmt(v):
        return v.date().isoformat() if isinstance(v, _dt.datetime) else v.isoformat()
    return Cutoffs(fmt(row["train_end"]), fmt(row["val_end"]), fmt(row["test_end"]))
