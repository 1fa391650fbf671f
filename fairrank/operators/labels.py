"""Time splits, positives, hard negatives and labelled datasets.

Negative sampling never builds the clients x catalog grid.  For a client
with ``b`` blocked products (seen in history or positive) that needs ``n``
negatives, the first ``n + b`` positions of any product order hold at least
``n`` unblocked products.  So each client explodes only ``n + b`` positions,
equi-joins them to the ranked catalog, anti-joins the blocked pairs and keeps
the first ``n`` - work linear in the output plus the client's history.

* ``pop``            order = global popularity (txn count desc, ProductID asc)
* ``pop_in_prefcat`` preferred-category popularity first, then global backfill
* ``none``           a uniform sample without replacement by MD5: hashed draws
                     with rejection where the catalog is large next to the
                     client's demand and history, else the catalog in hash order
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairrank.config import PAIR_FILL_DEFAULTS, PRODUCT_IDENTITY, LabelledSplit
from fairrank.operators import features as feats
from fairrank.operators.order import global_rank, rank_within
from fairrank.sources.tables import materialize

PAIR = ["ClientID", "ProductID"]
# "none" draws by hashed rank where the catalog holds over PROBE_FACTOR (n + b) products: a draw
# then fails with a probability below 1/4, and 2 n + PROBE_SPARE draws nearly always give n.
PROBE_FACTOR = 4
PROBE_SPARE = 64


def _ts(d: str) -> Column:
    return F.lit(d).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# L1 / C10 windows
# ---------------------------------------------------------------------------
def split_by_dates(interactions: DataFrame, train_end: str, val_end: str,
                   test_end: str | None = None) -> DataFrame:
    """L1: label each row train / val / test (later rows dropped).  Writing
    ``partitionBy("split")`` gives one directory per split."""
    if test_end is None:
        test = interactions.agg(F.max("txn_date").alias("__te"))
        df = interactions.crossJoin(F.broadcast(test))  # single-row scalar
        te = F.col("__te")
    else:
        df, te = interactions, _ts(test_end)
    if not (train_end < val_end and (test_end is None or val_end < test_end)):
        raise ValueError(f"split dates out of order: {train_end}, {val_end}, {test_end}")
    t = F.col("txn_date")
    split = (F.when(t <= _ts(train_end), "train")
              .when((t > _ts(train_end)) & (t <= _ts(val_end)), "val")
              .when((t > _ts(val_end)) & (t <= te), "test"))
    out = df.withColumn("split", split).where(F.col("split").isNotNull())
    return out.drop("__te") if test_end is None else out


def split_summary(split_rows: DataFrame) -> DataFrame:
    """L1 summary: rows, clients and products per split."""
    return (split_rows.groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_distinct("ClientID").alias("uniq_clients"),
                 F.count_distinct("ProductID").alias("uniq_products"),
                 F.min("txn_date").alias("min_date"), F.max("txn_date").alias("max_date")))


def history_window(full: DataFrame, cutoff: str, label_days: int) -> tuple[DataFrame, DataFrame]:
    """History ``txn_date <= cutoff``; label window ``(cutoff, cutoff + D]``."""
    t = F.col("txn_date")
    hi = _ts(cutoff) + F.expr(f"INTERVAL {int(label_days)} DAYS")
    return full.where(t <= _ts(cutoff)), full.where((t > _ts(cutoff)) & (t <= hi))


# ---------------------------------------------------------------------------
# L3 positives, L4 preferred category, L5 popularity
# ---------------------------------------------------------------------------
def positives(window: DataFrame, mode: str = "binary") -> DataFrame:
    """L3: one row per (client, product) in the window with label 1 and target."""
    w = window.where(F.col("ClientID").isNotNull() & F.col("ProductID").isNotNull())
    if mode == "binary":
        return w.select(*PAIR).distinct().withColumns({"label": F.lit(1), "target": F.lit(1).cast("bigint")})
    if mode == "count_txn":
        g = w.groupBy(*PAIR).agg(F.count("txn_date").alias("target"))
    elif mode == "sum_qty":
        g = w.groupBy(*PAIR).agg(F.coalesce(F.sum("Quantity"), F.lit(0)).alias("target"))
    else:
        raise ValueError(f"unknown pos_target mode {mode}")
    return g.where(F.col("target") > 0).select(*PAIR, F.lit(1).alias("label"), "target")


def client_pref_category(history: DataFrame) -> DataFrame:
    """L4: most frequent non-NULL category per client; ties -> smallest."""
    cnt = (history.where(F.col("Category").isNotNull() & F.col("ClientID").isNotNull())
                  .groupBy("ClientID", "Category").agg(F.count(F.lit(1)).alias("n")))
    return cnt.groupBy("ClientID").agg(
        F.min_by("Category", F.struct(-F.col("n"), F.col("Category"))).alias("pref_category"))


def product_popularity(history: DataFrame) -> DataFrame:
    """(ProductID, Category, pop, rank, cat_rank) over the history catalog.

    Both ranks come from sampled ranges of the order (see ``order``): neither the
    catalog nor a category that holds most of it is in one task."""
    # counted per category first: an aggregate over text (the largest category) takes no hash table
    prod = (history.where(F.col("ProductID").isNotNull())
                   .groupBy("ProductID", "Category").agg(F.count("txn_date").alias("pop"))
                   .groupBy("ProductID").agg(F.sum("pop").alias("pop"), F.max("Category").alias("Category")))
    order = [F.desc("pop"), F.asc("ProductID")]
    ranked = rank_within(global_rank(prod, order, "rank"), "Category", order, "cat_rank")
    return ranked.select("ProductID", "pop", "Category", F.col("rank").cast("int").alias("rank"),
                         F.when(F.col("Category").isNotNull(), F.col("cat_rank").cast("int")).alias("cat_rank"))


# ---------------------------------------------------------------------------
# L6-L9 negatives and candidates
# ---------------------------------------------------------------------------
def _negative_demand(pos: DataFrame, history: DataFrame, negatives_per_pos: int,
                     cap_negatives: int | None) -> tuple[DataFrame, DataFrame]:
    """(blocked pairs, per-client demand n and blocked count b)."""
    pos_pairs = pos.select(*PAIR)
    pos_clients = pos_pairs.select("ClientID").distinct()
    seen = (history.where(F.col("ClientID").isNotNull() & F.col("ProductID").isNotNull())
                   .select(*PAIR).join(pos_clients, "ClientID", "left_semi"))
    blocked = pos_pairs.unionByName(seen).distinct()
    n = F.col("n_pos") * F.lit(int(negatives_per_pos))
    if cap_negatives is not None:
        n = F.least(n, F.lit(int(cap_negatives)))
    demand = (pos_pairs.groupBy("ClientID").agg(F.count(F.lit(1)).alias("n_pos"))
              .join(blocked.groupBy("ClientID").agg(F.count(F.lit(1)).alias("b")), "ClientID")
              .withColumn("n", n.cast("bigint")))
    return blocked, demand


def _first_unblocked(slots: DataFrame, ranked: DataFrame, join_cols: list[str],
                     blocked: DataFrame, take: Column, order_col: str = "pos") -> DataFrame:
    cand = slots.join(ranked, join_cols).join(blocked, PAIR, "left_anti")
    w = Window.partitionBy("ClientID").orderBy(order_col)
    return cand.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= take).drop("_k")


def _md5_int(*parts: Column) -> Column:
    """The first 48 bits of the MD5 of the parts joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("bigint")


def _random_unblocked(demand: DataFrame, pop: DataFrame, blocked: DataFrame, seed: int) -> DataFrame:
    """Per client a uniform sample of ``n`` unblocked products without replacement.

    Where the catalog holds over ``PROBE_FACTOR`` (n + b) products, a client draws
    2 n + ``PROBE_SPARE`` of them by hashed rank and keeps the first ``n`` different unblocked
    ones.  The others, and the rare client whose draws do not suffice, take the catalog in the
    order of a hash of seed, client and product.  Either way the rows made are in proportion to
    the client's own demand and history, never clients x catalog."""
    sparse = F.col("n_catalog") > F.lit(PROBE_FACTOR) * (F.col("n") + F.col("b"))
    probes = (demand.where(sparse)
              .select("ClientID", "n", "n_catalog", F.explode(F.sequence(
                  F.lit(1).cast("bigint"), 2 * F.col("n") + PROBE_SPARE)).alias("j"))
              .withColumn("rank", (F.pmod(_md5_int(F.lit(seed), F.col("ClientID"), F.col("j")), F.col("n_catalog")) + 1).cast("int"))
              .groupBy("ClientID", "n", "rank").agg(F.min("j").alias("j")))
    drawn = _first_unblocked(probes, pop.select("rank", "ProductID"), ["rank"], blocked, F.col("n"), "j")
    served = drawn.groupBy("ClientID").agg(F.count(F.lit(1)).alias("m"))
    rest = demand.join(served, "ClientID", "left").where(F.coalesce(F.col("m"), F.lit(0)) < F.col("n"))
    drawn = drawn.join(rest.select("ClientID"), "ClientID", "left_anti")
    slots = rest.select("ClientID", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_catalog"))).alias("rank"))
    hashed = (slots.join(pop.select("rank", "ProductID"), "rank")
              .withColumn("j", _md5_int(F.lit(seed), F.col("ClientID"), F.col("ProductID"))).drop("rank")
              .join(blocked, PAIR, "left_anti"))
    w = Window.partitionBy("ClientID").orderBy("j", "ProductID")
    ordered = hashed.withColumn("neg_order", F.row_number().over(w)).where(F.col("neg_order") <= F.col("n"))
    first = drawn.withColumn("neg_order", F.row_number().over(Window.partitionBy("ClientID").orderBy("j")))
    cols = ["ClientID", "ProductID", "neg_order"]
    return first.select(*cols).unionByName(ordered.select(*cols))


def _stage(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, "splits", f"{name}-{uuid.uuid4().hex}")


def negatives(history: DataFrame, pos: DataFrame, negatives_per_pos: int = 5,
              hard_mode: str = "pop_in_prefcat", seed: int = 42,
              cap_negatives: int | None = None) -> DataFrame:
    """Negatives (label 0) per client with positives.  Columns:
    ClientID, ProductID, label, neg_order (1 = first choice)."""
    if hard_mode not in ("none", "pop", "pop_in_prefcat"):
        raise ValueError(f"unknown hard negative mode {hard_mode}")
    blocked, demand = _negative_demand(pos, history, negatives_per_pos, cap_negatives)
    # each is read several times below
    blocked, demand = _stage(blocked, "blocked"), _stage(demand, "demand")
    pop = _stage(product_popularity(history), "popularity")
    n_cat = pop.agg(F.count(F.lit(1)).alias("n_catalog"))
    demand = demand.crossJoin(F.broadcast(n_cat)).where(F.col("n") > 0)  # single-row scalar
    depth = F.least(F.col("n") + F.col("b"), F.col("n_catalog"))

    if hard_mode == "pop":
        slots = demand.select("ClientID", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), depth)).alias("rank"))
        out = _first_unblocked(slots, pop.select("rank", "ProductID"), ["rank"], blocked, F.col("n"), "rank")
        return out.select("ClientID", "ProductID", F.lit(0).alias("label"),
                          F.row_number().over(Window.partitionBy("ClientID").orderBy("rank")).alias("neg_order"))

    if hard_mode == "none":
        out = _random_unblocked(demand, pop, blocked, seed)
        return out.select("ClientID", "ProductID", F.lit(0).alias("label"), "neg_order")

    # pop_in_prefcat: tier 0 inside the preferred category, tier 1 global backfill
    pref = client_pref_category(history)
    cat_size = pop.where(F.col("Category").isNotNull()).groupBy("Category").agg(F.count(F.lit(1)).alias("cs"))
    d0 = (demand.join(pref, "ClientID").join(cat_size, F.col("pref_category") == F.col("Category"))
                .select("ClientID", "n", "b", F.col("pref_category").alias("Category"), "cs"))
    slots0 = d0.select("ClientID", "n", "Category",
                       F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n") + F.col("b"), F.col("cs"))))
                        .alias("cat_rank"))
    tier0 = _first_unblocked(slots0, pop.select("Category", "cat_rank", "ProductID", "rank"),
                             ["Category", "cat_rank"], blocked, F.col("n"), "cat_rank")
    tier0 = tier0.select("ClientID", "ProductID", F.lit(0).alias("tier"), F.col("cat_rank").alias("ord"))
    chosen = tier0.groupBy("ClientID").agg(F.count(F.lit(1)).alias("m"))
    d1 = demand.join(chosen, "ClientID", "left").withColumn("need", F.col("n") - F.coalesce("m", F.lit(0)))
    d1 = d1.where(F.col("need") > 0)
    slots1 = d1.select("ClientID", "need", F.explode(F.sequence(F.lit(1).cast("bigint"), depth)).alias("rank"))
    blocked1 = blocked.unionByName(tier0.select(*PAIR))
    tier1 = _first_unblocked(slots1, pop.select("rank", "ProductID"), ["rank"], blocked1, F.col("need"), "rank")
    tier1 = tier1.select("ClientID", "ProductID", F.lit(1).alias("tier"), F.col("rank").alias("ord"))
    both = tier0.unionByName(tier1)
    w = Window.partitionBy("ClientID").orderBy("tier", "ord")
    return both.select("ClientID", "ProductID", F.lit(0).alias("label"), F.row_number().over(w).alias("neg_order"))


def build_candidates(history: DataFrame, window: DataFrame, negatives_per_pos: int = 5,
                     hard_mode: str = "pop_in_prefcat", seed: int = 42,
                     cap_negatives: int | None = None) -> DataFrame:
    """All positive pairs (label 1) plus sampled negatives (label 0)."""
    pos = positives(window, "binary")
    neg = negatives(history, pos, negatives_per_pos, hard_mode, seed, cap_negatives)
    return pos.select(*PAIR, "label").unionByName(neg.select(*PAIR, "label"))


# ---------------------------------------------------------------------------
# L10-L11 labelled dataset
# ---------------------------------------------------------------------------
def _prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select([F.col(c) if c in keep or c.startswith(prefix) else F.col(c).alias(prefix + c)
                      for c in df.columns])


def assemble_dataset(candidates: DataFrame, window: DataFrame, features: dict[str, DataFrame],
                     pos_mode: str = "binary") -> DataFrame:
    """Candidates + prefixed features + calibrated target + fills + clip.

    Product attribute duplicates (lower-case category etc.) are dropped in
    favour of the category table's columns; pair columns are prefixed once."""
    uf = _prefixed(features["user"], "u_", ("ClientID",))
    pf = features["product"].drop("category", "family_lvl1", "family_lvl2", "universe")
    pf = _prefixed(pf, "p_", PRODUCT_IDENTITY)
    cpf = _prefixed(features["cp"], "cp_", tuple(PAIR))
    catf = features["category"]
    pos_cal = positives(window, pos_mode).select(*PAIR, F.col("target").alias("_pos_target"))
    # pairs meet the narrowest tables first: what each join shuffles again is as narrow as can be
    df = (candidates.join(cpf, PAIR, "left")
                    .join(pos_cal, PAIR, "left")
                    .join(pf, "ProductID", "left")
                    .join(catf, "ProductID", "left")
                    .join(uf, "ClientID", "left"))
    order = [c for part in (candidates, uf, pf, catf, cpf, pos_cal) for c in part.columns]
    df = df.select(*PAIR, *[c for c in dict.fromkeys(order) if c not in PAIR])
    if pos_mode == "binary":
        df = df.withColumn("target", F.col("label").cast("bigint"))
    else:
        df = df.withColumn("target", F.coalesce(F.col("_pos_target"), F.lit(0)).cast("bigint"))
    df = df.drop("_pos_target").fillna({k: v for k, v in PAIR_FILL_DEFAULTS.items() if k in df.columns})
    return feats.clip_nonnegative_prefixed(df)


def build_split_dataset(full: DataFrame, cfg: LabelledSplit, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """history/window -> candidates -> features at the cutoff -> dataset.

    ``stored``: the feature tables of the cutoff (user, product, cp, category), as
    a feature store holds them.  Without them they are built here; user and pair
    features, which depend on a client's own rows alone, for the clients that
    have candidates."""
    history, window = history_window(full, cfg.cutoff, cfg.days)
    cand = _stage(build_candidates(history, window, cfg.negatives.per_positive, cfg.negatives.order,
                                   cfg.negatives.seed, cfg.negatives.most), "candidates")
    if stored is not None:
        return assemble_dataset(cand, window, stored, cfg.target)
    theirs = full.join(cand.select("ClientID").distinct(), "ClientID", "left_semi")
    fts = {
        "user": feats.user_features(theirs, cfg.cutoff),
        "product": feats.product_features(full, cfg.cutoff),
        "cp": feats.client_product_recency(theirs, cfg.cutoff),
        "category": feats.category_features(full, cfg.cutoff),
    }
    return assemble_dataset(cand, window, fts, cfg.target)


def split_dataset_summary(ds: DataFrame, cfg: LabelledSplit) -> DataFrame:
    """Q18: label-sampling counts for one split."""
    return ds.agg(
        F.lit(cfg.name).alias("split"), F.lit(cfg.cutoff).alias("cutoff"),
        F.lit(cfg.days).alias("label_days"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("ClientID").alias("clients"),
        F.count_distinct("ProductID").alias("products"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.lit(float(cfg.negatives.per_positive)).alias("neg_per_pos"),
        F.lit(cfg.negatives.order).alias("hard_negatives"),
        F.lit(cfg.target).alias("pos_target"))


def target_differences(ds: DataFrame, window: DataFrame, mode: str = "binary") -> DataFrame:
    """The dataset's positive pairs against the targets recomputed from the label window, by a null-safe
    keyed difference: ClientID, ProductID, change (changed, missing or surplus in the dataset), old_target, new_target."""
    old = ds.where("label = 1").select(*PAIR, F.col("target").alias("old_target"), F.lit(True).alias("__a"))
    new = positives(window, mode).select(F.col("ClientID").alias("__c"), F.col("ProductID").alias("__p"),
                                         F.col("target").cast("bigint").alias("new_target"), F.lit(True).alias("__b"))
    both = old.join(new, F.col("ClientID").eqNullSafe(F.col("__c")) & F.col("ProductID").eqNullSafe(F.col("__p")), "full")
    change = (F.when(F.col("__a").isNull(), "missing").when(F.col("__b").isNull(), "surplus")
               .when(~F.col("old_target").eqNullSafe(F.col("new_target")), "changed"))
    return both.withColumn("change", change).where("change is not null").select(
        F.when(F.col("__a").isNull(), F.col("__c")).otherwise(F.col("ClientID")).alias("ClientID"),
        F.when(F.col("__a").isNull(), F.col("__p")).otherwise(F.col("ProductID")).alias("ProductID"),
        "change", "old_target", "new_target")


# ---------------------------------------------------------------------------
# L12-L15 split validation
# ---------------------------------------------------------------------------
def validate_split(ds: DataFrame, full: DataFrame, cfg: LabelledSplit) -> DataFrame:
    """L15 (+Q16, L12, L13, J10, Q17, L14) as one row.  History / window use
    the builder's own boundary rule (``<= cutoff`` / ``(cutoff, cutoff+D]``)."""
    history, window = history_window(full, cfg.cutoff, cfg.days)
    pos = ds.where(F.col("label") == 1)
    neg = ds.where(F.col("label") == 0)
    win_pairs = window.select(*PAIR).distinct()
    basic = ds.agg(F.count(F.lit(1)).cast("double").alias("rows"),
                   F.count_distinct("ClientID").cast("double").alias("clients"),
                   F.count_distinct("ProductID").cast("double").alias("products"),
                   F.count_if(F.col("label") == 1).cast("double").alias("positives"),
                   F.count_if(F.col("label") == 0).cast("double").alias("negatives"))
    basic = basic.withColumn("pos_ratio", F.col("positives") / F.greatest(F.col("rows"), F.lit(1.0)))
    extra = (pos.select(*PAIR).distinct().join(win_pairs, PAIR, "left_anti")
                .agg(F.count(F.lit(1)).cast("double").alias("pos_not_in_window")))
    seen = history.select(*PAIR).distinct()
    negs = neg.select(*PAIR).distinct()
    viol = negs.join(seen, PAIR, "left_semi").agg(F.count(F.lit(1)).cast("double").alias("neg_seen_violations"))
    checked = negs.agg(F.count_distinct("ClientID").cast("double").alias("clients_checked"))
    if cfg.target == "binary":
        tgt = pos.agg(F.count_if(F.col("target") != 1).cast("double").alias("target_mismatch_pairs"))
    else:
        truth = (window.groupBy(*PAIR).agg(
            (F.count("txn_date") if cfg.target == "count_txn" else F.coalesce(F.sum("Quantity"), F.lit(0)))
            .alias("true_target")))
        tgt = (pos.join(truth, PAIR, "left")
                  .agg(F.count_if(~F.col("target").eqNullSafe(F.coalesce(F.col("true_target"), F.lit(0))))
                        .cast("double").alias("target_mismatch_pairs")))
    blocks = {b: [c for c in ds.columns if c.startswith(b + "_")] for b in ("u", "p", "cp", "cat")}
    null_aggs = []
    for b, cs in blocks.items():
        if cs:
            share = sum(F.avg(F.col(c).isNull().cast("double")) for c in cs) / len(cs)
        else:
            share = F.lit(0.0)
        null_aggs.append(share.alias(f"{b}_null_share"))
    nulls = ds.agg(*null_aggs)
    dups = (ds.groupBy(*PAIR).count().where("count > 1")
              .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("pair_duplicates")))
    row = basic
    for part in (extra, viol, checked, tgt, nulls, dups):
        row = row.crossJoin(part)  # every part is a single-row aggregate
    return row.select(
        F.lit(cfg.name).alias("split"), F.lit(cfg.cutoff).alias("cutoff"),
        F.lit(float(cfg.days)).alias("label_days"), F.lit(cfg.target).alias("pos_target"),
        "rows", "clients", "products", "positives", "negatives", "pos_ratio",
        (F.col("pos_not_in_window") == 0).alias("pos_in_window_ok"), "pos_not_in_window",
        (F.col("neg_seen_violations") == 0).alias("neg_not_seen_ok"), "neg_seen_violations", "clients_checked",
        (F.col("target_mismatch_pairs") == 0).alias("target_check_ok"), "target_mismatch_pairs",
        "u_null_share", "p_null_share", "cp_null_share", "cat_null_share",
        (F.col("pair_duplicates") == 0).alias("pair_unique_ok"), "pair_duplicates")
