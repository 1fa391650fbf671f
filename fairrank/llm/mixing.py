"""Mixing sources to target weights by Pareto order sampling.

Sources are ordered by code point (null last); weights repeat over them.  Targets share all
words of the corpus by weight, but none goes above ``MAX_REPEAT`` times its source's size; the
excess is reshared by weight until none is above.

A document's expected copies are in proportion to its size, at most ``MAX_REPEAT``, so that those of
a source add up to its target in words.  The whole part of them are certain copies; what is left, below
1, is the document's own inclusion probability p.  The rest is a Pareto order sample: documents rank
by the odds of a random number over the odds of p, and the lowest ranks are taken while their words
fit the rest of the target.  The document that no longer fits is passed over, and the documents
after it that fit what is left go on in the same order (``SAMPLE_ROUNDS`` times).  One more document
closes the gap if that comes nearer: of those not sampled, the one whose size is nearest to it.  The
random number is a hash of id and text, so reruns agree.

The cut in a source's order is found without sorting it: ranks are integers, and histograms of
twelve of their bits at a time (pre-aggregated map-side) narrow the place where the running sum
of words passes the rest, until a few rows are left per source.  A source with a third of all
rows is never in one task, and neither are all sources: their order comes from sampled ranges, their
targets from repeated sums.

Defined results: null text has size 0; null source is a source; a document of size 0 takes 0
words and has no copies; a source of size 0 has target 0; with no words at all every target is 0;
repeated rows are separate rows; an empty table gives an empty table; input columns other than the
text may be carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairrank.llm.common import pick, positional, staged
from fairrank.operators.order import global_rank

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
WORD = r"[^\x20\x09-\x0D]+"
RANK_BITS = 48
DIGIT_BITS = 12
#: Rows a source may have left undecided before they are ordered in one window.
FEW_ROWS = 4096
SAMPLE_ROUNDS = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, filled up like
    water under the caps.  Runs over sources, not documents."""
    ranked = global_rank(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "nth")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    wide = "decimal(38,0)"
    s = ranked.select("source", "source_size", w.cast(wide).alias("w"), (F.col("source_size") * max_repeat).cast(wide).alias("cap"))
    s = staged(s, "sources")
    words, rest_w = s.agg(F.sum("source_size"), F.sum("w")).first()
    words, rest_w = int(words or 0), int(rest_w or 0)
    rest = words
    while True:  # those above their share of what is left are capped, until none is
        above = F.col("cap") * F.lit(rest_w).cast(wide) <= F.lit(rest).cast(wide) * F.col("w")
        caps, left = s.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        now = (words - int(caps or 0), int(left or 0))
        if now == (rest, rest_w):
            break
        rest, rest_w = now
    share = F.lit(float(rest)) * F.col("w").cast("double") / F.lit(float(max(rest_w, 1)))
    return s.select("source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(share).alias("target"))


def copies_per_word(docs: DataFrame, plan: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(s0, per_word): expected copies per word of each source's documents, null where all have ``max_repeat``.

    From the counts of each size: documents from some size on have ``max_repeat`` copies, the others share
    what is left of the target in proportion to their size."""
    wide = "decimal(38,0)"
    cells = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    words, squares = F.col("n").cast(wide) * F.col("size"), F.col("n").cast(wide) * F.col("size") * F.col("size")
    cells = cells.select("source", "size", words.cast(wide).alias("words"), squares.cast(wide).alias("squares"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("source", "size", F.coalesce(F.sum("words").over(larger), F.lit(0)).cast("double").alias("capped"),
                         F.sum("squares").over(smaller).cast("double").alias("open"))
    t = plan.select(F.col("source").alias("s1"), "target")
    per = (F.col("target") - max_repeat * F.col("capped")) / F.col("open")
    cells = cells.join(t, F.col("source").eqNullSafe(F.col("s1"))).withColumn("per", per)
    return cells.where(F.col("per") * F.col("size") < max_repeat).groupBy(F.col("source").alias("s0")).agg(
        F.max_by("per", "size").alias("per_word"))


def unit_random(*parts: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(1 << 48)


def rank_key(u: Column, p: Column) -> Column:
    """The Pareto rank q = odds(u) / odds(p) as the integer part of 2^48 q / (1 + q)."""
    q = (u / (1.0 - u)) / (p / (1.0 - p))
    return F.least(F.floor(q / (q + 1.0) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("bigint")


def _cut(docs: DataFrame) -> DataFrame:
    """(source, last, low, gap): the last (key, row) each source's sample takes, null if it takes
    none of the rows from ``low`` on, and the words that are left.  ``docs``: source, rest (words
    to take), size, key, row."""
    digits = [(c, s) for c, bits in (("key", RANK_BITS), ("row", 64))
              for s in reversed(range(0, bits, DIGIT_BITS))]
    open_rows = docs.withColumn("before", F.lit(0).cast("bigint"))
    for column, shift in digits:
        most = open_rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None or most <= FEW_ROWS:
            break
        digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        cells = open_rows.groupBy("source", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("upto", F.col("start") + F.sum("words").over(run))
        # the cell in which the sum passes the rest, or the last one
        last = Window.partitionBy("source").orderBy("hit", F.when(F.col("hit") == 0, F.col("digit")).otherwise(-F.col("digit")))
        at = (cells.withColumn("hit", (F.col("upto") < F.col("rest")).cast("int"))
              .withColumn("o", F.row_number().over(last)).where("o = 1")
              .select(F.col("source").alias("s2"), F.col("digit").alias("d2"), (F.col("upto") - F.col("words")).alias("b2")))
        same = F.col("source").eqNullSafe(F.col("s2")) & (digit == F.col("d2"))
        open_rows = staged(open_rows.join(at, same).select("source", "rest", "size", "key", "row",
                                                           F.col("b2").alias("before")), "open-rows")
    order = Window.partitionBy("source").orderBy("key", "row")
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    c = open_rows.withColumn("b", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    fits = F.col("b") + F.col("size") <= F.col("rest")
    me = F.struct("key", "row")
    return c.groupBy("source").agg(
        F.max(F.when(fits, me)).alias("last"), F.min(me).alias("low"),
        (F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("b") + F.col("size"))), F.min("b"))).alias("gap"))


def mix_sources(documents: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
                max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, source, carried columns, size, source_size, target, copies, taken) per document."""
    names = [id_col, source_col, text_col, *carry]
    kept = [f"_k{i}" for i in range(len(carry))]
    docs = pick(documents, names).toDF("doc_id", "source", "text", *kept)
    docs = staged(docs.select(
        "doc_id", "source", *kept, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        unit_random(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("u"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    plan = staged(plan, "targets")

    def with_plan(d: DataFrame, other: DataFrame, key: str) -> DataFrame:
        return d.join(other.withColumnRenamed("source", key), F.col("source").eqNullSafe(F.col(key)), "left").drop(key)

    per = copies_per_word(docs, plan, max_repeat)
    docs = with_plan(with_plan(docs, plan, "s1"), per.withColumnRenamed("s0", "source"), "s2")
    most = F.lit(float(max_repeat))
    c = F.when(F.col("size") == 0, 0.0).when(F.col("per_word").isNull(), most).otherwise(F.least(F.col("per_word") * F.col("size"), most))
    docs = staged(docs.withColumn("c", c).withColumn("whole", F.floor("c").cast("bigint")).withColumn("p", F.col("c") - F.floor("c"))
                  .drop("c", "per_word"), "copies")
    certain = docs.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    ranked = with_plan(docs, certain, "s3").withColumn("rest", F.col("target") - F.col("certain")).drop("certain")
    ranked = ranked.withColumn("key", F.when(F.col("p") > 0, rank_key(F.col("u"), F.col("p"))))
    out = staged(ranked.drop("u").withColumn("sampled", F.lit(False)), "ranked")
    me = F.struct("key", "row")
    for k in range(SAMPLE_ROUNDS):
        # later rounds go on with what the documents that were too long for the rest have left
        open_rows = out.where((F.col("p") > 0) & ~F.col("sampled") & (F.col("size") <= F.col("rest")))
        cut = staged(_cut(open_rows.select("source", "rest", "size", "key", "row")), f"cut-{k}")
        upto = F.when(F.col("last").isNotNull(), me <= F.col("last")).otherwise(me < F.col("low"))
        more = (F.col("p") > 0) & (F.col("size") <= F.col("rest")) & upto
        out = with_plan(out, cut, "s3").withColumn("sampled", F.col("sampled") | F.coalesce(more, F.lit(False)))
        out = out.withColumn("rest", F.coalesce("gap", "rest")).drop("last", "low", "gap")
    out = staged(out, "sampled")
    near = F.struct(F.abs(F.col("rest") - F.col("size")).alias("off"), "key", "row")
    closing = (out.where((F.col("p") > 0) & ~F.col("sampled")).groupBy("source")
               .agg(F.min(near).alias("c"), F.first("rest").alias("g")).where("c.off < g").drop("g"))
    out = with_plan(out, closing, "s4")
    extra = F.col("sampled") | F.coalesce(me == F.struct("c.key", "c.row"), F.lit(False))
    out = out.withColumn("copies", F.col("whole") + extra.cast("bigint"))
    return out.select("doc_id", "source", *[F.col(k).alias(c) for k, c in zip(kept, carry)], "size", "source_size",
                      "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: every row of the documents, whole, as often as its copies say.  Rows are told
    apart by a number, so null and repeated ids are rows like any other; the text is written once."""
    flat, at = positional(documents)
    flat = staged(flat.withColumn("_row", F.monotonically_increasing_id()), "documents")
    plan = mix_sources(flat, ("_row",), at[id_col], at[text_col], at[source_col], weights, max_repeat)
    plan = plan.where("copies > 0").select("_row", F.sequence(F.lit(1), F.col("copies").cast("int")).alias("_times"))
    both = flat.join(plan, "_row").withColumn("_i", F.explode("_times"))
    return both.drop("_row", "_times", "_i").toDF(*documents.columns)
