"""Global order without one task: ranks, running positions and exact quantiles.

Rows are dealt by sampled ranges of the order and written once, so that a row's place is its place
inside its file plus the rows of the ranges before.  Only one number per range (and group at a
border) is added up outside of tasks that share the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fairrank.sources.tables import materialize


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in a written table with __at: range number in the high bits, place in the range in the low 33."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "order", uuid.uuid4().hex)


def _offsets(parts: list[tuple]) -> list[tuple]:
    """Running totals of (range, total) before each range."""
    out, before = [], 0
    for part, total in sorted(parts):
        out.append((part, before))
        before += int(total)
    return out


def _before(df: DataFrame, offsets: list[tuple], value: Column, out: str) -> DataFrame:
    schema = StructType([StructField("__part", LongType()), StructField("__off", LongType())])
    small = df.sparkSession.createDataFrame(offsets, schema)  # a row per range
    joined = df.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(small), "__part")
    return joined.withColumn(out, F.col("__off") + value).drop("__part", "__off")


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """``row_number`` over the whole table.  ``order`` must be total for a defined result."""
    rows = _placed(df, order)
    part = F.shiftright("__at", 33)
    counts = [tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()]  # a row per range
    place = F.col("__at") - F.shiftleft(part, 33)
    return _before(rows, _offsets(counts), place + 1, out).drop("__at")


def rank_within(df: DataFrame, group: str, order: Sequence[Column], out: str) -> DataFrame:
    """``row_number`` within ``group``, also where one group holds most rows; null is a group.

    Groups lie one after the other in the global order, so a rank is the distance to the group's first row."""
    placed = global_rank(df, [F.col(group).asc_nulls_first(), *order], "__pos")
    first = placed.groupBy(F.col(group).alias("__g")).agg(F.min("__pos").alias("__first"))
    return (placed.join(first, F.col(group).eqNullSafe(F.col("__g")), "left")
            .withColumn(out, F.col("__pos") - F.col("__first") + 1).drop("__pos", "__g", "__first"))


def cuts_upto(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(float(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def exact_quantiles(values: DataFrame, probs: Sequence[float], out: str = "q", weight: str | None = None) -> DataFrame:
    """(grp, n, ``out`` array): quantiles with linear interpolation, as ``percentile`` gives them.

    ``values``: grp (any type, null is a group) and value (double); null values don't count, and a row
    counts as often as its column ``weight`` says, if that is given.  Equal
    values are counted first (pre-aggregated map-side); the wanted places are looked up where the
    running count passes them, so neither a group's values nor its distinct values are gathered."""
    counts = values.where("value is not null").groupBy("grp", "value").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    rows = _placed(counts, [F.col("grp").asc_nulls_first(), F.col("value").asc()])
    part = F.shiftright("__at", 33)
    sums = [tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.sum("n")).collect()]  # a row per range
    from pyspark.sql import Window
    inside = Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__p", part).withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("__p")
    rows = _before(rows, _offsets(sums), F.col("__in"), "__before")
    totals = rows.groupBy(F.col("grp").alias("g")).agg(F.sum("n").alias("total"), F.min("__before").alias("start"))
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place])))
    rows = rows.join(totals.withColumn("wanted", wanted), F.col("grp").eqNullSafe(F.col("g")))
    rank = F.col("__before") - F.col("start")
    hit = rows.select("g", "total", "value", F.explode(F.filter("wanted", lambda k: (k >= rank) & (k < rank + F.col("n")))).alias("k"))
    found = hit.groupBy("g", "total").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))  # 2 per quantile
    q = []
    for x in place:
        low, high = F.element_at("at", F.floor(x)), F.element_at("at", F.ceil(x))
        q.append(F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high))
    return found.select(F.col("g").alias("grp"), F.col("total").alias("n"), F.array(*q).alias(out))
