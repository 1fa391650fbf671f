"""Contract-checked ingest (declared types, value normalisation, validation).

A contract is a small dataclass: column -> (type, required), primary key and
value maps.  Ingest reads every source column as text, coerces the declared
ones with non-raising casts (bad values become NULL and are counted), keeps
undeclared columns untouched, normalises values and validates.  Violations
raise instead of silently skipping the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairrank.config import BOOL_TEXT, GENDER_NORMALIZATION
from fairrank.functions.columns import map_values


@dataclass(frozen=True)
class ColumnSpec:
    type: str            # int64 | float64 | string | bool | datetime64[ns]
    required: bool = False


@dataclass(frozen=True)
class Contract:
    name: str
    columns: dict[str, ColumnSpec]
    primary_key: tuple[str, ...] = ()
    value_normalization: dict[str, dict[str, str]] = field(default_factory=dict)

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, SPARK_TYPES[s.type], True)
                             for c, s in self.columns.items()])


SPARK_TYPES = {
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "datetime64[ns]": T.TimestampNTZType(),
}

CONTRACTS: dict[str, Contract] = {
    "clients": Contract(
        "clients",
        {"ClientID": ColumnSpec("int64", True), "ClientSegment": ColumnSpec("string"),
         "ClientCountry": ColumnSpec("string"), "ClientOptINEmail": ColumnSpec("int64"),
         "ClientOptINPhone": ColumnSpec("int64"), "ClientGender": ColumnSpec("string"),
         "Age": ColumnSpec("float64")},
        ("ClientID",),
        {"ClientGender": GENDER_NORMALIZATION},
    ),
    "products": Contract(
        "products",
        {"ProductID": ColumnSpec("int64", True), "Category": ColumnSpec("string"),
         "FamilyLevel1": ColumnSpec("string"), "FamilyLevel2": ColumnSpec("string"),
         "Universe": ColumnSpec("string")},
        ("ProductID",),
    ),
    "stores": Contract(
        "stores",
        {"StoreID": ColumnSpec("int64", True), "StoreCountry": ColumnSpec("string")},
        ("StoreID",),
    ),
    "stocks": Contract(
        "stocks",
        {"StoreCountry": ColumnSpec("string", True), "ProductID": ColumnSpec("int64", True),
         "Quantity": ColumnSpec("float64")},
        ("StoreCountry", "ProductID"),
    ),
    "transactions": Contract(
        "transactions",
        {"ClientID": ColumnSpec("int64", True), "ProductID": ColumnSpec("int64", True),
         "SaleTransactionDate": ColumnSpec("datetime64[ns]", True),
         "StoreID": ColumnSpec("int64", True), "Quantity": ColumnSpec("int64"),
         "SalesNetAmountEuro": ColumnSpec("float64")},
        (),
    ),
}


# --------------------------------------------------------------------------
# C1-C5 coercions (non-raising; bad input -> NULL)
# --------------------------------------------------------------------------
def _strip(c: Column) -> Column:
    """Strip leading/trailing whitespace (spaces, tabs, newlines)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def coerce_datetime(c: Column) -> Column:
    s = _strip(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(s).cast("timestamp_ntz"),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def coerce_bool(c: Column) -> Column:
    s = c.cast("string")
    expr = None
    for k, v in BOOL_TEXT.items():
        expr = F.when(s == k, F.lit(v)) if expr is None else expr.when(s == k, F.lit(v))
    return expr.otherwise(F.lit(None).cast("boolean"))


def coerce_string(c: Column) -> Column:
    return _strip(c.cast("string"))


def coerce_int64(c: Column) -> Column:
    """Integral text -> bigint; ``"3.0"`` -> 3; fractional or junk -> NULL."""
    s = _strip(c.cast("string"))
    as_long = s.try_cast("bigint")
    as_double = s.try_cast("double")
    integral = F.when((as_double == F.floor(as_double)) & ~F.isnan(as_double),
                      as_double.try_cast("bigint"))
    return F.coalesce(as_long, integral)


def coerce_float64(c: Column) -> Column:
    d = _strip(c.cast("string")).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


COERCERS = {
    "datetime64[ns]": coerce_datetime,
    "bool": coerce_bool,
    "string": coerce_string,
    "int64": coerce_int64,
    "float64": coerce_float64,
}


def coerce_to_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Apply declared coercions and value maps; undeclared columns pass through."""
    return df.select(*_coercions(df, contract))


def _coercions(df: DataFrame, contract: Contract) -> list[Column]:
    out = []
    for f in df.schema.fields:
        spec = contract.columns.get(f.name)
        c = F.col(f.name)
        if spec is not None:
            target = SPARK_TYPES[spec.type]
            if f.dataType == target and spec.type not in ("string", "float64"):
                coerced = c
            elif spec.type == "float64" and isinstance(f.dataType, T.DoubleType):
                coerced = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
            elif spec.type == "datetime64[ns]" and isinstance(f.dataType, (T.TimestampType, T.DateType)):
                coerced = c.cast("timestamp_ntz")
            else:
                coerced = COERCERS[spec.type](c)
            if f.name in contract.value_normalization:
                coerced = map_values(coerced, contract.value_normalization[f.name])
            c = coerced
        out.append(c.alias(f.name))
    return out


def contract_errors(df: DataFrame, contract: Contract) -> DataFrame:
    """Q5: one row per violation (missing required column / duplicated PK rows)."""
    spark = df.sparkSession
    errors = [(f"missing required column: {c}",) for c, s in contract.columns.items()
              if s.required and c not in df.columns]
    base = spark.createDataFrame(errors, "error string")
    pk = [c for c in contract.primary_key if c in df.columns]
    if pk and len(pk) == len(contract.primary_key):
        dup = (df.groupBy(*pk).count().where(F.col("count") > 1)
                 .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
                 .where(F.col("n") > 0)
                 .select(F.concat(F.lit(f"primary key {list(pk)} has "), F.col("n").cast("string"),
                                  F.lit(" duplicate rows")).alias("error")))
        base = base.unionByName(dup)
    return base


def ingest_frame(df: DataFrame, contract: Contract, known_products: DataFrame | None = None,
                 raise_on_error: bool = True) -> DataFrame:
    """S1 on an already-read frame: coerce, normalise, validate, filter stocks."""
    out = coerce_to_contract(df, contract)
    if raise_on_error:
        errs = [r.error for r in contract_errors(out, contract).collect()]
        if errs:
            raise ValueError(f"contract '{contract.name}' violated: {errs}")
    if contract.name == "stocks" and known_products is not None:
        out = out.join(known_products.select("ProductID").distinct(), "ProductID", "left_semi")
    return out


def read_csv_with_contract(spark: SparkSession, path: str, contract: Contract,
                           known_products: DataFrame | None = None,
                           raise_on_error: bool = True) -> DataFrame:
    """Read CSV as text (no inference pass over the data), then coerce."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("mode", "PERMISSIVE").csv(path))
    return ingest_frame(raw, contract, known_products, raise_on_error)


# Texts that stand for a missing value (fixed values).
_MISSING = ("", "nan", "null", "none")


def violations(df: DataFrame, contract: Contract) -> Column:
    """Per row of text columns an array of what breaks the contract: values that
    the declared type can't take, and missing values of required columns."""
    return _violations(df.columns, contract, {f.name: e for f, e in zip(df.schema.fields, _coercions(df, contract))}, F.col)


def _violations(columns: Sequence[str], contract: Contract, coerced: dict[str, Column], text: Callable[[str], Column]) -> Column:
    found = []
    for name, spec in contract.columns.items():
        if name not in columns:
            continue
        given = ~F.lower(_strip(F.coalesce(text(name).cast("string"), F.lit("")))).isin(*_MISSING)
        found.append(F.when(given & coerced[name].isNull(), F.lit(f"{name}: not a {spec.type}"))
                      .when(~given & F.lit(spec.required), F.lit(f"{name}: missing")))
    return F.array_compact(F.array(*found))


def ingest_with_quarantine(df: DataFrame, contract: Contract, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """One pass writes all rows below ``path``, valid ones and rejected ones apart.

    Returns the valid rows under the contract's types, the rejected rows (the same columns, their
    violations and the text as it came) and the counts of what was written."""
    # values are coerced once; what they break is read off the coerced columns
    typed = df.select(*_coercions(df, contract), *[F.col(c).alias(f"__text_{c}") for c in df.columns])
    broken = _violations(df.columns, contract, {c: F.col(c) for c in df.columns}, lambda c: F.col(f"__text_{c}"))
    as_read = F.to_json(F.struct(*[F.col(f"__text_{c}").cast("string").alias(c) for c in df.columns]))
    out = typed.select(*df.columns, broken.alias("violations"), as_read.alias("as_read"))
    out = out.withColumn("rejected", (F.size("violations") > 0).cast("int"))
    # (no Observation: a session that has made one can't ship Spark ML's forests to tasks any more)
    out.write.mode("overwrite").partitionBy("rejected").parquet(path)
    stored = df.sparkSession.read.schema(out.schema).parquet(path)
    n = {r["rejected"]: r["count"] for r in stored.groupBy("rejected").count().collect()}  # two rows at most
    valid = stored.where("rejected = 0").select(*df.columns)
    return valid, stored.where("rejected = 1").select(*df.columns, "violations", "as_read"), {
        "rows": sum(n.values()), "rejected": n.get(1, 0)}


def ingest_to_parquet(df: DataFrame, out_path: str) -> None:
    df.write.mode("overwrite").parquet(out_path)
