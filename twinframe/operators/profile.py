"""Column profiles: kind, distinct count, decimal precision, numeric-but-categorical flag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.cells import (
    NUMBER_LIMIT,
    canonical_text,
    clean_text,
    decimal_places,
    is_numeric_type,
    parse_number,
    valid_number,
)
from twinframe.operators.sides import kind_facts

# Distinct values up to which a numeric column is categorical, and probed cells.
CARDINALITY_LIMIT = 10
PROBE_VALUES = 50
PROBE_ROWS = 1024  # how far along the key the probe reads at first

NUMERICAL = "numerical"
CATEGORICAL = "categorical"


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    type: str
    unique_count: int
    is_heuristic_categorical: bool
    precision: int


def _value(field: T.StructField) -> Column:
    return valid_number(field.name, field.dataType) if _is_float(field) else F.col(f"`{field.name}`")


def _is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def _as_rows(totals: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """One wide row of per-column structs c0, c1, ... as one row per column."""
    named = [
        F.struct(F.lit(at).alias("ordinal"), F.lit(f.name).alias("column"), F.col(f"c{at}").alias("facts"))
        for at, f in enumerate(fields)
    ]
    return totals.select(F.inline(F.array(*named))).select("ordinal", "column", "facts.*")


def _classified(facts: DataFrame) -> DataFrame:
    few = F.col("unique_count") <= CARDINALITY_LIMIT
    numeric = F.col("is_numeric")
    return facts.select(
        "ordinal",
        "column",
        F.when(numeric & ~few, NUMERICAL).otherwise(CATEGORICAL).alias("type"),
        "unique_count",
        (numeric & few).alias("is_heuristic_categorical"),
        F.when(numeric, F.col("precision")).otherwise(0).cast("int").alias("precision"),
    )


def distinct_counts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(ordinal, unique_count) of the given columns of ``df``, exact, missing values left out.

    Cells go to narrow (ordinal, value) rows, one table per data type, and equal values collapse
    before the shuffle. Several ``count(DISTINCT ...)`` in one aggregation would instead copy
    each row once per column at full width.
    """
    by_type: dict[str, list[tuple[int, T.StructField]]] = {}
    for at, field in enumerate(fields):
        by_type.setdefault(field.dataType.simpleString(), []).append((at, field))
    counts = None
    for group in by_type.values():
        cells = [F.struct(F.lit(at).alias("ordinal"), _distinct_key(f).alias("value")) for at, f in group]
        values = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
        counted = values.groupBy("ordinal", "value").agg(F.lit(1)).groupBy("ordinal")
        part = counted.agg(F.count(F.lit(1)).alias("unique_count"))
        counts = part if counts is None else counts.unionAll(part)
    return counts


def _distinct_key(field: T.StructField) -> Column:
    """What tells values apart: long texts are compared by digest, which is 64 bytes of text."""
    value = _value(field)
    if isinstance(field.dataType, T.StringType):
        return F.when(F.octet_length(value) < 64, value).otherwise(F.sha2(value, 256))
    return value


def _with_distinct(facts: DataFrame, counts: DataFrame) -> DataFrame:
    # one row per column on both sides
    joined = facts.join(F.broadcast(counts), "ordinal", "left")
    return joined.withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column of a typed table.

    A column is numeric by its type when it holds any value. ``exact=False`` estimates distinct
    values in the same pass, for tables where shuffling every distinct value costs too much.
    """
    fields = list(df.schema)
    aggregates = []
    for at, field in enumerate(fields):
        value = _value(field)
        numeric = is_numeric_type(field.dataType)
        measures = [
            (F.lit(numeric) & (F.count(value) > 0)).alias("is_numeric"),
            F.coalesce(F.max(decimal_places(value)) if numeric else F.lit(0), F.lit(0)).alias("precision"),
        ]
        if not exact:
            measures.append(F.approx_count_distinct(value).alias("unique_count"))
        aggregates.append(F.struct(*measures).alias(f"c{at}"))
    facts = _as_rows(df.agg(*aggregates), fields)
    return _classified(_with_distinct(facts, distinct_counts(df, fields)) if exact else facts)


def profile_of_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from the counts of a comparison whose original is ``df``, without another scan.

    Numbers are counted as doubles there; a column with whole numbers that a double can't tell apart is counted anew.
    """
    fields, spark = list(df.schema), df.sparkSession
    found = {row["column"]: row for row in kind_facts(counts).collect()}
    large = [f for f in fields if not isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name in found and (found[f.name]["largest"] or 0) >= NUMBER_LIMIT]
    exact = {large[row["ordinal"]].name: row["unique_count"] for row in distinct_counts(df, large).collect()} if large else {}
    rows = []
    for at, field in enumerate(fields):
        row = found.get(field.name)
        unique = exact.get(field.name, row["unique_count"] if row else 0)
        rows.append((at, field.name, is_numeric_type(field.dataType) and unique > 0, (row["precision"] if row else 0) or 0, unique))
    return _classified(spark.createDataFrame(rows, "ordinal int, column string, is_numeric boolean, precision int, unique_count bigint"))


def _probe(cells: DataFrame, names: list[str]) -> dict[str, bool]:
    """Whether the first 50 values of each text column all spell numbers, in the order of ``_at``.

    Stated without a sort: the first non-number has at least 50 values before it, or there is
    no non-number at all.
    """
    cell = {n: F.col(f"`{n}`") for n in names}
    found = cells.agg(
        *[F.min(F.when(cell[n].isNotNull() & parse_number(cell[n]).isNull(), F.col("_at"))).alias(f"c{at}") for at, n in enumerate(names)]
    ).first()
    first = {n: found[f"c{at}"] for at, n in enumerate(names)}
    mixed = [n for n in names if first[n] is not None]
    passed = dict.fromkeys(names, True)
    if mixed:
        before = cells.where(F.col("_at") < max(first[n] for n in mixed)).agg(
            *[F.count(F.when(F.col("_at") < first[n], cell[n])).alias(f"c{at}") for at, n in enumerate(mixed)]
        ).first()
        passed |= {n: before[f"c{at}"] >= PROBE_VALUES for at, n in enumerate(mixed)}
    return passed


def numeric_text(cells: DataFrame, names: list[str]) -> dict[str, bool]:
    """Which text columns a loose CSV import takes for numbers: those whose first 50 values all spell one.

    Along a whole-number key ``_at`` the table is read from its start, each time sixteen times as far,
    and only for the columns that don't have their 50 values yet; the bound on the key reaches the scan.
    Any other key takes whole-table passes.
    """
    if not isinstance(cells.schema["_at"].dataType, T.IntegralType):
        return _probe(cells, names)
    low, high = cells.agg(F.min("_at"), F.max("_at")).first()
    if low is None:
        return dict.fromkeys(names, True)
    passed, open_, reach = {}, list(names), PROBE_ROWS
    while open_:
        last = low + reach > high
        start = cells if last else cells.where(F.col("_at") < low + reach)
        held = start.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{at}") for at, n in enumerate(open_)]).first()
        settled = [n for at, n in enumerate(open_) if last or held[f"c{at}"] >= PROBE_VALUES]
        if settled:
            passed |= _probe(start, settled)
        open_ = [n for n in open_ if n not in passed]
        reach *= 16
    return passed


def profile_text(df: DataFrame, order_by: str) -> DataFrame:
    """Profile a table of text cells the way a loose CSV import types it.

    A column is numeric when the first 50 non-missing values, in row order, all spell numbers.
    """
    names = [name for name in df.columns if name != order_by]
    cells = df.select(F.col(f"`{order_by}`").alias("_at"), *[clean_text(F.col(f"`{n}`")).alias(n) for n in names])
    passed = numeric_text(cells, names)
    # the number of a cell is a column, so that the expressions below don't repeat its making
    parsed = cells.select(*[F.col(f"`{n}`").alias(f"t{at}") for at, n in enumerate(names)], *[parse_number(F.col(f"`{n}`")).alias(f"n{at}") for at, n in enumerate(names)])
    fields = [T.StructField(n, T.StringType()) for n in names]
    aggregates = [
        F.struct(
            (F.count(f"t{at}") > 0 if passed[n] else F.lit(False)).alias("is_numeric"),
            (F.coalesce(F.max(decimal_places(F.col(f"n{at}"))), F.lit(0)) if passed[n] else F.lit(0)).alias("precision"),
        ).alias(f"c{at}")
        for at, n in enumerate(names)
    ]
    facts = _as_rows(parsed.agg(*aggregates), fields)
    categories = parsed.select(*[canonical_text(F.col(f"t{at}"), F.col(f"n{at}")).alias(n) for at, n in enumerate(names)])
    return _classified(_with_distinct(facts, distinct_counts(categories, fields)))


def collect_profile(profiled: DataFrame) -> list[ColumnProfile]:
    """The profile on the driver, where it decides the plan: one small row per column."""
    return [
        ColumnProfile(*[row[name] for name in ColumnProfile.__dataclass_fields__])
        for row in profiled.orderBy("ordinal").collect()
    ]


def split_by_kind(profiles: list[ColumnProfile]) -> tuple[list[str], list[str]]:
    """Names of the numerical and of the categorical columns, in header order."""
    numerical = [p.column for p in profiles if p.type == NUMERICAL]
    return numerical, [p.column for p in profiles if p.type != NUMERICAL]


def apply_types(df: DataFrame, profiles: list[ColumnProfile]) -> DataFrame:
    """Cast text cells to the profiled kinds: doubles, else canonical category text."""
    kinds = {p.column: p.type for p in profiles}

    def typed(name: str) -> Column:
        cell = clean_text(F.col(f"`{name}`"))
        if name not in kinds:
            return F.col(f"`{name}`")
        return (parse_number(cell) if kinds[name] == NUMERICAL else canonical_text(cell)).alias(name)

    return df.select(*[typed(name) for name in df.columns])


def distinct_sketch(field: T.StructField) -> Column:
    return F.approx_count_distinct(_value(field))


def surely_many(df: DataFrame, sketched: dict[str, int]) -> set[str]:
    """Columns with more distinct values than the limit, given their distinct sketches.

    The sketch settles almost every column without shuffling distinct values: at most 10
    distinct values touch at most 10 of its registers, so an estimate above 20 proves more
    than 10 values. Only columns at or below 20 are counted exactly.
    """
    many = {name for name, estimate in sketched.items() if estimate > 2 * CARDINALITY_LIMIT}
    unsure = [name for name in sketched if name not in many]
    if unsure:
        counts = distinct_counts(df, [df.schema[n] for n in unsure])
        many |= {unsure[r["ordinal"]] for r in counts.collect() if r["unique_count"] > CARDINALITY_LIMIT}
    return many


def badge(profiled: DataFrame) -> DataFrame:
    """How a column is shown: Discrete, Continuous or Categorical."""
    return profiled.withColumn(
        "badge",
        F.when(F.col("is_heuristic_categorical"), "Discrete")
        .when(F.col("type") == NUMERICAL, "Continuous")
        .otherwise("Categorical"),
    )
